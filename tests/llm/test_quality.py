import random

import numpy as np
from panelkit.llm import quality


def corpus(n=300):
    rng = random.Random(2)
    out = []
    for i in range(n):
        words = ["".join(rng.choice(["an", "th", "er", "on", "re"]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60))]
        good = i % 3 != 0
        if not good:
            words = [w + "$$$" for w in words] if i % 2 else [w.upper() + "!!" for w in words]
        out.append((i, " ".join(words), int(good)))
    return out


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(9000, None, 0.1), (None, "", 0.2), (0, rows[0][1], 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (5, None), (0, rows[0][2])], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    scored = quality.with_score(docs.select("doc_id", "text"), model).withColumn("held", quality.remainder("doc_id", 5) == 0).collect()
    assert len(scored) == len(rows) + 3
    truth = {i: q for i, _, q in rows}
    held = [r for r in scored if r.held and r.doc_id in truth]
    assert held and np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in held]) >= 0.95
    assert all(r.score == 0 for r in scored if not r.text)


def test_no_rows_or_one_class():
    assert quality.fit([], []).score(["a b", ""]).tolist() == [0.5, 0.0]
    assert 0.9 < quality.fit(["a b"] * 3, [1] * 3).score(["a b"])[0] <= 0.99


def test_long_text_and_repeats():
    model = quality.fit(*zip(*[(t, q) for _, t, q in corpus(60)], strict=True))
    text = " ".join(f"w{i}" for i in range(150_000))
    assert 0 <= model.score([text])[0] <= 1
    assert np.allclose(model.score(["a b c"] * 2), model.score(["a b c"])[0])


def test_a_score_does_not_depend_on_its_batch():
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["an", "the", "###", "0000", "river", "stone"], rng.integers(1, 300))) for _ in range(60)]
    model = quality.fit(texts, [i % 2 for i in range(60)], rounds=20)
    alone = model.score(texts[:1])[0]
    for n in range(1, 41):
        assert model.score([*texts[20 : 20 + n], texts[0]])[-1] == alone == model.score([texts[0], *texts[20 : 20 + n]])[0]
