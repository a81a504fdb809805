import itertools
import random

import numpy as np
from panelkit.llm import toxicity


def corpus(n=400):
    rng = random.Random(2)
    bad = ["grumble", "snarlish", "vexo"]
    out = []
    for i in range(n):
        words = ["".join(rng.choice(["an", "th", "er", "on", "re", "ti"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(8, 60))]
        if i % 4 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice([bad[0].title(), bad[1] + "!", bad[2] + rng.choice(["ri", "la", "mu"])])
        out.append((i, " ".join(words), int(any(b in w.lower() for w in words for b in bad))))
    return out


def test_marginals_match_enumeration():
    """Every path of states by its emissions and the transitions between words; nothing comes before the first word."""
    for weights, t, text in (
        ({"x": 2.0, "y": 1.0}, [[0.3, -0.4], [-0.2, 0.9]], "a b x c y x d"),
        ({"x": 2.0}, [[0.3, -1.4], [-0.2, 0.9]], "x"),
        ({"x": 2.0}, [[0.3, -1.4], [-0.2, 0.9]], "x b x"),
        ({"x": 2.0}, [[0.3, -1.4], [-0.2, 0.9]], "b x"),
    ):
        model = toxicity.ToxicityModel(weights, -0.7, np.array(t))
        words = text.split()
        total, tagged = 0.0, np.zeros(len(words))
        for path in itertools.product((0, 1), repeat=len(words)):
            s = sum(state * (-0.7 + weights.get(w, 0.0)) for state, w in zip(path, words, strict=True))
            s += sum(t[a][b] for a, b in itertools.pairwise(path))
            total += np.exp(s)
            tagged += np.exp(s) * np.array(path)
        at, p, n = model.marginals(text)
        assert n == len(words) and at.tolist() == [i for i, w in enumerate(words) if w in weights]
        assert np.allclose(p, (tagged / total)[at])


def test_fit_and_inference_agree():
    """The expectations that fitting uses are those of inference: at the optimum the mean marginal is the share of toxic words."""
    texts = ["x a", "a x", "x", "a a a", "x b b x"] * 20
    model = toxicity.fit_field(texts, [True, True, False, False, True] * 20, ["x"], rounds=3000)
    assert abs(model.marginals("x")[1][0] - 0.0) < 0.25 and model.marginals("x a")[1][0] > 0.75


def test_held_out_accuracy_and_offsets(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(9000, None, 0.1), (None, "", 0.2), (0, rows[0][1], 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (0, rows[0][2]), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    out = toxicity.with_toxicity(docs, model).collect()
    assert len(out) == len(rows) + 3
    truth = {i: y for i, _, y in rows}
    assert np.mean([(r.toxicity.score >= 0.7) == truth[r.doc_id] for r in out if r.doc_id in truth]) >= 0.97
    for r in out:
        for s in r.toxicity.spans:
            assert toxicity.form(r.text[s.first : s.end]).startswith(("grumble", "snarlish", "vexo"))
        if not r.text:
            assert 0 <= r.toxicity.score < 0.5


def test_no_rows_one_class_and_long_text():
    for model in (toxicity.fit([], []), toxicity.fit(["a b"] * 3, [0] * 3), toxicity.fit(["a b"] * 3, [1] * 3)):
        assert 0 <= model.score(["a b"])[0] <= 1
    model = toxicity.fit([t for _, t, _ in corpus(200)], [y for *_, y in corpus(200)])
    text = "word " * 200_000 + "Grumble"
    at, p, n = model.marginals(text)
    assert n == 200_001 and at.tolist() == [200_000] and np.isfinite(p).all()


def test_empty_table_and_clashing_column(spark):
    model = toxicity.fit([t for _, t, _ in corpus(100)], [y for *_, y in corpus(100)])
    docs = spark.createDataFrame([(1, "grumble", "kept")], "doc_id long, text string, toxicity string")
    out = toxicity.with_toxicity(docs, model)
    assert out.columns == ["doc_id", "text", "toxicity"] and out.count() == 1
    assert toxicity.with_toxicity(docs.limit(0), model).count() == 0
