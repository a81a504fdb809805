import random
from collections import Counter

from panelkit.llm import substring


def brute(texts, window):
    split = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def corpus(rng, n=60):
    passages = [[rng.choice("abcdefgh") + str(rng.randint(0, 30)) for _ in range(rng.randint(10, 90))] for _ in range(8)]
    texts = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 5)):
            p = list(rng.choice(passages)) if rng.random() < 0.6 else [f"u{rng.random()}" for _ in range(rng.randint(1, 40))]
            if rng.random() < 0.4 and p:
                p[rng.randrange(len(p))] = "edit"
            words += p
        texts.append(rng.choice([" ", "\n", "\t ", "　"]).join(words) if rng.random() < 0.2 else " ".join(words))
    return [*texts, texts[3], texts[3], "", None, "a " * 300, "a " * 34, "é ß " * 50]


def test_matches_brute_force(spark):
    for seed, window, shard in ((1, 35, 2048), (2, 12, 3), (3, 5, 1)):
        texts = corpus(random.Random(seed))
        df = spark.createDataFrame([(t, 1, "x") for t in texts], "text string, k1 int, kept string")
        got = {(r.n_words, r.n_removed, r.kept) for r in substring.repeated_spans(df, window=window, shard=shard).collect()}
        assert got == set(brute(texts, window))


def test_spans_cover_what_goes(spark):
    df = spark.createDataFrame([("p " + "q r s t u " * 3,), ("z q r s t u v",)], "text string")
    for r in substring.repeated_spans(df, window=5).collect():
        assert sum(s.end - s.first for s in r.spans) == r.n_removed


def test_rows_keep_their_columns(spark):
    long = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(1, "own start " + long, 9, "k"), (2, long + " own  end", 9, None), (None, None, 0, "n"), (3, "left  as is", 11, "m")], "doc_id long, text string, n_chars int, k1 string")
    out = substring.without_repeats(df)
    assert out.columns == df.columns and out.schema["n_chars"].dataType == df.schema["n_chars"].dataType
    assert {r.doc_id: (r.text, r.n_chars, r.k1) for r in out.collect()} == {1: ("own start", 9, "k"), 2: ("own end", 7, None), None: (None, 0, "n"), 3: ("left  as is", 11, "m")}
    assert substring.repeated_spans(df.limit(0)).count() == 0


def test_very_long_words_and_texts():
    assert len(substring.word_hashes(b"x" * 3_000_000 + b" y " + b"x" * 3_000_000)) == 3
    h = substring.word_hashes(b"x" * 3_000_000 + b" y " + b"x" * 3_000_000)
    assert h[0] == h[2] != h[1]
    many = " ".join(f"v{i % 977}" for i in range(400_000)).encode()
    h = substring.word_hashes(many)
    assert len(h) == 400_000 and h[0] == h[977] and h[1] == h[977 * 300 + 1]
