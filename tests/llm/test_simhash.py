import itertools
import random

import numpy as np
import xxhash
import pytest
from panelkit.llm import _common, _graph, simhash


def brute(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), seed=42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(ids, fps):
    root = {i: i for i in range(len(ids))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 2:
            root[find(i)] = find(j)
    groups = {}
    for i in root:
        groups.setdefault(find(i), []).append(ids[i])
    return {i: min((x for x in groups[find(i)] if x is not None), default=None) for i in root}


def texts():
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(60)) for _ in range(25)]
    near = [b + " zz" for b in base[:12]] + [b.upper() for b in base[:4]]
    return base + near + [base[0]] * 5 + ["", None, " \t\n", "one", "one two", "ÉCOLE é x", "x " * 70000]


def test_fingerprints_match_brute_force():
    for t in texts():
        assert simhash.fingerprint(t) == brute(t)


def test_golay_keys_miss_no_pair():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 3000, dtype=np.int64)
    y = x.copy()
    for _ in range(2):
        y ^= (np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)).view(np.int64)
    rows, keys = simhash._keys(x, True)
    looked = set(zip(rows.tolist(), keys.tolist(), strict=True))
    rows, keys = simhash._keys(y, False)
    met = {r for r, k in zip(rows.tolist(), keys.tolist(), strict=True) if (r, k) in looked}
    assert met == set(range(len(x)))


def test_components_match_brute_force(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts())] + [(None, texts()[0], "x", 2), (3, texts()[3], "x", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    want = closure([r[0] for r in rows], [brute(r[1]) for r in rows])
    by = {}
    for i, r in enumerate(rows):
        by.setdefault((r[0], brute(r[1])), want[i])
    for r in got:
        assert r.component_id == by[(r.doc_id, r.fp % 2**64)]


def test_keep_one_and_empty(spark):
    schema = "doc_id long, text string, n_chars long"
    df = spark.createDataFrame([(5, "a b c d e", 9), (2, "a b c d e", 9), (2, "a b c d e", 9), (7, "totally different words here now", 1), (None, None, None)], schema)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 2), (False, 7), (True, None)]
    none = spark.createDataFrame([], schema)
    assert simhash.keep_one(none).count() == 0 and simhash.near_duplicates(none).count() == 0


def near_copies():
    """Word texts with copies at similarities around 0.8, as (id, text)."""
    rng = random.Random(8)
    rows = []
    for n, edits in [(300, 2), (300, 4), (300, 6), (300, 12), (1000, 5), (1000, 20), (1000, 40), (20, 1), (8, 1)] * 3:
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        for _ in range(3):
            copy = list(base)
            for at in rng.sample(range(n), edits):
                copy[at] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
        rows.append(" ".join(base))
    rows += ["", None, " ", "one two", "One  two", "one three"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def jaccard_roots(rows):
    grams = []
    for _, t in rows:
        words = (t or "").lower().split()
        grams.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        union = len(grams[i] | grams[j])
        if not union or 5 * len(grams[i] & grams[j]) >= 4 * union:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {rows[i][0] for i in range(len(rows)) if find(i) == i}


def test_stage_keeps_one_of_similar_texts(spark):
    import corpus_pipeline

    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, df, "").collect()}
    assert kept == jaccard_roots(rows)
    assert corpus_pipeline.simhash_near_dedup(spark, df.limit(0), "").count() == 0


def edges():
    """A chain, a star, a ring, loops and random pairs, as (a, b)."""
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(100, 400)] + [(1000, 1001 + i) for i in range(50)] + [(2000 + i, 2000 + (i + 1) % 40) for i in range(40)]
    pairs += [(5, 5), (-7, 9), (9, -7)] + [(rng.randrange(3000, 3300), rng.randrange(3000, 3300)) for _ in range(200)]
    rng.shuffle(pairs)
    return pairs


@pytest.mark.parametrize("kind", ["long", "string"])
def test_components_by_one_task_and_by_rounds(spark, kind, monkeypatch):
    pairs = [(a, b) if kind == "long" else (f"é{a}", f"é{b}") for a, b in edges()]
    root = {x: x for pair in pairs for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {x for a, b in pairs for x in (a, b) if a != b}
    df = spark.createDataFrame(pairs, f"a {kind}, b {kind}")
    for most in (_graph.EDGES, 100, 0):
        monkeypatch.setattr(_graph, "EDGES", most)
        got = [(r.node, r.root) for r in _graph.components(df).collect()]
        assert sorted(got) == sorted((x, find(x)) for x in linked)
    assert _graph.components(df.limit(0)).count() == 0


def test_few_edges_take_few_jobs(spark):
    df = spark.createDataFrame(edges(), "a long, b long")
    spark.sparkContext.setJobGroup("components", "")
    assert _graph.components(df).count() > 0
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("components")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(jobs) <= 10


def test_workers_drop_what_another_operator_left(monkeypatch):
    monkeypatch.setattr(_common, "_state", {})
    calls = []
    monkeypatch.setattr(_common, "_trim", calls.append)
    _common.worker_state(("bpe", 1), lambda: bytearray(1 << 20))
    _common.fresh("simhash")
    assert ("bpe", 1) not in _common._state and calls
    kept = _common.worker_state(("bpe", 1), object)
    assert _common.worker_state(("bpe", 1), object) is kept


def test_texts_far_apart_in_one_bucket_take_few_rounds(spark, monkeypatch):
    """Every pair of the bucket is compared, in three rounds; two texts are alike."""
    sets = [(k, np.arange(100 * k, 100 * k + 10, dtype=np.uint64).tobytes(), 10) for k in range(60)]
    sets += [(60, sets[37][1], 10)]
    rounds, verified = [], simhash._verified

    def counted(*args):
        rounds.append(1)
        return verified(*args)

    monkeypatch.setattr(simhash, "_verified", counted)
    places = spark.createDataFrame([(1, k, 0) for k, _, _ in sets], "bucket long, k long, bits long")
    got = simhash.linked_texts(places, spark.createDataFrame([(k, bytearray(h), n) for k, h, n in sets], "k long, hashes binary, size long"), 0.8)
    assert sorted((r.node, r.root) for r in got.collect()) == [(37, 37), (60, 37)]
    assert len(rounds) <= 3
