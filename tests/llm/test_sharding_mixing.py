import random
from collections import Counter, defaultdict

import numpy as np
from panelkit.llm import mixing, sharding
from panelkit.llm._common import cut
from panelkit.llm._ranges import running_totals, sortable

SCHEMA = "doc_id long, text string, source string, n_chars long, shard string, size int"


def documents(n=800):
    rng = random.Random(4)
    texts = [" ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 80))) for _ in range(n)]
    texts[5] = "long " * 3000
    rows = [(i, t, rng.choice(["b", "a", "é", "Z", None]) if i % 3 else "hot", len(t), "s", 1) for i, t in enumerate(texts)]
    return rows + [rows[7]] * 300 + [(None, None, None, None, None, None), (None, "x y", "a", 3, None, None), (3, "tie", "a", 3, "", 0)]


def test_sortable_codes():
    x = np.array([-5.0, -0.0, 0.0, 1e-300, 2.5, 1e300])
    y = np.array([3, -1, 7, 0, 0, -9])
    codes = sortable([x, y])
    order = sorted(range(6), key=lambda i: (x[i], y[i]))
    assert np.argsort(codes, kind="stable").tolist() == order


def test_running_totals(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 50), i, rng.choice([0, 1, 2, 500])) for i in range(5000)]
    df = cut(spark.createDataFrame(rows, "a long, b long, w long"))
    got = {(r.a, r.b): (r._before, r._row) for r in running_totals(df, ["a", "b"], "w").collect()}
    total = 0
    for i, (a, b, w) in enumerate(sorted(rows)):
        assert got[(a, b)] == (total, i)
        total += w
    assert running_totals(cut(df.limit(0)), ["a", "b"], "w").count() == 0


def test_shards(spark):
    rows = documents()
    df = spark.createDataFrame(rows, SCHEMA)
    out = sharding.assign_shards(sharding.records(df), ["text_crc32", "doc_id"], "size", 7).collect()
    assert len(out) == len(rows)
    want = Counter((r[0], len((r[1] or "").encode()) + 16) for r in rows)
    assert Counter((r.doc_id, r["size"]) for r in out) == want
    by, slots = Counter(), defaultdict(list)
    for r in out:
        by[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    mean, most = sum(by.values()) / 7, max(r["size"] for r in out)
    assert all(abs(by[s] - mean) <= most for s in range(7))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sharding.assign_shards(sharding.records(df.limit(0)), ["doc_id"], "size", 7).count() == 0
    assert sharding.assign_shards(sharding.records(df.limit(2)), ["doc_id"], "size", 7).count() == 2


def test_targets():
    assert mixing.fair_targets([10, 10, 10], [5, 2, 1], 45) == [20.0, 50 / 3, 25 / 3]
    assert mixing.fair_targets([0, 8], [5, 2], 12) == [0.0, 12.0]
    assert mixing.fair_targets([], [], 0) == []


def test_mix(spark):
    rows = documents()
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    words = lambda t: len((t or "").encode().split())
    assert Counter((r.doc_id, r.source, r["size"]) for r in out) == Counter((r[0], r[2], words(r[1])) for r in rows)
    sizes, taken, target = Counter(), Counter(), {}
    for r in out:
        assert 0 <= r.taken <= 2 * r["size"] and sum(r.passes) == r.taken
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = mixing.fair_targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(sizes.values()))
    for s, t in zip(names, want, strict=True):
        assert abs(target[s] - t) < 1e-6 and abs(taken[s] - t) <= 3000
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= 1
    again = mixing.mix(df.repartition(3)).collect()
    assert Counter(map(str, again)) == Counter(map(str, out))
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixture_rows(spark):
    df = spark.createDataFrame(documents(200), SCHEMA)
    out = mixing.mixture(df)
    assert out.columns == df.columns
    got = Counter()
    for r in out.collect():
        got[r.source] += len((r.text or "").encode().split())
    want = Counter()
    for r in mixing.mix(df).collect():
        want[r.source] += r.taken
    assert +got == +want
    assert mixing.mixture(df.limit(0)).count() == 0
