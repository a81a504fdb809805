"""Order statistics over sampled ranges against plain versions, with ranges small enough to split every group."""

import random

import numpy as np
import pytest
from panelkit.operators import aggregate, estimate, latent, ranges


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(6)
    rows = [("hot" if i % 3 else f"g{i % 7}", rng.choice([None, rng.randint(0, 40), rng.random() * 9])) for i in range(600)] + [(None, 3.0), (None, 3.0), (None, 1.0), ("none", None)]
    rows = [(g, None if v is None else float(v), i % 5) for i, (g, v) in enumerate(rows)]
    return rows, spark.createDataFrame(rows, "g string, v double, _range int")


def groups(rows):
    out = {}
    for g, v, _ in rows:
        out.setdefault(g, []).append(v)
    return out


@pytest.mark.parametrize("size", [7, 100_000])
def test_quantiles(data, size):
    rows, df = data
    want = {g: [v for v in vs if v is not None] for g, vs in groups(rows).items()}
    got = {r.g: r for r in ranges.quantiles(df, ["g"], "v", [0, 0.1, 0.5, 0.99, 1], size).collect()}
    assert set(got) == set(want)
    for g, vs in want.items():
        assert got[g].n == len(vs)
        for i, p in enumerate([0, 0.1, 0.5, 0.99, 1]):
            assert got[g][f"q{i}"] == pytest.approx(np.quantile(vs, p), abs=1e-12) if vs else got[g][f"q{i}"] is None
    every = [v for _, v, _ in rows if v is not None]
    assert ranges.quantiles(df, [], "v", [0.25], size).first().q0 == pytest.approx(np.quantile(every, 0.25))


def test_trim_and_empty(data):
    rows, df = data
    cut = {g: np.quantile([v for v in vs if v is not None], 0.9) for g, vs in groups(rows).items() if any(v is not None for v in vs)}
    want = sorted(str(r) for r in rows if r[1] is not None and r[1] <= cut[r[0]])
    assert sorted(str(tuple(r)) for r in aggregate.trim_quantile(df, ["g"], "v", 0.9).collect()) == want
    assert ranges.quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0 and ranges.dense_ranks(df.limit(0), ["g"], ["v"], "k").count() == 0


def test_ranks_and_running_totals(data):
    rows, df = data
    got = ranges.dense_ranks(df, ["g"], ["v"], "k", 11).collect()
    for g, vs in groups(rows).items():
        own = sorted((r for r in got if r.g == g), key=lambda r: r.k)
        assert [r.k for r in own] == list(range(len(vs)))
        assert [r.v for r in own] == sorted(vs, key=lambda v: (v is not None, v))
    cells = df.groupBy("g", "v").count()
    for r in ranges.running(cells, ["g"], "v", {"below": "count"}, 11).collect():
        vs = groups(rows)[r.g]
        assert r.below == sum(v is None or v < r.v for v in vs) if r.v is not None else r.below == 0


@pytest.mark.parametrize("size", [5, 4096])
def test_dominance_counts(spark, size):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(2000, 2009)]), rng.choice([None, 1.0, 2.5, rng.random()]), "low") for i in range(500)]
    df = spark.createDataFrame(rows, "id int, c string, t int, v double, low string")
    usable = [r for r in rows if None not in r[1:4]]
    want = {}
    for i, c, t, v, _ in rows:
        peers = [p[3] for p in usable if p[1] == c and p[2] <= t] if None not in (c, t, v) else []
        want[i] = 10 * sum((p < v) + (p == v) / 2 for p in peers) / len(peers) if len(peers) >= 10 else None
    got = aggregate.percentile_score_cumulative(df, ["c"], "t", "v", 10, size).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.score == pytest.approx(want[r.id], abs=1e-12) if want[r.id] is not None else r.score is None
    assert aggregate.percentile_score_cumulative(df.limit(0), ["c"], "t", "v").count() == 0


def test_auc_over_ranges(spark, monkeypatch):
    rng = np.random.default_rng(4)
    y = rng.random(800) < 0.4
    s = np.where(rng.random(800) < 0.3, 0.5, rng.normal(size=800) + y)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y, strict=True)] + [(None, 1), (0.1, None)], "s double, y int")
    plain = np.mean([(a > b) + (a == b) / 2 for a in s[y] for b in s[~y]])
    whole = estimate.auc_bootstrap_ci(df, "s", "y", 60).first()
    assert whole.auc == pytest.approx(plain) and whole.ci_low < plain < whole.ci_high and whole.n_draws == 60
    deciles = [tuple(r) for r in latent.tie_keeping_deciles(df, "s", "y").orderBy("decile").collect()]
    for f in (ranges.in_ranges, ranges.running):
        monkeypatch.setattr(f, "__defaults__", tuple(37 if v == ranges.ROWS_PER_RANGE else v for v in f.__defaults__))
    split = estimate.auc_bootstrap_ci(df.repartition(5), "s", "y", 60).first()
    assert [split.auc, split.ci_low, split.ci_high] == pytest.approx([whole.auc, whole.ci_low, whole.ci_high], abs=1e-12)
    assert [tuple(r) for r in latent.tie_keeping_deciles(df, "s", "y").orderBy("decile").collect()] == deciles
    none = estimate.auc_bootstrap_ci(df.limit(0), "s", "y", 10).first()
    assert none.auc is None and none.n1 == 0 and none.n_draws == 0
