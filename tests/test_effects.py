"""Several absorbed effects on the graph of their levels, against dummies."""

import numpy as np
import pytest
from panelkit.operators import aggregate, estimate
from pyspark.sql import functions as F


def chain(n, seed=1, both=True):
    """Rows of units that meet their neighbours in one period only: the worst connected graph; and a second part of two levels."""
    rng = np.random.default_rng(seed)
    u = np.repeat(np.arange(n), 6)
    t = u + np.tile([0, 0, 0, 1, 1, 1], n)
    u, t = (np.concatenate([v, w]) for v, w in ((u, [900, 900, 901, 901, 901]), (t, [900, 901, 900, 901, 901])))
    x = rng.normal(size=len(u)) + u / 50
    y = 1.5 * x + rng.normal(size=len(u)) + 100 * np.sin(u) + t
    return u, t, x, y


def frame(spark, u, t, x, y):
    return spark.createDataFrame([(int(a), f"p{b}", float(c), float(e)) for a, b, c, e in zip(u, t, x, y, strict=True)], "u int, t string, x double, y double")


def dummies(u, t):
    return np.column_stack([(u[:, None] == np.unique(u)).astype(float), (t[:, None] == np.unique(t)).astype(float)])


def test_equals_dummies_on_a_badly_connected_graph(spark):
    u, t, x, y = chain(5)
    d = dummies(u, t)
    ends = [v - d @ np.linalg.lstsq(d, v, rcond=None)[0] for v in (x, y)]
    beta = ends[0] @ ends[1] / (ends[0] @ ends[0])
    f = estimate.fit(frame(spark, u, t, x, y), "y", ["x"], ["u", "t"])
    assert f.beta[0] == pytest.approx(beta, rel=1e-8)
    net = np.array(f.rows.select("_x0", "_y").orderBy("_x0").collect())
    assert np.allclose(net, np.column_stack(ends)[ends[0].argsort()], rtol=0, atol=1e-8)
    # Two parts: the chain and the second one.
    assert f.absorbed == len(np.unique(u)) + len(np.unique(t)) - 1
    assert np.linalg.matrix_rank(d) == estimate.fit(frame(spark, u, t, x, y), "y", ["x"], ["u", "t"], exact=True).absorbed


def test_rows_are_read_as_often_on_any_graph(spark):
    reads = {}
    for n in (2, 5):
        u, t, x, y = chain(n)
        seen = spark.sparkContext.accumulator(0)

        def count(batches, seen=seen):
            for pdf in batches:
                seen.add(len(pdf))
                yield pdf

        rows = frame(spark, u, t, x, y)
        estimate.demean(rows.mapInPandas(count, rows.schema), ["x", "y"], ["u", "t"]).write.format("noop").mode("overwrite").save()
        reads[n] = seen.value / len(u)
    # The means, the cells (made and kept) and what levels take out.
    assert reads[2] == reads[5] <= 4


def test_three_effects_and_edges(spark):
    rng = np.random.default_rng(3)
    a, b, c = rng.integers(0, 5, 120), rng.integers(0, 4, 120), rng.integers(0, 3, 120)
    y = rng.normal(size=120) + a + 2 * b - c
    d = np.column_stack([(v[:, None] == np.unique(v)).astype(float) for v in (a, b, c)])
    rows = spark.createDataFrame([(i, *map(int, r[:3]), float(r[3])) for i, r in enumerate(zip(a, b, c, y, strict=True))], "i int, level int, a0 int, c int, y double")
    out = [r["y"] for r in estimate.demean(rows, ["y"], ["level", "a0", "c"]).orderBy("i").collect()]
    assert np.allclose(out, y - d @ np.linalg.lstsq(d, y, rcond=None)[0], atol=1e-9)
    assert estimate.demean(rows.limit(0), ["y"], ["level", "c"]).count() == 0
    # A null level counts as a level; a column that the levels explain is zero.
    gaps = rows.withColumn("c", F.when(F.col("c") > 0, F.col("c"))).withColumn("y", F.col("level") * 10.0 - F.coalesce("c", F.lit(0)))
    assert max(abs(r["y"]) for r in estimate.demean(gaps, ["y"], ["level", "c"]).collect()) < 1e-9
    with pytest.raises(ArithmeticError, match="not absorbed"):
        estimate.demean(rows, ["y"], ["level", "c"], rounds=1)


def test_pretrend_tests(spark):
    """A planted trend is found by all three tests, whose numbers equal those of dummies; one period before is no trend."""
    rng = np.random.default_rng(5)
    u, p = (v.ravel() for v in np.meshgrid(np.arange(12), np.arange(6), indexing="ij"))
    treated = (u < 6).astype(float)
    y = rng.normal(size=len(u)) * 0.3 + u + p + treated * 0.8 * p
    df = spark.createDataFrame([(int(a), int(b), int(c), float(e)) for a, b, c, e in zip(u, p, treated, y, strict=True)], "u int, p int, treated int, y double")
    out = {r["test"]: r for r in estimate.pretrend_tests(df, "y", "u", "p", "treated", 3, list(range(6)), short=2).collect()}
    d = dummies(u, p)
    x = np.column_stack([treated * (p == k) for k in (0, 1, 2, 4, 5)])
    x, r = (v - d @ np.linalg.lstsq(d, v, rcond=None)[0] for v in (x, y))
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ r
    s = np.array([x[u == k].T @ (r - x @ beta)[u == k] for k in range(12)])
    # Unit effects lie inside the clusters and count as one level with the intercept, period effects as five more.
    v = 12 / 11 * (len(u) - 1) / (len(u) - 5 - 6) * inverse @ s.T @ s @ inverse
    for test, at in (("joint leads", [0, 1, 2]), ("last leads", [1, 2])):
        assert out[test]["f_value"] == pytest.approx(beta[at] @ np.linalg.solve(v[np.ix_(at, at)], beta[at]) / len(at), rel=1e-6)
        assert out[test]["df1"] == len(at) and out[test]["p_value"] < 0.01
    assert out["trend"]["estimate"] == pytest.approx(0.8, abs=0.3) and out["trend"]["p_value"] < 0.01


def test_adjudication_and_difference_edges(spark):
    k = spark.createDataFrame([(1, 1, 0, 5), (2, 1, None, 5), (3, 1, 1, None), (4, None, None, 5), (5, 1, 1, 1), (1, 1, 0, 5)], "k int, a int, b int, n int")
    out = aggregate.adjudication_list(k, ["k"], "a", "b", {"short": F.col("n") < 3})
    assert sorted((r["k"], r["reasons"]) for r in out.collect()) == [(1, "coders disagree"), (1, "coders disagree"), (2, "one coder only"), (5, "short")]
    assert aggregate.adjudication_list(k.limit(0), ["k"], "a", "b").count() == 0
    same = spark.createDataFrame([(1, 2.0, 1), (1, 3.0, 2), (None, 9.0, 1)], "m int, y double, c int")
    assert tuple(estimate.group_difference(same, "m", ["y"], "c").first())[:4] == ("y", None, None, 2)
    with pytest.raises(ValueError, match="main cell"):
        estimate.sensitivity_grid(same.withColumn("m", F.col("c")), "main", {"main": {"y": "y", "x": ["m"]}}, "m", fitted=9.0)


def test_shares_and_eras_edges(spark):
    v = spark.createDataFrame([(1, "a", 2.0), (1, "a", 2.0), (None, "b", None), (2, None, 5.0), (2, "a", 4.0)], "p int, g string, y double")
    row = estimate.variance_shares(v, "y", ["p", "g"]).first()
    assert row["n"] == 4 and row["r2_cells"] == pytest.approx(1) and row["r2_main"] == pytest.approx(1) and row["r2_first"] == pytest.approx(1 - 0.5 / 6.75)
    assert tuple(estimate.variance_shares(v.limit(0), "y", ["p", "g"]).first()) == (None, None, None, None, 0)
    out = aggregate.era_summary(v, "p", "y", {"one": (1, 1), "from": (2, None), "none": (9, None), "all": (None, None)})
    assert sorted(map(tuple, out.collect())) == [("all", 4, 3.25, 2.0, 5.0), ("from", 2, 4.5, 4.0, 5.0), ("one", 2, 2.0, 2.0, 2.0)]
    assert aggregate.era_summary(v.limit(0), "p", "y", {"all": (None, None)}).count() == 0
