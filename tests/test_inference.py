"""Estimators against plain numpy versions, on planted data and at their edges."""

import math
import random

import numpy as np
import pytest
from panelkit.functions.strings import _jaro_winkler
from panelkit.operators import estimate, joins, latent, linkage


def net(v, g):
    return v - np.array([v[g == i].mean() for i in g])


def test_corrections(spark):
    """Effects nested in clusters count as one level; two-way errors take the smaller number of clusters throughout."""
    rng = np.random.default_rng(1)
    unit = rng.integers(0, 40, 500)
    cl, yr = unit // 5, rng.integers(0, 6, 500)
    x = rng.normal(size=500) + unit / 9
    y = 2 * x + unit + rng.normal(size=8)[cl] * x
    df = spark.createDataFrame([tuple(map(float, r[:2])) + tuple(map(int, r[2:])) for r in zip(y, x, unit, cl, yr, strict=True)], "y double, x double, unit int, cl int, yr int")
    a, b = net(x, unit), net(y, unit)
    beta = a @ b / (a @ a)
    e = b - beta * a

    def meat(*by):
        keys = list(zip(*by, strict=True))
        sums = {}
        for k, s in zip(keys, a * e, strict=True):
            sums[k] = sums.get(k, 0) + s
        return sum(s * s for s in sums.values()) / (a @ a) ** 2

    one = estimate.ols_fe(df, "y", ["x"], ["unit"], "cl").first()
    assert one.std_error == pytest.approx(math.sqrt(8 / 7 * 499 / (500 - 2) * meat(cl)))
    free = estimate.ols_fe(df, "y", ["x"], ["unit"], "yr").first()
    assert free.std_error == pytest.approx(math.sqrt(6 / 5 * 499 / (500 - 1 - 40) * meat(yr)))
    two = estimate.ols_fe(df, "y", ["x"], ["unit"], ["cl", "yr"]).first()
    assert two.std_error == pytest.approx(math.sqrt(6 / 5 * 499 / (500 - 2) * (meat(cl) + meat(yr) - meat(cl, yr)))) and two.n_clusters == 6


def plain_wild(y, x, z, g, null, weights):
    """t of the data and of each draw, the model fitted anew each time."""
    d = np.column_stack([np.ones(len(y)), z, x])
    at = d.shape[1] - 1
    inverse = np.linalg.inv(d.T @ d)
    groups = np.unique(g)

    def t_of(out, r):
        b = inverse @ d.T @ out
        e = out - d @ b
        s = np.array([d[g == i].T @ e[g == i] for i in groups])
        return (b[at] - r) / math.sqrt((inverse @ s.T @ s @ inverse)[at, at])

    small = d[:, :at]
    b0 = np.linalg.lstsq(small, y - null * x, rcond=None)[0]
    fitted = small @ b0 + null * x
    u = y - fitted
    return t_of(y, null), np.array([t_of(fitted + w[np.searchsorted(groups, g)] * u, null) for w in weights])


def test_wild_bootstrap(spark):
    rng = np.random.default_rng(3)
    g = rng.integers(0, 9, 150)
    x, z = rng.normal(size=150) + g / 5, rng.normal(size=150)
    y = 1 + 0.3 * x - z + rng.normal(size=9)[g] + rng.normal(size=150)
    df = spark.createDataFrame([(float(a), float(b), float(c), int(i)) for a, b, c, i in zip(y, x, z, g, strict=True)], "y double, x double, z double, g int")
    got = estimate.bootstrap_wild_cluster(df, "y", ["x", "z"], "x", "g", replicates=399).first()
    keys = np.array([r[0] for r in spark.createDataFrame([(int(i),) for i in np.unique(g)], "g int").selectExpr("xxhash64(g)").collect()])
    weights = [estimate._webb(keys, r, 1) for r in range(1, 400)]
    assert {round(float(w), 6) for w in np.concatenate(weights)} == {round(w, 6) for w in estimate.WEBB}

    def p(null):
        own, draws = plain_wild(y, x, z, g, null, weights)
        return np.mean(np.abs(draws) >= abs(own) * (1 - 1e-12))

    assert got.boot_p == pytest.approx(p(0.0)) and got.n_clusters == 9
    assert got.ci_low < got.estimate < got.ci_high
    width = got.ci_high - got.ci_low
    for end, out in ((got.ci_low, -1), (got.ci_high, 1)):
        assert p(end + out * 1e-4 * width) < 0.05 <= p(end - out * 1e-4 * width)
    again = estimate.bootstrap_wild_cluster(df.repartition(4), "y", ["x", "z"], "x", "g", replicates=399).first()
    assert [again.boot_p, again.ci_low, again.ci_high] == pytest.approx([got.boot_p, got.ci_low, got.ci_high], abs=1e-8)
    one = estimate.bootstrap_wild_cluster(df.where("g = 1"), "y", ["x"], "x", "g", replicates=19).first()
    assert one.n_clusters == 1 and one.boot_p is None and one.ci_low is None


def test_wild_bootstrap_with_effects(spark):
    """Effects across and inside the clusters, as dummies of both."""
    rng = np.random.default_rng(4)
    unit = rng.integers(0, 16, 200)
    g, yr = unit // 2, rng.integers(0, 4, 200)
    x = rng.normal(size=200) + yr
    y = 0.4 * x + unit / 4 + yr + rng.normal(size=8)[g] * x / 3 + rng.normal(size=200)
    df = spark.createDataFrame([(float(a), float(b), int(u), int(i), int(t)) for a, b, u, i, t in zip(y, x, unit, g, yr, strict=True)], "y double, x double, unit int, g int, yr int")
    got = estimate.bootstrap_wild_cluster(df, "y", ["x"], "x", "g", ["unit", "yr"], replicates=199).first()
    keys = np.array([r[0] for r in spark.createDataFrame([(int(i),) for i in np.unique(g)], "g int").selectExpr("xxhash64(g)").collect()])
    z = np.column_stack([*[(unit == i) for i in range(1, 16)], *[(yr == i) for i in range(1, 4)]]).astype(float)
    own, draws = plain_wild(y, x, z, g, 0.0, [estimate._webb(keys, r, 1) for r in range(1, 200)])
    assert got.boot_p == pytest.approx(np.mean(np.abs(draws) >= abs(own) * (1 - 1e-12)))


def test_intervals_cover(spark):
    """Of 40 planted designs with a true slope of 1, about 95 in 100 intervals hold it."""
    rng, held = np.random.default_rng(8), 0
    for _ in range(40):
        g = np.repeat(np.arange(12), 8)
        x = rng.normal(size=96) + rng.normal(size=12)[g]
        y = x + rng.normal(size=12)[g] + rng.normal(size=96)
        xs, ys = x - x.mean(), y - y.mean()
        sxx = xs @ xs
        inverse = np.array([[1 / sxx]])
        h = np.array([xs[g == i] @ xs[g == i] for i in range(12)])
        s0, s1 = np.array([xs[g == i] @ ys[g == i] for i in range(12)]), h
        z, q0, q1 = h / sxx, s0 / sxx, s1 / sxx
        w = np.vstack([np.ones(12), rng.choice(estimate.WEBB, (499, 12))])
        sums = np.column_stack([w @ s0, w @ s1, w @ (q0 * z), w @ (q1 * z), w**2 @ (q0 * q0), w**2 @ (q0 * q1), w**2 @ (q1 * q1)])
        draws = estimate.WildDraws(inverse, 0, sums, np.array([[z @ z]]))
        beta = xs @ ys / sxx
        held += draws.end(beta, -0.1, 0.05) <= 1 <= draws.end(beta, 0.1, 0.05)
    assert 33 <= held <= 40


def plain_em(x, like, w, k, rounds, start=None):
    """EM with one covariate and no penalty: each level's prior is its mean posterior."""
    prior = {v: np.full(k, 1 / k) if start is None else np.array(start) for v in set(x)}
    for _ in range(rounds + (start is not None)):
        new = {}
        for v in prior:
            p = like[x == v] * prior[v]
            p = p / p.sum(axis=1, keepdims=True)
            new[v] = (w[x == v][:, None] * p).sum(axis=0) / w[x == v].sum()
        prior = new
    return prior


@pytest.mark.parametrize("start", [None, [0.6, 0.3, 0.1]])
def test_em_with_continuous_likelihoods(spark, start):
    rng = np.random.default_rng(5)
    x, like, w = rng.integers(0, 3, 400), rng.random((400, 3)) + 0.01, rng.integers(1, 4, 400).astype(float)
    rows = [(int(a), b.tolist(), float(c), "t") for a, b, c in zip(x, like, w, strict=True)] + [(None, [1.0, 1.0, 1.0], 1.0, "t"), (1, None, 1.0, "t")]
    df = spark.createDataFrame(rows, "x int, l array<double>, n double, cell string").repartition(3)
    out, _, path = latent.em_prior_fit(df, ["x"], "l", 3, "n", penalty=0.0, tolerance=0.0, rounds=6, start=start)
    want = plain_em(x, like, w, 3, 6, start)
    for r in out.where("prior IS NOT NULL").select("x", "prior").distinct().collect():
        assert r.prior == pytest.approx(want[r.x], abs=1e-7)
    assert all(b >= a - 1e-9 for a, b in zip(path, path[1:], strict=False)) and len(path) == 6
    assert out.count() == 402 and out.where("x IS NULL AND prior IS NULL").count() == 1 and out.columns == [*df.columns, "prior", "posterior"]


def test_em_on_an_empty_table(spark):
    out, gamma, path = latent.em_prior_fit(spark.createDataFrame([], "x int, l array<double>"), ["x"], "l", 2)
    assert out.count() == 0 and path == [] and gamma.shape == (1, 1)


def test_logit_with_levels(spark):
    rng = np.random.default_rng(2)
    g = rng.integers(0, 12, 700)
    x1, x2 = rng.normal(size=700), rng.normal(size=700)
    y = (rng.random(700) < 1 / (1 + np.exp(-(0.8 * x1 - 0.5 * x2 + rng.normal(size=12)[g])))).astype(float)
    y[g == 11] = 1.0  # tells nothing
    rows = [(float(a), float(b), float(c), int(i), int(i) // 3, float(2 * b)) for a, b, c, i in zip(y, x1, x2, g, strict=True)]
    df = spark.createDataFrame(rows, "y double, x1 double, x2 double, g int, cl int, twice double")
    got = {r.term: r for r in estimate.logit_fe_ame(df, "y", ["x1", "x2", "twice"], "g", "cl").collect()}
    use = g != 11
    d = np.column_stack([x1, x2, *[(g == i) for i in range(11)]]).astype(float)[use]
    b = np.zeros(d.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-d @ b))
        h = (d * (p * (1 - p))[:, None]).T @ d
        b = b + np.linalg.solve(h, d.T @ (y[use] - p))
    inverse, cl = np.linalg.inv(h), g[use] // 3
    meat = sum(np.outer(s, s) for s in (d[cl == i].T @ (y[use] - p)[cl == i] for i in np.unique(cl)))
    v = 4 / 3 * (use.sum() - 1) / (use.sum() - 3) * inverse @ meat @ inverse
    for i, t in enumerate(("x1", "x2")):
        assert got[t].estimate == pytest.approx(b[i], abs=1e-8) and got[t].std_error == pytest.approx(math.sqrt(v[i, i]), rel=1e-6)
        assert got[t].average_effect == pytest.approx(b[i] * np.mean(p * (1 - p))) and got[t].n == use.sum() and got[t].n_levels == 11 and got[t].n_separated == (~use).sum()
    assert got["twice"].estimate is None
    plain = {r.term: r.estimate for r in estimate.logit_fe_ame(df, "y", ["x1"]).collect()}
    assert set(plain) == {"(Intercept)", "x1"} and plain["x1"] > 0.3


def test_logit_edges(spark):
    kind = "y double, x double, g int"
    none = estimate.logit_fe_ame(spark.createDataFrame([], kind), "y", ["x"], "g").collect()
    assert [(r.term, r.estimate, r.n) for r in none] == [("x", None, 0)]
    apart = spark.createDataFrame([(float(i > 20), float(i), i % 3) for i in range(40)], kind)
    assert estimate.logit_fe_ame(apart, "y", ["x"], "g").first().estimate is None
    assert [tuple(r) for r in estimate.gelbach_decompose(spark.createDataFrame([], kind), "y", "x", {"b": ["g"]}).collect()] == [("base", None), ("full", None), ("b", None)]


def test_many_levels(spark):
    """Intercepts of 4000 levels, and the slope that made the data."""
    rng = np.random.default_rng(7)
    g = np.repeat(np.arange(4000), 8)
    x = rng.normal(size=len(g))
    y = (rng.random(len(g)) < 1 / (1 + np.exp(-x - rng.normal(size=4000)[g]))).astype(float)
    df = spark.createDataFrame([(float(a), float(b), int(i)) for a, b, i in zip(y, x, g, strict=True)], "y double, x double, g int")
    r = estimate.logit_fe_ame(df, "y", ["x"], "g").first()
    # Eight rows a level: the known upward drift of joint maximum likelihood is about 8 / 7.
    assert 1.0 < r.estimate < 1.3 and r.n_levels > 3500


def test_rows_are_kept(spark):
    """Repeated base rows and windows come back as often as they were given."""
    base = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("a", 5, "x"), (None, 5, "y"), ("b", None, "z"), ("b", None, "z")], "k string, t int, holder string")
    fixes = spark.createDataFrame([("a", 0, 2, "f"), ("a", 0, None, "e")], "k string, after int, until int, new_holder string")
    brackets = spark.createDataFrame([("a", 3, 5, "n"), (None, 0, 1, "w")], "k string, seen_old int, seen_new int, next_holder string")
    out = linkage.override_timeline(base, ["k"], "t", "holder", fixes, brackets).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, [("a", 1, "x", "f", "correction", 0)] * 2 + [("a", 5, "x", "e", "correction", 0), (None, 5, "y", "y", "base", 0)] + [("b", None, "z", "z", "base", 0)] * 2))
    assert linkage.override_timeline(base, ["k"], "t", "holder", fixes.limit(0), brackets).where("holder_final = 'n'").count() == 1

    rng = random.Random(1)
    wins = [(rng.choice(["a", "b", None]), rng.choice([None, *range(10)]), rng.choice([None, *range(12)]), 1) for _ in range(80)] * 2
    cands = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(12)]), rng.choice(["s", "w", None]), rng.choice(["p", "q"])) for _ in range(40)]

    def plain(k, lo, hi):
        inside = [c for c in cands if k is not None and c[0] == k and c[1] is not None and hi is not None and c[1] <= hi and (lo is None or c[1] > lo)]
        if not inside:
            return (None, None, 0, None)
        best = min(inside, key=lambda c: (c[2] != "s", c[1] if lo is not None else -c[1], c[3], c[2] is not None, c[2] or ""))
        return (best[1], best[2], len({c[1] for c in inside}), best[3])

    w = spark.createDataFrame(wins, "k string, lo int, hi int, _t int")
    c = spark.createDataFrame(cands, "k string, d int, kind string, q string")
    got = joins.pick_in_window(w, c, ["k"], "d", "lo", "hi", "kind", "s", "q").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((*x, *plain(*x[:3]))) for x in wins)
    assert joins.pick_in_window(w, c.limit(0), ["k"], "d", "lo", "hi", "kind", "s", "q").where("n_dates = 0 AND quote IS NULL").count() == len(wins)


def test_fuzzy_keys_are_complete(spark):
    """No pair of a block that the similarity links is lost by its keys, over random names of few letters."""
    rng = random.Random(12)
    names = ["".join(rng.choice("abcdemr") for _ in range(rng.randint(1, 9))) for _ in range(150)] + ["martha", "marhta", "dwayne", "duane", "dixon", "dicksonx", "aa", "aaa", "", "a"]
    a = [(i, n, "k") for i, n in enumerate(names)] + [(900, None, "k"), (901, "martha", None)]
    df = spark.createDataFrame(a, "x int, n string, k string")
    for least in (0.75, 0.85, 0.95):
        got = {(r.x, r.y): r.how for r in linkage.block_fuzzy_pairs(df, df.withColumnRenamed("x", "y"), "k", "n", "x", "y", 3, least).collect()}
        want = {}
        for i, m in enumerate(names):
            for j, n in enumerate(names):
                if m == n:
                    want[i, j] = "exact"
                elif min(len(m), len(n)) >= 3 and (m.startswith(n) or n.startswith(m)):
                    want[i, j] = "prefix"
                elif _jaro_winkler(m, n) >= least:
                    want[i, j] = "similar"
        assert got == want


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 100, 257])
def test_permuted_is_a_bijection(n):
    at, size, key = np.arange(n), np.full(n, n), np.full(n, -5)
    seen = {tuple(estimate.permuted(at, size, key, r, 1).tolist()) for r in range(60)}
    assert all(sorted(p) == list(range(n)) for p in seen) and len(seen) >= min(math.factorial(min(n, 5)), 20) * 0.8
    if n == 3:
        first = [estimate.permuted(at, size, key, r, 1)[0] for r in range(3000)]
        assert all(900 < first.count(i) < 1100 for i in range(3))


@pytest.mark.parametrize("block", [8, 1 << 17])
def test_permutation_equals_a_plain_one(spark, block):
    rng = np.random.default_rng(6)
    s = np.where(rng.random(120) < 0.6, 0, rng.integers(1, 9, 120))
    x = rng.normal(size=120)
    y = 0.15 * x + s + rng.normal(size=120)
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, (a, b, c) in enumerate(zip(y, x, s, strict=True))] + [(None, 1.0, 1.0, 1), (500, None, 1.0, 1)], "id int, y double, x double, s int")
    got = estimate.permute_within_strata(df.repartition(3), "id", "y", "x", "s", 99, 1, block).first()
    a, b = net(x, s), net(y, s)
    hashes = {r.s: r.h for r in df.selectExpr("s", "xxhash64(s) AS h").distinct().collect()}
    extreme = 0
    for r in range(1, 100):
        total = 0.0
        for v in np.unique(s):
            own = np.flatnonzero(s == v)
            to = estimate.permuted(np.arange(len(own)), np.full(len(own), len(own)), np.full(len(own), hashes[v]), r, 1)
            total += b[own] @ a[own[to]]
        extreme += abs(total) >= abs(a @ b) * (1 - 1e-12)
    assert got.n_extreme == extreme and got.n_draws == 99 and got.slope == pytest.approx(a @ b / (a @ a)) and got.p_value == (1 + extreme) / 100
    none = estimate.permute_within_strata(df.limit(0), "id", "y", "x", "s", 9).first()
    assert none.slope is None and none.p_value is None and none.n_draws == 0


def plain_lists(left, right):
    rest, out, n = list(right), [], 0
    for e in left:
        fits = [r for r in rest if r[2] == e[2]] or [r for r in rest if r[2].split()[-1] == e[2].split()[-1]]
        if len(fits) == 1:
            n += 1
            rest.remove(fits[0])
            out.append((n, e[2], fits[0][2], "exact" if fits[0][2] == e[2] else "surname", None))
        else:
            how = "ambiguous" if fits else "left_only"
            out.append((None, e[2], None, how, "ambiguous" if fits else None if n else "first unmatched"))
    return out + [(None, None, r[2], "right_only", "not listed") for r in rest]


def test_ordered_lists(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    people = ["ann lee", "bob lee", "cy ray", "di fox", "al fox", "ed poe"]
    left, right = ([(rng.choice([1, 2, 3, 4, None]), i, rng.choice(people)) for i in range(20)] for _ in range(2))
    right.append((9, 0, "ed poe"))
    frames = [spark.createDataFrame(x, "k int, pos int, who string") for x in (left, right)]
    surname = F.element_at(F.split("who", " "), -1)
    got = linkage.match_ordered(*frames, ["k"], "pos", F.col("who"), surname)
    rows = [(r.k, r.place, r.left_row and r.left_row.who, r.right_row and r.right_row.who, r.how, r.problem) for r in got.collect()]
    want = [(k, *row) for k in {1, 2, 3, 4, None, 9} for row in plain_lists(*(sorted([e for e in x if e[0] == k], key=lambda e: e[1]) for x in (left, right)))]
    assert sorted(map(str, rows)) == sorted(map(str, want))
    with pytest.raises(Exception, match="lists don't match"):
        linkage.match_ordered(*frames, ["k"], "pos", F.col("who"), surname, strict=True).collect()
    assert linkage.match_ordered(frames[0].limit(0), frames[1].limit(0), ["k"], "pos", F.col("who"), surname).count() == 0
