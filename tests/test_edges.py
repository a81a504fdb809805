"""Nulls, ties, repeated rows, empty tables and clashing names of the panel operators."""

import math

import numpy as np
import pytest
from panelkit.functions import fold_accents, jaro_winkler, lgamma, normalize_name_key
from panelkit.operators import aggregate, columns, estimate, evidence, joins, latent, linkage, panel, quality, spells
from pyspark.sql import functions as F


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def make(spark):
    return lambda data, schema: spark.createDataFrame(data, schema)


def test_asof_nulls_ties_and_names(make):
    left = make([(1, 5), (1, None), (None, 5), (2, 5), (1, 0), (1, 5)], "k int, t int")
    right = make([(1, None, 9), (1, 5, 3), (1, 5, 4), (None, 5, 7), (1, 2, 1)], "k int, rt int, v int")
    out = joins.join_asof_backward(left, right, ["k"], "t", "rt", ["v"])
    assert rows(out) == sorted([(1, 5, 5, 4), (1, 5, 5, 4), (1, None, None, None), (None, 5, None, None), (2, 5, None, None), (1, 0, None, None)], key=str)
    with pytest.raises(ValueError, match="already there"):
        joins.join_asof_backward(left.withColumn("v", F.lit(1)), right, ["k"], "t", "rt", ["v"])
    assert joins.join_asof_backward(left.limit(0), right, ["k"], "t", "rt", ["v"]).count() == 0
    assert rows(joins.join_asof_backward(left, right.limit(0), ["k"], "t", "rt", ["v"]).select("v").distinct()) == [(None,)]


def test_mirror_and_unique_pairs(make):
    m = make([(1, 0, 5), (1, 1, 6), (None, 0, 1), (None, 1, 2), (2, 0, 7), (3, 0, 8), (3, 1, 9), (3, 1, 10)], "k int, side int, v int")
    assert rows(joins.join_mirror_self(m, "k", "side", ["v"])) == sorted([(1, 0, 5, 6), (1, 1, 6, 5), (None, 0, 1, None), (None, 1, 2, None), (2, 0, 7, None), (3, 0, 8, None), (3, 1, 9, 8), (3, 1, 10, 8)], key=str)
    p = make([(1, 1), (1, 1), (2, 2), (2, 3), (None, 4), (5, None)], "a int, b int")
    assert rows(joins.unique_both_sides(p, "a", "b")) == [(1, 1)]


def test_contracts_and_not_in(make):
    l, r = make([(1,), (1,), (None,)], "k int"), make([(1, 2), (None, 3), (None, 4)], "k int, v int")
    assert rows(joins.join_validated(l, r, ["k"])) == [(1, 2), (1, 2), (None, None)]
    with pytest.raises(ValueError, match="left side"):
        joins.join_validated(l, r, ["k"], validate="1:1")
    assert rows(joins.anti(l, r, ["k"])) == [(None,)] and joins.not_in(l, r, "k").count() == 0 and joins.not_in(l, r.limit(0), "k").count() == 3
    assert rows(joins.join_null_safe(l.toDF("a"), r, [("a", "k")])) == [(1, 1, 2), (1, 1, 2), (None, None, 3), (None, None, 4)]


def test_links(make):
    links = make([(1, 7, 1, 3), (2, 7, 1, 2), (3, 8, 1, 1), (4, 8, 1, 1), (5, None, 0, 0), (6, 9, None, None)], "row int, id int, s int, gap int")
    out = {r["row"]: r["id"] for r in joins.resolve_shared_link(links, "row", "id", [("s", True), ("gap", False)]).collect()}
    assert out == {1: None, 2: 7, 3: None, 4: None, 5: None, 6: 9}
    c = make([(1, 10, 2, True, [2001, 2002]), (1, 11, 1, False, [2001]), (2, 12, 1, True, [2001]), (2, 13, 1, True, [2002, 2003]), (3, 14, 1, True, [2001]), (3, 15, 1, True, [2001]), (4, 16, 1, False, []), (5, 16, 1, True, [1999])], "a int, b int, tier int, exact boolean, seasons array<int>")
    assert {(r.a, r.b) for r in linkage.link_tiered(c).collect()} == {(1, 11), (2, 12), (2, 13)}
    assert linkage.link_tiered(c.limit(0)).count() == 0
    two = make([("jon", "x", 1), ("jonathan", "x", 2), ("mark", "x", 3), ("marc", "x", 4), (None, "x", 5), ("jon", None, 6)], "first string, k string, id int")
    got = {(r.i, r.j): r.how for r in linkage.block_fuzzy_pairs(two.withColumnRenamed("id", "i"), two.withColumnRenamed("id", "j"), "k", "first", "i", "j").collect()}
    assert got[1, 2] == "prefix" and got[3, 4] == "similar" and got[1, 1] == "exact" and (5, 5) not in got and (1, 3) not in got


def test_periods(make):
    p = make([(1, 1, 5), (1, 2, None), (1, 4, 7)], "k int, t int, v int")
    assert rows(panel.lag_consecutive(p, ["k"], "t", "v", "b")) == [(1, 1, 5, None), (1, 2, None, 5), (1, 4, 7, None)]
    with pytest.raises(ValueError, match="already there"):
        panel.runs_islands(p.withColumn("run_id", F.lit(1)), ["k"], "t")
    assert rows(panel.runs_islands(p.withColumn("_new", F.lit(0)), ["k"], "t").select("t", "run_id", "_new")) == [(1, 1, 0), (2, 1, 0), (4, 2, 0)]
    s = make([(None, 1998), (1997, None), (1990, 1996), (1999, 1998)], "a int, b int")
    assert rows(panel.expand_spans(s, "a", "b", 1996, 1998, "y").select("a", "y")) == [(1990, 1996), (1997, 1997), (1997, 1998)]
    d = make([(None, 1, "x"), (None, 1, "x"), (1, 2, "y"), (1, 1, "z")], "k int, o int, v string")
    assert rows(panel.dedupe_priority(d, ["k"], [F.col("o")])) == [(1, 1, "z", 2), (None, 1, "x", 2)]
    assert panel.dedupe_priority(d.limit(0), ["k"], [F.col("o")]).count() == 0


def test_spells(make):
    snaps, listed = make([("u", i) for i in (1, 3, 4, 9)], "u string, t int"), make([("u", 1, "a", "r"), ("u", 3, "a", "r"), ("u", 9, "a", "r"), ("u", 3, "a", "r"), ("u", 5, "a", "r")], "u string, t int, p string, role string")
    got = {(r.first_seen, r.last_seen, r.entry_lower, r.exit_upper, r.left_censored, r.right_censored) for r in spells.spells_interval_censored(snaps, listed, "u", "t", "p", "role").collect()}
    assert got == {(1, 3, None, 4, 1, 0), (9, 9, 4, None, 0, 1)}
    c = make([(1, 1, 2000, 3, False), (1, 2, 2001, 2, True), (1, 3, 2002, None, True), (1, 4, 2003, 1, True), (None, 5, 2000, 1, True), (2, 6, None, 1, True)], "k int, id int, signed int, years int, ext boolean")
    assert {r.id: r.eff_start for r in spells.effective_start_recurrence(c, ["k"], ["id"], "signed", "years", "ext").collect()} == {1: 2000, 2: 2003, 3: 2004, 4: 2003, 5: 2000, 6: None}
    e = make([(1, 1), (1, 2), (1, 2), (1, 3), (2, 5)], "k int, t int")
    assert [r.state for r in spells.order_events_strict(e, "k", "t").orderBy("k", "t").collect()] == ["ordered", "ambiguous", "ambiguous", "after_ambiguous", "ordered"]
    r = make([(1, 1, 1, ["a"], 0), (1, 2, 0, ["a"], 1), (2, 1, 1, None, 0), (3, 3, 1, ["b"], 0)], "k int, t int, held int, owners array<string>, amb int")
    got = {(x.k, x.t): (x.retained, x.same_owner, x.observed, x.retained_ambiguous_as_exit) for x in spells.retention_outcomes(r, "k", "t", {"retained": "held"}, "owners", "amb", 3, []).collect()}
    assert got == {(1, 1): (None, None, 0, 0), (1, 2): (0, 0, 1, 0), (2, 1): (0, None, 1, 0), (3, 3): (None, None, 0, None)}


def test_aggregates(make):
    v = make([("a", 1, 2.0), ("a", 1, None), ("a", 2, 4.0), ("b", None, None)], "k string, x int, w double")
    assert rows(aggregate.agg_weighted(v, ["k"], ["x"], "w").select("k", "mean_x", "coverage_x")) == [("a", 10 / 6, 1.0), ("b", None, None)]
    assert rows(aggregate.agg_mode_tiebreak(v, ["k"], "x")) == [("a", 1, 2)]
    tie = make([("a", 3, 1), ("a", 2, 1), ("a", 2, 0), ("a", 3, 0)], "k string, x int, t int")
    assert rows(aggregate.agg_mode_tiebreak(tie, ["k"], "x", "t")) == [("a", 2, 2)]
    with pytest.raises(Exception, match="repeated"):
        aggregate.pivot_wide(tie, ["k"], "x", "t", [2, 3]).collect()
    assert rows(aggregate.diversity_index(make([("a", 1.0, 0.0), ("a", 0.0, 1.0), ("b", 1.0, 0.0), ("a", None, 1.0)], "k string, p double, q double"), ["k"], ["p", "q"])) == [("a", 2, 1.0), ("b", 1, None)]
    k = make([("x", "x"), ("x", "y"), ("y", "y"), (None, "y")], "a string, b string")
    assert rows(aggregate.agreement_kappa(k, "a", "b").select("n", "agreement")) == [(3, 2 / 3)]
    assert aggregate.agreement_kappa(make([("x", "x")], "a string, b string"), "a", "b").first()["kappa"] is None
    assert aggregate.topk_context_list(make([("e", "b"), ("e", "a"), ("e", "c")], "k string, t string"), ["k"], "t", [F.lit(1)], 2).first()["context"] == "a; b; +1 more"
    for empty in (aggregate.agg_weighted(v.limit(0), ["k"], ["x"], "w"), aggregate.percentile_score_cumulative(tie.limit(0), ["k"], "t", "x"), aggregate.agg_mode_tiebreak(v.limit(0), ["k"], "x")):
        assert empty.count() == 0


def test_columns(make):
    c = make([(1, 5.0), (2, None), (3, float("nan")), (4, 50.0)], "id int, x double")
    assert rows(columns.clean_range(c, {"x": (0, 10)})) == [(1, 5.0, 0), (2, None, 0), (3, None, 0), (4, None, 1)]
    assert [r[0] for r in c.orderBy("id").select(columns.bin_values(F.col("x"), [10], ["low", "high"])).collect()] == ["low", None, None, "high"]
    s = make([("A/B",), ("A",), ("Z/A",), (None,)], "c string")
    assert rows(columns.split_multi_code(s, "c", {"A": 1, "B": 2})) == sorted([("A/B", 2, [1, 2], None), ("A", 1, [1], 1), ("Z/A", 2, None, None), (None, None, None, None)], key=str)
    assert [r[0] for r in make([("6-2",), ("6'2",), (None,)], "h string").select(columns.parse_measure_string(F.col("h"))).collect()] == [74.0, None, None]
    a = make([("x", 1, 1999), ("X ", 2, None), ("y", 3, None)], "alias string, id int, valid_to int")
    m = make([(" x", 1998), ("X", 2000), ("x", None), ("q", 1990), (None, 1990)], "code string, t int")
    assert [r[0] for r in columns.map_codes_effective_dated(m, "code", a, "id", "t").orderBy(F.col("t").asc_nulls_last(), "code").select("id").collect()] == [None, None, 1, 2, 2]
    with pytest.raises(ValueError, match="unlisted"):
        columns.expand_dummies(s, "c", "A", ["A"])
    assert columns.fill_missing_flag(make([(1, None), (None, None)], "a int, b int"), ["a", "b"]).columns == ["a", "b", "a_miss"]


def test_functions(make):
    n = make([("José Núñez-Smith Jr.",), ("",), (None,)], "s string")
    assert [tuple(r) for r in n.select(normalize_name_key(F.col("s")), fold_accents(F.col("s"))).collect()] == [("josenunezsmith", "Jose Nunez-Smith Jr."), ("", ""), (None, None)]
    got = make([(x,) for x in (0.01, 0.5, 1.0, 3.7, 900.0)], "x double").select(lgamma(F.col("x"))).collect()
    assert np.allclose([r[0] for r in got], [math.lgamma(x) for x in (0.01, 0.5, 1.0, 3.7, 900.0)], rtol=1e-12, atol=1e-11)
    assert make([(-1.0,)], "x double").select(lgamma(F.col("x"))).first()[0] is None
    pairs = [("martha", "marhta", 0.9611111), ("dixon", "dicksonx", 0.8133333), ("", "", 1.0), ("a", "", 0.0), (None, "a", None)]
    for r, (*_, want) in zip(make([p[:2] for p in pairs], "a string, b string").select(jaro_winkler("a", "b").alias("s")).collect(), pairs, strict=True):
        assert r.s is None if want is None else abs(r.s - want) < 1e-6


def truth(n=400, seed=1):
    rng = np.random.default_rng(seed)
    g, h = rng.integers(0, 12, n), rng.integers(0, 9, n)
    x1, x2 = rng.normal(size=n) + 0.3 * g, rng.normal(size=n)
    y = 2.0 * x1 - 0.5 * x2 + g * 0.7 - h * 0.4 + rng.normal(size=n) * 0.1
    return y, x1, x2, g, h


def test_fixed_effects_match_dummies(make):
    y, x1, x2, g, h = truth()
    df = make([(float(a), float(b), float(c), int(d), int(e), float(2 * b + 1)) for a, b, c, d, e in zip(y, x1, x2, g, h, strict=True)] + [(None, 1.0, 1.0, 1, 1, 3.0)], "y double, x1 double, x2 double, g int, h int, copy double")
    design = np.column_stack([x1, x2, *[(g == i) for i in range(12)], *[(h == i) for i in range(1, 9)]]).astype(float)
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    e = y - design @ beta
    inverse = np.linalg.inv(design.T @ design)
    meat = sum(np.outer(s, s) for s in (design[g == i].T @ e[g == i] for i in range(12)))
    v = 12 / 11 * (len(y) - 1) / (len(y) - 2 - 20) * inverse @ meat @ inverse
    out = {r.term: r for r in estimate.ols_fe(df, "y", ["x1", "x2", "copy"], ["g", "h"], "g", count_nested=True).collect()}
    assert out["copy"].dropped == 1
    # The levels of g lie inside the clusters: by default they count as one.
    apart = {r.term: r.std_error for r in estimate.ols_fe(df, "y", ["x1", "x2"], ["g", "h"], "g").collect()}
    assert abs(apart["x1"] - out["x1"].std_error * np.sqrt((len(y) - 2 - 20) / (len(y) - 2 - 9))) < 1e-8
    for i, t in enumerate(("x1", "x2")):
        assert abs(out[t].estimate - beta[i]) < 1e-8 and abs(out[t].std_error - np.sqrt(v[i, i])) < 1e-8 and out[t].n == 400 and out[t].n_clusters == 12


def test_inference_helpers(make):
    assert abs(estimate.t_p_value(2.0, 10) - 0.0733880) < 1e-6 and abs(estimate.f_p_value(4.0, 1, 10) - estimate.t_p_value(2.0, 10)) < 1e-12
    y, x1, x2, g, h = truth()
    df = make([(float(a), float(b), int(c), int(i)) for i, (a, b, c) in enumerate(zip(y, x1, g, strict=True))], "y double, x double, g int, id int")
    boot = {r.term: r for r in estimate.bootstrap_cluster(df, "y", ["x"], "g", 60).collect()}
    again = {r.term: r.boot_se for r in estimate.bootstrap_cluster(df.repartition(3), "y", ["x"], "g", 60).collect()}
    assert boot["x"].n_draws == 60 and boot["x"].boot_se > 0 and abs(again["x"] - boot["x"].boot_se) < 1e-9
    wild = estimate.bootstrap_wild_cluster(df, "y", ["x"], "x", "g", replicates=199).first()
    assert wild.boot_p < 0.05 and wild.n_draws == 199 and wild.n_clusters == 12
    none = df.withColumn("x", F.rand(3))
    assert estimate.bootstrap_wild_cluster(none, "y", ["x"], "x", "g", replicates=199).first().boot_p > 0.01
    perm = estimate.permute_within_strata(df, "id", "y", "x", "g", 99).first()
    assert perm.p_value == 0.01 and perm.n_draws == 99
    with pytest.raises(ValueError, match="incomplete"):
        estimate.common_sample(df.withColumn("z", F.when(F.col("id") > 50, 1)), [["z"]])
    s = make([(1, 1), (1, 2), (2, 2), (3, 3), (3, 3)], "a int, b int")
    assert rows(estimate.drop_singletons(s, ["a", "b"])) == [(3, 3), (3, 3)]
    a = make([(0.1, 0), (0.4, 0), (0.4, 1), (0.9, 1), (None, 1)], "s double, y int")
    assert estimate.auc(estimate.auc_counts(a, "s", "y")).first()["auc"] == 0.875
    assert estimate.auc_bootstrap_ci(a, "s", "y", 50).first()["n_draws"] <= 50


def test_latent(make):
    shares, best = latent.smooth_shares_eb(make([("p", "u", 90), ("p", "v", 10), ("q", "u", 0), ("q", "v", 1)], "name string, c string, n int"), "name", "c", "n")
    assert abs(sum(r.share for r in shares.where("name = 'q'").collect()) - 1) < 1e-9 and best.first()["alpha"] > 0
    like = [[0.9, 0.1]] * 60 + [[0.2, 0.8]] * 40
    df = make([(i % 2, v) for i, v in enumerate(like)] + [(None, [1.0, 1.0])], "x int, l array<double>")
    out, _, path = latent.em_prior_fit(df, ["x"], "l", 2)
    assert all(b >= a - 1e-9 for a, b in zip(path, path[1:], strict=False)) and out.count() == 101 and out.where("prior IS NULL").count() == 1
    raked = latent.rake_to_margin(df.where("x IS NOT NULL").withColumn("g", F.lit(1)), "l", 0, ["g"], make([(1, 0.25)], "g int, target double"))
    assert abs(raked.agg(F.avg(F.col("raked")[0])).first()[0] - 0.25) < 1e-6
    rng = np.random.default_rng(0)
    z, x = rng.random(600) < 0.5, rng.normal(size=600)
    y = np.where(z, 1 + 2 * x, -1 - x) + 0.1 * rng.normal(size=600)
    m = make([(float(a), float(b), [0.7, 0.3] if c else [0.3, 0.7]) for a, b, c in zip(y, x, z, strict=True)], "y double, x double, p array<double>")
    _, fits = latent.mixture_regression_em(m, "y", ["x"], "p", 2)
    assert abs(fits[0]["beta"][1] - 2) < 0.05 and abs(fits[1]["beta"][1] + 1) < 0.05
    t = [(float(i), float(i % 2), float(i == 7), 0.0) for i in range(40)]
    t = make([(a, b, c, d, b, 1 - b, 3 + a + b * (2 + 0.5 * a)) for a, b, c, d in t], "a double, g double, lone double, zero double, p double, q double, y double")
    got = {r.a: r.contrast for r in latent.estimable_contrast(t, "y", ["a", "zero", "lone"], "p", "q").collect()}
    assert got[7.0] is None and all(abs(v - (2 + 0.5 * k)) < 1e-6 for k, v in got.items() if k != 7.0)


def test_texts_and_checks(make):
    d = make([(1, "Mr. Smith of Acme joined on May 3, 2004. He left. Acme, Inc. was never sold on May 4, 2004!"), (2, None), (3, "Acme joined on June 31, 2004.")], "id int, text string")
    out = evidence.extract_dated_statements(d, "id", "text", "joined|sold", "never", make([("Acme", 9)], "name string, entity_id int"), {"hire": "joined"}).collect()
    assert [(r.id, r.entity_id, str(r.date), r.kind) for r in out] == [(1, 9, "2004-05-03", "hire")]
    found = evidence.extract_candidate_sentences(d, "id", "text", {"left": "exit", "acme": "firm"}, ["firm"]).where("id = 1").orderBy("number").collect()
    assert [(r.number, r.terms, r.noisy_only) for r in found] == [(0, ["acme"], 1), (1, ["left"], 0), (2, ["acme"], 1)] and found[1].previous.startswith("Mr.") and found[0].previous is None
    k = make([(1, 1), (1, 1), (None, 2)], "a int, b int")
    assert tuple(quality.assert_unique_key(k, ["a", "b"]).first()) == (3, 1, 1) and tuple(quality.assert_unique_key(k.limit(0), ["a", "b"]).first()) == (0, 0, 0)
    assert tuple(quality.assert_recount(k.groupBy("b").count(), make([(1, 3)], "b int, count long"), ["b"], "count").first()) == (2, 1, 1, 1)
