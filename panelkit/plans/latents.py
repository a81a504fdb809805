"""Queries of latent-category proxies."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.operators import latent
from panelkit.plans import fixtures as fx
from panelkit.registry import query

t = fx.table
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("smooth_shares_eb", fx.with_fixtures("""WITH m AS (SELECT band, sum(n) AS m, sum(sum(n)) OVER () AS a FROM fx_shares GROUP BY 1), p AS (SELECT band, CAST(m AS DOUBLE) / a AS p FROM m), g AS (SELECT i, pow(10.0, -2 + i * 6.0 / 240) AS al FROM generate_series(0, 240) x(i)),
nt AS (SELECT p_brand, CAST(sum(n) AS DOUBLE) AS n FROM fx_shares GROUP BY 1),
l AS (SELECT g.i, g.al, (SELECT sum(lgamma(g.al) - lgamma(g.al + n)) FROM nt) + (SELECT sum(lgamma(g.al * p + n) - lgamma(g.al * p)) FROM fx_shares JOIN p USING (band) WHERE n > 0) AS ll FROM g), b AS (SELECT al FROM l ORDER BY ll DESC, i LIMIT 1)
SELECT p_brand, band, round((s.n + al * p) / (nt.n + al), 8) AS share, round(al, 6) AS alpha FROM fx_shares s JOIN p USING (band) JOIN nt USING (p_brand), b""", "fx_shares"))
def _(spark, d):
    shares, best = latent.smooth_shares_eb(fx.shares(spark, d), "p_brand", "band", "n")
    return shares.join(F.broadcast(best)).select("p_brand", "band", F.round("share", 8).alias("share"), F.round("alpha", 6).alias("alpha"))


def _segment(spark, d):
    return t(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("truth"), F.col("c_nationkey").cast("string").alias("nation"), F.floor(F.col("c_acctbal") / 2500).cast("int").cast("string").alias("band"))


def _factor(rows, key: str):
    """(key, P(category | key)) with one added to each count, and a catch-all row of the whole."""
    counts = [(F.count(F.when(F.col("truth") == s, 1)) + 1.0).alias(f"n{i}") for i, s in enumerate(SEGMENTS)]
    v = latent.normalised(F.array(*[f"n{i}" for i in range(len(SEGMENTS))]))
    each = rows.where("c_custkey % 2 = 0 AND c_custkey % 5 > 0").groupBy(F.col(key).alias("key")).agg(*counts)
    whole = rows.where("c_custkey % 2 = 0").agg(*counts).withColumn("key", F.lit("ALL OTHER"))
    return each.unionByName(whole).select("key", v.alias("probs"))


def _base(rows):
    """The marginal of the fitting half as a column of literals: five numbers."""
    counts = rows.where("c_custkey % 2 = 0").groupBy("truth").count().collect()
    by = {r["truth"]: r["count"] for r in counts}
    total = sum(by.values()) or 1
    return F.array(*[F.lit(by.get(s, 0) / total) for s in SEGMENTS])


def _posteriors(rows):
    kept = _factor(rows, "nation").where("key NOT IN ('3', '7')")
    return latent.posterior_naive_bayes(rows, _base(rows), [("nation", "nation", kept), ("band", "band", _factor(rows, "band"))], SEGMENTS)


def _sql_counts(key: str) -> str:
    cells = ", ".join(f"count(*) FILTER (truth = '{s}') + 1.0 AS n{i}" for i, s in enumerate(SEGMENTS))
    return f"SELECT {key} AS k, {cells} FROM s WHERE c_custkey % 2 = 0 AND c_custkey % 5 > 0 GROUP BY 1 UNION ALL SELECT 'ALL OTHER', {cells} FROM s WHERE c_custkey % 2 = 0"


_TOTAL = "(n0 + n1 + n2 + n3 + n4)"
POSTERIOR_SQL = f"""s AS (SELECT c_custkey, c_mktsegment AS truth, CAST(c_nationkey AS VARCHAR) AS nation, CAST(CAST(floor(c_acctbal / 2500) AS INT) AS VARCHAR) AS band FROM customer),
fn AS (SELECT k, {", ".join(f"CAST(n{i} AS DOUBLE) / {_TOTAL} AS a{i}" for i in range(5))} FROM ({_sql_counts("nation")})), fb AS (SELECT k, {", ".join(f"CAST(n{i} AS DOUBLE) / {_TOTAL} AS b{i}" for i in range(5))} FROM ({_sql_counts("band")})),
ba AS (SELECT {", ".join(f"CAST(count(*) FILTER (truth = '{s}') AS DOUBLE) / count(*) AS m{i}" for i, s in enumerate(SEGMENTS))} FROM s WHERE c_custkey % 2 = 0),
j AS (SELECT s.*, {", ".join(f"a{i} * b{i} / m{i} AS w{i}" for i in range(5))} FROM s JOIN fn ON fn.k = CASE WHEN nation IN (SELECT k FROM fn WHERE k NOT IN ('3', '7')) THEN nation ELSE 'ALL OTHER' END JOIN fb ON fb.k = CASE WHEN band IN (SELECT k FROM fb) THEN band ELSE 'ALL OTHER' END, ba),
po AS (SELECT c_custkey, truth, nation, band, {", ".join(f"w{i} / (w0 + w1 + w2 + w3 + w4) AS p{i}" for i in range(5))} FROM j)"""


@query("posterior_naive_bayes", f"""WITH {POSTERIOR_SQL} SELECT c_custkey, {", ".join(f"round(p{i}, 9) AS p{i}" for i in range(5))}, 'nation+band' AS method FROM po""")
def _(spark, d):
    out = _posteriors(_segment(spark, d))
    return out.select("c_custkey", *[F.round(F.col("posterior")[i], 9).alias(f"p{i}") for i in range(5)], "method")


@query("likelihood_from_posterior", f"""WITH {POSTERIOR_SQL}, q AS (SELECT c_custkey, {", ".join(f"p{i} / m{i} * CASE WHEN nation < '2' THEN {f} ELSE 1 END AS l{i}" if i != 2 else f"1.0 * CASE WHEN nation < '2' THEN {f} ELSE 1 END AS l{i}" for i, f in enumerate((2.0, 1.0, 0.5, 1.0, 1.5)))} FROM po, ba)
SELECT c_custkey, {", ".join(f"round(CASE WHEN c_custkey % 7 = 0 THEN 1.0 ELSE l{i} / greatest(l0, l1, l2, l3, l4) END, 9) AS l{i}" for i in range(5))} FROM q""")
def _(spark, d):
    rows = _segment(spark, d)
    post = _posteriors(rows).withColumn("posterior", F.when(F.col("c_custkey") % 7 > 0, F.col("posterior"))).withColumn("level", F.when(F.col("nation") < "2", "near"))
    post = post.withColumn("near", F.array(*[F.lit(x) for x in (2.0, 1.0, 0.5, 1.0, 1.5)]))
    out = latent.likelihood_from_posterior(post, "posterior", _base(rows), [2], "level", {"near": "near"})
    return out.select("c_custkey", *[F.round(F.col("likelihood")[i], 9).alias(f"l{i}") for i in range(5)])


def _evidence(spark, d):
    """Customers with likelihoods of segments from their balance band, and covariates."""
    rows = _segment(spark, d)
    table = _factor(rows, "band").where("key <> 'ALL OTHER'").select(F.col("key").alias("band"), latent.over(F.col("probs"), _base(rows)).alias("like"))
    return rows.join(F.broadcast(table), "band").withColumn("region", F.col("nation").cast("int") % 5).withColumn("half", F.col("c_custkey") % 2)


def _em_sql(rows: str, cell: str, rounds: int) -> str:
    """(cell, q0..q4): a prior per cell after so many rounds of plain EM from equal shares; with one covariate and no penalty the M-step is the mean posterior."""
    w = [f"q{i} * e.l{i}" for i in range(5)]
    total = f"({' + '.join(w)})"
    return f"""(WITH RECURSIVE em AS (SELECT 0 AS i, {cell}, {", ".join(f"CAST(0.2 AS DOUBLE) AS q{i}" for i in range(5))} FROM {rows} GROUP BY {cell}
UNION ALL SELECT em.i + 1, e.{cell}, {", ".join(f"avg({x} / {total})" for x in w)} FROM em JOIN {rows} e ON e.{cell} = em.{cell} WHERE em.i < {rounds} GROUP BY em.i, e.{cell}) SELECT * FROM em WHERE i = {rounds})"""


_EVIDENCE_SQL = f"""{POSTERIOR_SQL}, e AS (SELECT c_custkey, CAST(nation AS INT) % 5 AS region, {", ".join(f"b{i} / m{i} AS l{i}" for i in range(5))} FROM s JOIN fb ON fb.k = band AND fb.k <> 'ALL OTHER', ba),
h AS (SELECT c_custkey, region, {", ".join(f"sqrt(l{i}) AS l{i}" for i in range(5))} FROM e)"""
EM_ROUNDS = 12


def _posterior_sql(rows: str, cell: str) -> str:
    total = " + ".join(f"q{i} * l{i}" for i in range(5))
    return f"""(SELECT c_custkey, {rows}.{cell}, {", ".join(f"q{i}" for i in range(5))}, {", ".join(f"q{i} * l{i} / ({total}) AS p{i}" for i in range(5))}, ln({total}) AS ll FROM {rows} JOIN {_em_sql(rows, cell, EM_ROUNDS)} g ON g.{cell} = {rows}.{cell})"""


@query("em_prior_fit", f"""WITH {_EVIDENCE_SQL}, f AS {_posterior_sql("e", "region")}
SELECT region, count(*) AS n, {", ".join(f"round(avg(q{i}), 7) AS prior{i}, round(avg(p{i}), 7) AS posterior{i}" for i in range(5))}, round((SELECT sum(ll) FROM f), 4) AS log_likelihood FROM f GROUP BY region""")
def _(spark, d):
    """Mean fitted prior and posterior per covariate cell after a stated number of rounds, and the log likelihood of that prior."""
    out, _, _ = latent.em_prior_fit(_evidence(spark, d), ["region"], "like", 5, penalty=0.0, tolerance=0.0, rounds=EM_ROUNDS)
    told = F.log(F.aggregate(latent.times(F.col("prior"), F.col("like")), F.lit(0.0), lambda a, x: a + x))
    cells = [F.round(F.avg(F.col(c)[i]), 7).alias(f"{c}{i}") for c in ("prior", "posterior") for i in range(5)]
    by = out.groupBy("region").agg(F.count("*").alias("n"), *cells, F.sum(told).alias("_ll"))
    return by.join(F.broadcast(by.agg(F.round(F.sum("_ll"), 4).alias("log_likelihood")))).drop("_ll")


@query("em_variants", f"""WITH {_EVIDENCE_SQL}, x AS {_posterior_sql("e", "region")}, y AS {_posterior_sql("h", "region")}, o AS (SELECT c_custkey, {", ".join(f"CASE WHEN c_custkey % 10 = 0 THEN CAST({int(i == 1)} AS DOUBLE) ELSE x.p{i} END AS x{i}, CASE WHEN c_custkey % 10 = 0 THEN CAST({int(i == 1)} AS DOUBLE) ELSE y.p{i} END AS y{i}" for i in range(5))} FROM x JOIN y USING (c_custkey)),
u AS ({" UNION ALL ".join(f"SELECT '{v}' AS variant, {i} AS category, {c}{i} AS p, x{i} AS m FROM o" for v, c in (("main", "x"), ("flat", "y")) for i in range(5))})
SELECT variant, category, round(avg(p), 7) AS mean_posterior, round(avg(abs(p - m)), 7) AS mean_change, round(max(abs(p - m)), 7) AS max_change FROM u GROUP BY 1, 2""")
def _(spark, d):
    rows = _evidence(spark, d).withColumn("flat", F.transform("like", lambda x: F.sqrt(x))).withColumn("seen", F.when(F.col("c_custkey") % 10 == 0, F.lit(1)))
    out = latent.em_variants(rows, ["region"], {"main": "like", "flat": "flat"}, "main", 5, "seen", penalty=0.0, tolerance=0.0, rounds=EM_ROUNDS)
    return out.select("variant", "category", *[F.round(c, 7).alias(c) for c in ("mean_posterior", "mean_change", "max_change")])


@query("rake_to_margin", f"""WITH {POSTERIOR_SQL}, g AS (SELECT nation, 0.3 AS target, count(*) AS n FROM po GROUP BY 1) SELECT nation, n, round(target, 6) AS reached FROM g""")
def _(spark, d):
    """The weighted mean that each nation's raked probabilities reach."""
    rows = _posteriors(_segment(spark, d))
    target = rows.select("nation").distinct().withColumn("target", F.lit(0.3))
    out = latent.rake_to_margin(rows, "posterior", 1, ["nation"], target)
    return out.groupBy("nation").agg(F.count("*").alias("n"), F.round(F.avg(F.col("raked")[1]), 6).alias("reached"))


_SCORES = "r AS (SELECT CAST(least(n_chars, 5000) // 100 AS DOUBLE) / 51 AS s, quality AS y FROM fx_labels WHERE quality IS NOT NULL)"


@query("score_diagnostics", fx.with_fixtures(f"""WITH {_SCORES} SELECT count(*) AS n, round((SELECT sum(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) / count(*) FROM r a JOIN r b ON a.y = 1 AND b.y = 0), 9) AS auc, round(avg(s), 9) AS mean_score, round(avg(y), 9) AS mean_outcome,
round(avg(CASE WHEN s > 0 AND s < 1 THEN -(s * log2(s) + (1 - s) * log2(1 - s)) ELSE 0 END), 8) AS entropy, round(avg(s * s) / avg(s), 9) AS concentration, round(avg((s - y) * (s - y)), 9) AS brier, round(regr_slope(y, s), 8) AS slope FROM r""", "fx_labels"))
def _(spark, d):
    rows = fx.labels(spark, d).select((F.floor(F.least("n_chars", F.lit(5000)) / 100).cast("double") / 51).alias("s"), F.col("quality").alias("y"))
    out = latent.score_diagnostics(rows, "s", "y")
    return out.select("n", *[F.round(c, k).alias(c) for c, k in (("auc", 9), ("mean_score", 9), ("mean_outcome", 9), ("entropy", 8), ("concentration", 9), ("brier", 9), ("slope", 8))])


@query("tie_keeping_deciles", fx.with_fixtures(f"""WITH {_SCORES}, c AS (SELECT s, count(*) AS n, sum(y) AS n1 FROM r GROUP BY 1), b AS (SELECT *, sum(n) OVER (ORDER BY s) - n AS below, sum(n) OVER () AS total FROM c)
SELECT CAST(least(floor((below + n / 2) / total * 10) + 1, 10) AS INT) AS decile, CAST(sum(n) AS BIGINT) AS n, round(sum(n1) / sum(n), 9) AS mean_outcome FROM b GROUP BY 1""", "fx_labels"))
def _(spark, d):
    rows = fx.labels(spark, d).select((F.floor(F.least("n_chars", F.lit(5000)) / 100).cast("double") / 51).alias("s"), F.col("quality").alias("y"))
    return latent.tie_keeping_deciles(rows, "s", "y").withColumn("mean_outcome", F.round("mean_outcome", 9))


@query("mixture_regression_em")
def _(spark, d):
    """Mean posterior of two latent kinds of line, by return flag, and the slopes that were found."""
    line = t(spark, d, "lineitem").select("l_returnflag", F.log("l_extendedprice").alias("y"), F.log("l_quantity").alias("x"), F.array((F.lit(0.3) + 4 * F.col("l_discount")), (F.lit(0.7) - 4 * F.col("l_discount"))).alias("p"))
    out, fits = latent.mixture_regression_em(line, "y", ["x"], "p", 2, 1e-6, 30)
    return out.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg(F.col("posterior")[0]).alias("first_kind")).withColumns({f"slope{k}": F.lit(float(f["beta"][1])) for k, f in enumerate(fits)})


@query("estimable_contrast", """WITH l AS (SELECT *, CAST(l_returnflag = 'A' AS INT) AS p FROM lineitem), g AS (SELECT p, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM l GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, round((x.a - y.a) + (x.b - y.b) * l_quantity, 3) AS contrast FROM l, (SELECT * FROM g WHERE p = 1) x, (SELECT * FROM g WHERE p = 0) y""")
def _(spark, d):
    """Certain categories, so that the contrast is the gap of two separate lines; a doubled control doesn't change it."""
    own = (F.col("l_returnflag") == "A").cast("double")
    line = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", (2 * F.col("l_quantity")).alias("again"), own.alias("p"), (1 - own).alias("q"))
    out = latent.estimable_contrast(line, "l_extendedprice", ["l_quantity", "again"], "p", "q")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("contrast", 3).alias("contrast"))


@query("gap_ladder", """WITH l AS (SELECT l_returnflag AS f, l_extendedprice AS y, l_quantity AS x, l_discount AS g, l_tax AS w FROM lineitem), k AS (SELECT f, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(y) AS my, avg(x) AS mx, regr_sxy(y, x) AS sxy, regr_sxx(y, x) AS sxx FROM l GROUP BY 1),
s AS (SELECT sum(sxy) / sum(sxx) AS b FROM k), o AS (SELECT a.a - r.a AS a, a.b - r.b AS b, a.my - r.my AS my, a.mx - r.mx AS mx FROM k a, k r WHERE a.f = 'A' AND r.f = 'R')
SELECT 'slope' AS step, round(my, 3) AS value FROM o UNION ALL SELECT 'slope_given_x', round(my - s.b * mx, 3) FROM o, s UNION ALL SELECT 'interacted_prior', round((SELECT avg(o.a + o.b * x) FROM l, o WHERE f = 'A'), 3)
UNION ALL SELECT 'fitted_prior', round(avg(g) FILTER (f = 'A'), 3) FROM l UNION ALL SELECT 'fitted', round(sum(g * w) / sum(w), 3) FROM l UNION ALL SELECT 'fitted_all', round(sum(g * w) / sum(w), 3) FROM l
UNION ALL SELECT 'n', count(*) FROM l UNION ALL SELECT 'n_supported', count(*) FROM l UNION ALL SELECT 'share_supported', 1 UNION ALL SELECT 'rank', 6 UNION ALL SELECT 'columns', 9""")
def _(spark, d):
    """Certain categories, so that each step has a plain form; a doubled control takes three of nine columns."""
    flag = lambda v: (F.col("l_returnflag") == v).cast("double")
    line = t(spark, d, "lineitem").withColumns({"p": flag("A"), "q": flag("N"), "again": 2 * F.col("l_quantity")})
    return latent.gap_ladder(line, "l_extendedprice", ["l_quantity", "again"], "p", "q", "l_discount", "l_tax").withColumn("value", F.round("value", 3))
