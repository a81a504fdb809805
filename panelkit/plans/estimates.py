"""Queries of estimators and inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.operators import estimate
from panelkit.plans import fixtures as fx
from panelkit.registry import query

t = fx.table
with_fx = fx.with_fixtures

# Least squares of y on x1 and x2 net of the means of fe, with CR1 errors by cl, from sums.
_NET = """d AS (SELECT y - avg(y) OVER (PARTITION BY fe) AS y, x1 - avg(x1) OVER (PARTITION BY fe) AS x1, x2 - avg(x2) OVER (PARTITION BY fe) AS x2, fe, cl FROM fx_design),
a AS (SELECT sum(x1 * x1) AS a11, sum(x1 * x2) AS a12, sum(x2 * x2) AS a22, sum(x1 * y) AS b1, sum(x2 * y) AS b2, count(*) AS n, count(DISTINCT fe) AS nf FROM d),
b AS (SELECT *, (a22 * b1 - a12 * b2) / (a11 * a22 - a12 * a12) AS e1, (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) AS e2, a22 / (a11 * a22 - a12 * a12) AS i11, -a12 / (a11 * a22 - a12 * a12) AS i12, a11 / (a11 * a22 - a12 * a12) AS i22 FROM a)"""


def _meat(tag: str, by: str, clusters: str = "cl", least: str = "g") -> str:
    """The sandwich of clusters ``by``. The effect counts as one level where each of its levels lies in one of the ``clusters``."""
    nested = f"(SELECT CASE WHEN max(k) = 1 THEN 1 ELSE count(*) END FROM (SELECT count(DISTINCT {clusters}) AS k FROM d GROUP BY fe))"
    return f"""{tag}s AS (SELECT sum(x1 * (y - e1 * x1 - e2 * x2)) AS s1, sum(x2 * (y - e1 * x1 - e2 * x2)) AS s2 FROM d, b GROUP BY {by}),
{tag} AS (SELECT i11, i12, i22, CAST({least} AS DOUBLE) / ({least} - 1) * (n - 1) / (n - 2 - {nested}) AS c, m11, m12, m22, g, n FROM b, (SELECT count(*) AS g, sum(s1 * s1) AS m11, sum(s1 * s2) AS m12, sum(s2 * s2) AS m22 FROM {tag}s)),
{tag}v AS (SELECT g, n, c * (i11 * i11 * m11 + 2 * i11 * i12 * m12 + i12 * i12 * m22) AS v1, c * (i12 * i12 * m11 + 2 * i12 * i22 * m12 + i22 * i22 * m22) AS v2, c * (i11 * i12 * m11 + (i11 * i22 + i12 * i12) * m12 + i12 * i22 * m22) AS v12 FROM {tag})"""


#: Two ways, cl and fe: the smaller number of clusters corrects all parts.
_LEAST = "(SELECT least(count(DISTINCT cl), count(DISTINCT fe)) FROM d)"


def _rows(spark, d):
    return fx.design(spark, d)


def _out(df, digits: int = 8):
    return df.select("term", F.round("estimate", digits).alias("estimate"), F.round("std_error", digits).alias("std_error"), "n", "n_clusters")


@query("ols_fe", with_fx(f"""WITH {_NET}, {_meat("m", "cl")} SELECT 'x1' AS term, round(e1, 8) AS estimate, round(sqrt(v1), 8) AS std_error, mv.n, g AS n_clusters FROM b, mv UNION ALL SELECT 'x2', round(e2, 8), round(sqrt(v2), 8), mv.n, g FROM b, mv""", "fx_design"))
def _(spark, d):
    return _out(estimate.ols_fe(_rows(spark, d), "y", ["x1", "x2"], ["fe"], "cl"))


@query("se_twoway", with_fx(f"""WITH {_NET}, {_meat("m", "cl", "fe", _LEAST)}, {_meat("k", "fe", "fe", _LEAST)}, {_meat("w", "cl, fe", "fe", _LEAST)} SELECT 'x1' AS term, round(e1, 8) AS estimate, round(sqrt(mv.v1 + kv.v1 - wv.v1), 8) AS std_error, mv.n, least(mv.g, kv.g) AS n_clusters FROM b, mv, kv, wv
UNION ALL SELECT 'x2', round(e2, 8), round(sqrt(mv.v2 + kv.v2 - wv.v2), 8), mv.n, least(mv.g, kv.g) FROM b, mv, kv, wv""", "fx_design"))
def _(spark, d):
    return _out(estimate.ols_fe(_rows(spark, d), "y", ["x1", "x2"], ["fe"], ["cl", "fe"]))


@query("ols_fe_nested", with_fx(f"""WITH {_NET}, {_meat("m", "fe", "fe")} SELECT 'x1' AS term, round(e1, 8) AS estimate, round(sqrt(v1), 8) AS std_error, mv.n, g AS n_clusters FROM b, mv UNION ALL SELECT 'x2', round(e2, 8), round(sqrt(v2), 8), mv.n, g FROM b, mv""", "fx_design"))
def _(spark, d):
    """Effects nested in the clusters, which then don't count in the correction."""
    return _out(estimate.ols_fe(_rows(spark, d), "y", ["x1", "x2"], ["fe"], "fe"))


@query("ols_interacted_effect", with_fx("""WITH d AS (SELECT y - avg(y) OVER w AS y, x1 - avg(x1) OVER w AS x1 FROM fx_design WINDOW w AS (PARTITION BY grp, yr)) SELECT 'x1' AS term, round(sum(x1 * y) / sum(x1 * x1), 8) AS estimate, count(*) AS n FROM d""", "fx_design"))
def _(spark, d):
    return _out(estimate.ols_fe(_rows(spark, d), "y", ["x1"], ["grp^yr"], "cl")).select("term", "estimate", "n")


@query("gram_ols", with_fx("""WITH g AS (SELECT regr_count(y, x1) AS n, covar_pop(x1, x1) AS a, covar_pop(x1, x2) AS c, covar_pop(x2, x2) AS b, covar_pop(x1, y) AS p, covar_pop(x2, y) AS q, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2 FROM fx_design), s AS (SELECT *, (b * p - c * q) / (a * b - c * c) AS e1, (a * q - c * p) / (a * b - c * c) AS e2 FROM g)
SELECT 'x1' AS term, round(e1, 8) AS estimate FROM s UNION ALL SELECT 'x2', round(e2, 8) FROM s UNION ALL SELECT 'twice', 0 FROM s UNION ALL SELECT '(Intercept)', round(my - e1 * m1 - e2 * m2, 8) FROM s""", "fx_design"))
def _(spark, d):
    rows = _rows(spark, d).withColumn("twice", 2 * F.col("x1") + 3)
    found = estimate.gram_ols(rows, "y", ["x1", "x2", "twice"], ["x1"])
    return spark.createDataFrame([(k, round(v, 8)) for k, v in found.items()], "term string, estimate double")


@query("export_estimates", with_fx(f"""WITH {_NET}, {_meat("m", "cl")}, r AS (SELECT 'x1' AS term, e1 AS e, sqrt(v1) AS s, mv.n FROM b, mv UNION ALL SELECT 'x2', e2, sqrt(v2), mv.n FROM b, mv)
SELECT 'main' AS model, term, round(e, 8) AS estimate, round(s, 8) AS std_error, round(e - 1.959963984540054 * s, 7) AS ci_low, round(e + 1.959963984540054 * s, 7) AS ci_high, n AS nobs, 'y' AS dep_var, 'plain' AS measure FROM r""", "fx_design"))
def _(spark, d):
    out = estimate.export_estimates({"main": (estimate.ols_fe(_rows(spark, d), "y", ["x1", "x2"], ["fe"], "cl"), "y", "plain")})
    return out.withColumns({"estimate": F.round("estimate", 8), "std_error": F.round("std_error", 8), "ci_low": F.round("ci_low", 7), "ci_high": F.round("ci_high", 7)}).drop("p_value")


@query("drop_singletons", """WITH r0 AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey * 10 + l_linenumber AS f, l_orderkey AS g FROM lineitem), r1 AS (SELECT * FROM r0 WHERE f IN (SELECT f FROM r0 GROUP BY 1 HAVING count(*) > 1) AND g IN (SELECT g FROM r0 GROUP BY 1 HAVING count(*) > 1)),
r2 AS (SELECT * FROM r1 WHERE f IN (SELECT f FROM r1 GROUP BY 1 HAVING count(*) > 1) AND g IN (SELECT g FROM r1 GROUP BY 1 HAVING count(*) > 1)), r3 AS (SELECT * FROM r2 WHERE f IN (SELECT f FROM r2 GROUP BY 1 HAVING count(*) > 1) AND g IN (SELECT g FROM r2 GROUP BY 1 HAVING count(*) > 1)),
r4 AS (SELECT * FROM r3 WHERE f IN (SELECT f FROM r3 GROUP BY 1 HAVING count(*) > 1) AND g IN (SELECT g FROM r3 GROUP BY 1 HAVING count(*) > 1)), r5 AS (SELECT * FROM r4 WHERE f IN (SELECT f FROM r4 GROUP BY 1 HAVING count(*) > 1) AND g IN (SELECT g FROM r4 GROUP BY 1 HAVING count(*) > 1)),
r6 AS (SELECT * FROM r5 WHERE f IN (SELECT f FROM r5 GROUP BY 1 HAVING count(*) > 1) AND g IN (SELECT g FROM r5 GROUP BY 1 HAVING count(*) > 1)), r7 AS (SELECT * FROM r6 WHERE f IN (SELECT f FROM r6 GROUP BY 1 HAVING count(*) > 1) AND g IN (SELECT g FROM r6 GROUP BY 1 HAVING count(*) > 1)),
r8 AS (SELECT * FROM r7 WHERE f IN (SELECT f FROM r7 GROUP BY 1 HAVING count(*) > 1) AND g IN (SELECT g FROM r7 GROUP BY 1 HAVING count(*) > 1)), r9 AS (SELECT * FROM r8 WHERE f IN (SELECT f FROM r8 GROUP BY 1 HAVING count(*) > 1) AND g IN (SELECT g FROM r8 GROUP BY 1 HAVING count(*) > 1))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM r9""")
def _(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("f"), F.col("l_orderkey").alias("g"))
    return estimate.drop_singletons(rows, ["f", "g"]).drop("f", "g")


@query("common_sample", """SELECT o_orderkey, prior FROM (SELECT o_orderkey, o_custkey, lag(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS prior FROM orders) WHERE prior IS NOT NULL""")
def _(spark, d):
    from pyspark.sql import Window

    rows = t(spark, d, "orders").withColumn("prior", F.lag("o_totalprice").over(Window.partitionBy("o_orderstatus").orderBy("o_orderkey")))
    return estimate.common_sample(rows, [["o_custkey", "prior"], ["o_totalprice"]]).select("o_orderkey", "prior")


@query("residual_sd", with_fx("""WITH d AS (SELECT x1 - avg(x1) OVER (PARTITION BY fe) AS a, x2 - avg(x2) OVER (PARTITION BY fe) AS b FROM fx_design), s AS (SELECT sum(a * b) / sum(b * b) AS k FROM d)
SELECT round((SELECT sqrt(sum(a * a) / (count(*) - 1)) FROM d), 8) AS within_sd, round((SELECT sqrt(sum(pow(a - k * b, 2)) / (count(*) - 1)) FROM d, s), 8) AS net_sd""", "fx_design"))
def _(spark, d):
    rows = _rows(spark, d)
    return spark.createDataFrame([(round(estimate.residual_sd(rows, "x1", ["fe"]), 8), round(estimate.residual_sd(rows, "x1", ["fe"], ["x2"]), 8))], "within_sd double, net_sd double")


@query("variance_shares", """WITH r AS (SELECT CAST(o_totalprice AS DOUBLE) AS y, CAST(o_orderstatus = 'F' AS INT) AS a, CAST(o_orderpriority = '1-URGENT' AS INT) AS b FROM orders), v AS (SELECT var_pop(y) AS s, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ca, covar_pop(b, y) AS cb, count(*) AS n FROM r),
c AS (SELECT sum(v) / sum(k) AS w FROM (SELECT var_pop(y) * count(*) AS v, count(*) AS k FROM r GROUP BY a, b))
SELECT round((ca * ca * vb + cb * cb * va - 2 * ca * cb * ab) / (va * vb - ab * ab) / s, 9) AS r2_main, round(1 - w / s, 9) AS r2_cells, round(ca * ca / va / s, 9) AS r2_first, round(w / s, 9) AS within_cells, n FROM v, c""")
def _(spark, d):
    rows = t(spark, d, "orders").select("o_totalprice", (F.col("o_orderstatus") == "F").alias("a"), (F.col("o_orderpriority") == "1-URGENT").alias("b"))
    out = estimate.variance_shares(rows, "o_totalprice", ["a", "b"])
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns if c != "n"], "n")


@query("gelbach_decompose", with_fx("""WITH g AS (SELECT covar_pop(x1, x1) AS a, covar_pop(x1, x2) AS c, covar_pop(x2, x2) AS b, covar_pop(x1, y) AS p, covar_pop(x2, y) AS q FROM fx_design), s AS (SELECT *, (b * p - c * q) / (a * b - c * c) AS e1, (a * q - c * p) / (a * b - c * c) AS e2 FROM g)
SELECT 'base' AS part, round(p / a, 9) AS value FROM s UNION ALL SELECT 'full', round(e1, 9) FROM s UNION ALL SELECT 'discount', round(e2 * c / a, 9) FROM s""", "fx_design"))
def _(spark, d):
    return estimate.gelbach_decompose(_rows(spark, d), "y", "x1", {"discount": ["x2"]}).withColumn("value", F.round("value", 9))


@query("bootstrap_cluster")
def _(spark, d):
    return estimate.bootstrap_cluster(_rows(spark, d), "y", ["x1", "x2"], "fe", 199)


@query("bootstrap_wild_cluster")
def _(spark, d):
    rows = t(spark, d, "orders").join(t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_acctbal"), "o_custkey").select(F.log("o_totalprice").alias("y"), (F.col("c_acctbal") / 1000).alias("x"), F.col("c_nationkey").alias("g"))
    return estimate.bootstrap_wild_cluster(rows, "y", ["x"], "x", "g", replicates=9999)


@query("permute_within_strata")
def _(spark, d):
    n = fx.nation_year(spark, d).select((F.col("n_nationkey") * 10000 + F.col("yr")).alias("key"), "yr", "n_orders", (F.col("revenue") / F.col("n_orders")).alias("mean_price"))
    return estimate.permute_within_strata(n, "key", "mean_price", "n_orders", "yr", 999)


@query("ols_joint_test", with_fx(f"""WITH {_NET}, {_meat("m", "cl")} SELECT 'x1 = 0' AS restriction, round(e1, 8) AS gap, round(e1 * e1 / v1, 5) AS f_value, 1 AS df1 FROM b, mv UNION ALL SELECT 'x2 = 1', round(e2 - 1, 8), round((e2 - 1) * (e2 - 1) / v2, 5), 1 FROM b, mv
UNION ALL SELECT 'joint', NULL, round((e1 * e1 * v2 - 2 * e1 * (e2 - 1) * v12 + (e2 - 1) * (e2 - 1) * v1) / (v1 * v2 - v12 * v12) / 2, 5), 2 FROM b, mv""", "fx_design"))
def _(spark, d):
    out = estimate.ols_joint_test(_rows(spark, d), "y", ["x1", "x2"], {"x1 = 0": ({"x1": 1.0}, 0.0), "x2 = 1": ({"x2": 1.0}, 1.0)}, ["fe"], "cl")
    return out.select("restriction", F.round("gap", 8).alias("gap"), F.round("f_value", 5).alias("f_value"), "df1")


_DID = "r AS (SELECT c_nationkey AS u, CAST(year(o_orderdate) >= 1998 AS INT) AS post, CAST(c_nationkey < 10 AS INT) AS treated, o_totalprice AS y FROM orders JOIN customer ON o_custkey = c_custkey)"


@query("did_event_study", f"""WITH {_DID}, p AS (SELECT u, treated, post, avg(y) AS y FROM r GROUP BY 1, 2, 3) SELECT '1' AS term, round((avg(y) FILTER (treated = 1 AND post = 1) - avg(y) FILTER (treated = 1 AND post = 0)) - (avg(y) FILTER (treated = 0 AND post = 1) - avg(y) FILTER (treated = 0 AND post = 0)), 4) AS estimate, count(*) AS n FROM p""")
def _(spark, d):
    """Two periods, where the estimate is the difference of differences of means."""
    rows = t(spark, d, "orders").join(t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    p = rows.groupBy(F.col("c_nationkey").alias("u"), (F.year("o_orderdate") >= 1998).cast("int").alias("post")).agg(F.avg("o_totalprice").alias("y")).withColumn("treated", (F.col("u") < 10).cast("int"))
    out = estimate.did_event_study(p, "y", "u", "post", "treated", 0, [0, 1])
    return out.select("term", F.round("estimate", 4).alias("estimate"), "n")


@query("event_study_years")
def _(spark, d):
    n = fx.nation_year(spark, d).select("n_nationkey", "yr", (F.col("revenue") / F.col("n_orders")).alias("y"), (F.col("n_nationkey") < 10).cast("int").alias("treated"))
    return estimate.did_event_study(n, "y", "n_nationkey", "yr", "treated", 1997, list(range(1995, 2002)))


@query("placebo_leads", with_fx("""WITH p AS (SELECT a.n_nationkey AS u, a.yr, a.revenue / a.n_orders AS y, CAST(a.n_orders AS DOUBLE) AS x, CAST(b.n_orders AS DOUBLE) AS z FROM fx_nation_year a JOIN fx_nation_year b ON b.n_nationkey = a.n_nationkey AND b.yr = a.yr + 1),
d AS (SELECT y - avg(y) OVER w AS y, x - avg(x) OVER w AS x1, z - avg(z) OVER w AS x2 FROM p WINDOW w AS (PARTITION BY u)), a AS (SELECT sum(x1 * x1) AS a11, sum(x1 * x2) AS a12, sum(x2 * x2) AS a22, sum(x1 * y) AS b1, sum(x2 * y) AS b2, count(*) AS n FROM d)
SELECT 'n_orders' AS term, round((a22 * b1 - a12 * b2) / (a11 * a22 - a12 * a12), 5) AS estimate, n FROM a UNION ALL SELECT 'lead1', round((a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12), 5), n FROM a""", "fx_nation_year"))
def _(spark, d):
    n = fx.nation_year(spark, d).withColumn("y", F.col("revenue") / F.col("n_orders"))
    out = estimate.placebo_leads(n, ["n_nationkey"], "yr", "y", "n_orders", [1], ["n_nationkey"], "n_nationkey")
    return out.select("term", F.round("estimate", 5).alias("estimate"), "n")


@query("reverse_placebo", with_fx("""WITH p AS (SELECT a.n_nationkey AS u, CAST(a.n_orders AS DOUBLE) AS y, b.revenue / b.n_orders AS x, CAST(b.n_orders AS DOUBLE) AS z FROM fx_nation_year a JOIN fx_nation_year b ON b.n_nationkey = a.n_nationkey AND b.yr = a.yr - 1),
d AS (SELECT y - avg(y) OVER w AS y, x - avg(x) OVER w AS x1, z - avg(z) OVER w AS x2 FROM p WINDOW w AS (PARTITION BY u)), a AS (SELECT sum(x1 * x1) AS a11, sum(x1 * x2) AS a12, sum(x2 * x2) AS a22, sum(x1 * y) AS b1, sum(x2 * y) AS b2, count(*) AS n FROM d)
SELECT 'lag_y' AS term, round((a22 * b1 - a12 * b2) / (a11 * a22 - a12 * a12), 8) AS estimate, n FROM a UNION ALL SELECT 'lag_x', round((a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12), 8), n FROM a""", "fx_nation_year"))
def _(spark, d):
    n = fx.nation_year(spark, d).withColumn("y", F.col("revenue") / F.col("n_orders"))
    out = estimate.reverse_placebo(n, ["n_nationkey"], "yr", "y", "n_orders", ["n_nationkey"], "n_nationkey")
    return out.select("term", F.round("estimate", 8).alias("estimate"), "n")


@query("pretrend_tests")
def _(spark, d):
    n = fx.nation_year(spark, d).select("n_nationkey", "yr", (F.col("revenue") / F.col("n_orders")).alias("y"), (F.col("n_nationkey") < 10).cast("int").alias("treated"))
    return estimate.pretrend_tests(n, "y", "n_nationkey", "yr", "treated", 1998, list(range(1995, 2002)), short=2)


_BREAKS = """SELECT '{era}' AS era, '{test}' AS test, CAST({at} AS INT) AS "at", (SELECT round((a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12), 4) FROM (SELECT sum(a * a) AS a11, sum(a * b) AS a12, sum(b * b) AS a22, sum(a * y) AS b1, sum(b * y) AS b2 FROM
(SELECT y - avg(y) OVER w AS y, x - avg(x) OVER w AS a, x * {part} - avg(x * {part}) OVER w AS b FROM p WHERE {within} WINDOW w AS (PARTITION BY yr)))) AS estimate, count(*) AS n, CAST(sum(x) AS DOUBLE) AS n_treated FROM p WHERE {within}"""
_BREAK_TESTS = [("before", "trend", "NULL", "(yr - 1993)", "yr BETWEEN 1993 AND 1996"), ("before", "break", "1995", "CAST(yr >= 1995 AS INT)", "yr BETWEEN 1993 AND 1996"), ("after", "trend", "NULL", "(yr - 1997)", "yr BETWEEN 1997 AND 2001")]


@query("placebo_breaks", with_fx("WITH p AS (SELECT yr, revenue / n_orders AS y, CASE WHEN n_nationkey < 10 THEN 1.0 ELSE 0.0 END AS x FROM fx_nation_year) " + " UNION ALL ".join(_BREAKS.format(era=e, test=k, at=a, part=c, within=w) for e, k, a, c, w in _BREAK_TESTS) + " UNION ALL SELECT 'never', 'trend', NULL, NULL, 0, 0.0", "fx_nation_year"))
def _(spark, d):
    """Trends and a break of the first ten nations' effect in eras without a rule, and an era without rows."""
    n = fx.nation_year(spark, d).select("n_nationkey", "yr", (F.col("revenue") / F.col("n_orders")).alias("y"), (F.col("n_nationkey") < 10).cast("double").alias("x"))
    out = estimate.placebo_breaks(n, "y", "x", "yr", {"before": (1993, 1996), "after": (1997, 2001), "never": (1890, 1891)}, {"before": [1995]}, fe=["yr"], cluster="n_nationkey")
    return out.drop("std_error", "p_value").withColumn("estimate", F.round("estimate", 4))


_DIFFERENCE = """SELECT '{v}' AS variable, round(e, 4) AS difference, round(sqrt(m * g / (g - 1) * (n - 1) / (n - 2)) / a, 4) AS std_error, n, g AS n_clusters FROM (SELECT e, a, n, sum(s * s) AS m, count(*) AS g FROM (SELECT c, any_value(e) AS e, any_value(a) AS a, any_value(n) AS n, sum(x * ({v} - e * x)) AS s
FROM d, (SELECT sum(x * {v}) / sum(x * x) AS e, sum(x * x) AS a, count(*) AS n FROM d) GROUP BY c) GROUP BY 1, 2, 3)"""


@query("group_difference", "WITH d AS (SELECT l_suppkey AS c, l_discount * 10 - avg(l_discount * 10) OVER () AS x, l_extendedprice - avg(l_extendedprice) OVER () AS l_extendedprice, l_quantity - avg(l_quantity) OVER () AS l_quantity FROM lineitem) " + " UNION ALL ".join(_DIFFERENCE.format(v=v) for v in ("l_extendedprice", "l_quantity")))
def _(spark, d):
    rows = t(spark, d, "lineitem").withColumn("p", F.col("l_discount") * 10)
    out = estimate.group_difference(rows, "p", ["l_extendedprice", "l_quantity"], "l_suppkey")
    return out.select("variable", F.round("difference", 4).alias("difference"), F.round("std_error", 4).alias("std_error"), "n", "n_clusters")


@query("interaction_profile", with_fx("""SELECT CAST(yr AS INT) AS yr, count(*) AS n, count(*) FILTER (grp = 'A') AS n_category, round(avg(y) FILTER (grp = 'A') - avg(y) FILTER (grp <> 'A'), 7) AS raw FROM fx_design GROUP BY 1""", "fx_design"))
def _(spark, d):
    rows = _rows(spark, d).withColumn("is_a", (F.col("grp") == "A").cast("int"))
    years = [r[0] for r in rows.select("yr").distinct().orderBy("yr").collect()]
    out = estimate.interaction_profile(rows, "y", "is_a", "yr", ["x1"], years, "fe")
    return out.select("yr", "n", "n_category", F.round("raw", 7).alias("raw"))


@query("logit_fe_ame")
def _(spark, d):
    rows = fx.labels(spark, d).where("quality IS NOT NULL").withColumn("size", F.log1p("n_chars"))
    return estimate.logit_fe_ame(rows, "quality", ["size"], "lang", "source")


@query("auc_bootstrap_ci")
def _(spark, d):
    return estimate.auc_bootstrap_ci(fx.labels(spark, d).where("quality IS NOT NULL"), "n_chars", "quality")


@query("sample_flow", """SELECT 0 AS step, 'input' AS name, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_entities FROM orders UNION ALL SELECT 1, 'late', count(*), count(DISTINCT o_custkey) FROM orders WHERE year(o_orderdate) >= 1999
UNION ALL SELECT 2, 'open', count(*), count(DISTINCT o_custkey) FROM orders WHERE year(o_orderdate) >= 1999 AND o_orderstatus = 'O' UNION ALL SELECT 3, 'urgent', count(*), count(DISTINCT o_custkey) FROM orders WHERE year(o_orderdate) >= 1999 AND o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'""")
def _(spark, d):
    steps = {"late": F.year("o_orderdate") >= 1999, "open": F.col("o_orderstatus") == "O", "urgent": F.col("o_orderpriority") == "1-URGENT"}
    return estimate.sample_flow(t(spark, d, "orders"), steps, "o_custkey")


@query("sensitivity_grid", with_fx("""WITH d AS (SELECT 'main' AS variant, y - avg(y) OVER (PARTITION BY fe) AS y, x1 - avg(x1) OVER (PARTITION BY fe) AS x FROM fx_design UNION ALL SELECT 'late', y - avg(y) OVER (PARTITION BY fe), x1 - avg(x1) OVER (PARTITION BY fe) FROM fx_design WHERE yr >= 1999 UNION ALL SELECT 'discount', y - avg(y) OVER (PARTITION BY fe), x2 - avg(x2) OVER (PARTITION BY fe) FROM fx_design),
e AS (SELECT variant, sum(x * y) / sum(x * x) AS e, count(*) AS n FROM d GROUP BY 1) SELECT variant, round(e, 8) AS estimate, n, round(e / (SELECT e FROM e WHERE variant = 'main'), 6) AS to_main FROM e""", "fx_design"))
def _(spark, d):
    spec = {"y": "y", "x": ["x1"], "fe": ["fe"], "cluster": "fe"}
    out = estimate.sensitivity_grid(_rows(spark, d), "main", {"main": spec, "late": spec | {"where": "yr >= 1999"}, "discount": spec | {"x": ["x2"], "focal": "x2"}}, "x1", estimate.ols_fe(_rows(spark, d), **spec).first()["estimate"])
    return out.select("variant", F.round("estimate", 8).alias("estimate"), "n", F.round("to_main", 6).alias("to_main"))
