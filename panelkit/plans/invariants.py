"""Queries of the invariant jobs that compare rows with rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.operators import panel, quality
from panelkit.plans import fixtures as fx
from panelkit.registry import query

t = fx.table


@query("assert_ranges", """SELECT 'discount' AS rule, count(*) AS n_rows, count(*) FILTER (NOT (l_discount BETWEEN 0 AND 0.05)) AS n_broken FROM lineitem
UNION ALL SELECT 'quantity', count(*), count(*) FILTER (NOT (l_quantity >= 1)) FROM lineitem""")
def _(spark, d):
    rules = {"discount": F.col("l_discount").between(0, 0.05), "quantity": F.col("l_quantity") >= 1}
    return quality.assert_ranges(t(spark, d, "lineitem"), rules)


@query("assert_probabilities", fx.with_fixtures("""WITH p AS (SELECT p_brand, sum(n) FILTER (band < 2) / sum(n) AS a, sum(n) FILTER (band >= 2) / sum(n) + CASE WHEN p_brand = 'Brand#3' THEN 0.1 ELSE 0 END AS b, sum(n) AS total, sum(n) FILTER (band < 2) AS low, sum(n) FILTER (band >= 2) AS high FROM fx_shares GROUP BY 1)
SELECT 'probabilities' AS rule, count(*) AS n_rows, count(*) FILTER (NOT (a BETWEEN 0 AND 1 AND b BETWEEN 0 AND 1 AND abs(a + b - 1) <= 1e-6)) AS n_broken FROM p UNION ALL SELECT 'arithmetic', count(*), count(*) FILTER (total <> low + high) FROM p""", "fx_shares"))
def _(spark, d):
    """Shares of two bands, one row of which sums to 1.1."""
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    p = fx.shares(spark, d).groupBy("p_brand").agg(n(F.col("band") < 2).alias("low"), n(F.col("band") >= 2).alias("high"), F.sum("n").alias("total"))
    p = p.withColumns({"a": F.try_divide("low", "total"), "b": F.try_divide("high", "total") + F.when(F.col("p_brand") == "Brand#3", 0.1).otherwise(0.0)})
    return quality.assert_ranges(p, {"probabilities": quality.sums_to_one(["a", "b"]), "arithmetic": F.col("total") == F.col("low") + F.col("high")})


@query("assert_window_complete", """SELECT CAST(y.yr AS INT) AS yr, count(o.o_orderkey) AS n_rows, avg(CAST(o.o_totalprice IS NULL AS INT)) FILTER (o.o_orderkey IS NOT NULL) AS null_o_totalprice,
CASE WHEN count(o.o_orderkey) = 0 THEN 'CRITICAL' WHEN count(*) > count(o.o_totalprice) THEN 'WARN' ELSE 'OK' END AS severity
FROM generate_series(1994, 2002) y(yr) LEFT JOIN orders o ON year(o.o_orderdate) = y.yr GROUP BY 1""")
def _(spark, d):
    o = t(spark, d, "orders").select(F.year("o_orderdate").alias("yr"), "o_totalprice")
    return quality.assert_window_complete(o, "yr", 1994, 2002, ["o_totalprice"])


@query("assert_no_lookahead", """SELECT count(*) AS n_rows, count(*) FILTER (o_orderdate > DATE '1999-12-31') AS n_known_too_late, count(*) FILTER (DATE '1999-12-31' > l_shipdate) AS n_cutoff_too_late
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def _(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_shipdate").join(t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    return quality.assert_no_lookahead(rows.withColumn("cutoff", F.lit("1999-12-31").cast("timestamp")), "o_orderdate", "cutoff", "l_shipdate")


@query("assert_provenance", """WITH r AS (SELECT DISTINCT o_custkey AS k, DATE '1995-06-01' AS cutoff FROM orders WHERE o_custkey % 2 = 0), s AS (SELECT o_custkey AS k, min(o_orderdate) AS known FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT count(*) AS n_rows, count(*) FILTER (known IS NULL) AS n_without_source, count(*) FILTER (known > cutoff) AS n_source_too_late FROM r LEFT JOIN s USING (k)""")
def _(spark, d):
    o = t(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    roles = o.where("k % 2 = 0").select("k").distinct().withColumn("cutoff", F.lit("1995-06-01").cast("timestamp"))
    return quality.assert_provenance(roles, o.where("o_orderstatus = 'F'"), ["k"], "o_orderdate", "cutoff")


@query("assert_lag_identity", fx.with_fixtures("""WITH s AS (SELECT a.n_nationkey, a.yr, a.n_orders, CASE WHEN a.n_nationkey = 3 THEN b.n_orders + 2 WHEN a.n_nationkey = 4 AND a.yr = 1996 THEN NULL ELSE b.n_orders END AS stored, b.n_orders AS before FROM fx_nation_year a LEFT JOIN fx_nation_year b ON b.n_nationkey = a.n_nationkey AND b.yr = a.yr - 1)
SELECT count(*) AS n_rows, count(*) FILTER (stored IS DISTINCT FROM before) AS n_wrong, CAST(max(abs(stored - before)) AS DOUBLE) AS max_gap FROM s""", "fx_nation_year"))
def _(spark, d):
    """One nation's stored lag is two too large, another's first is lost."""
    stored = panel.lag_consecutive(fx.nation_year(spark, d), ["n_nationkey"], "yr", "n_orders", "before")
    fault = F.when(F.col("n_nationkey") == 3, F.col("before") + 2).when(~((F.col("n_nationkey") == 4) & (F.col("yr") == 1996)), F.col("before"))
    return quality.assert_lag_identity(stored.withColumn("before", fault), ["n_nationkey"], "yr", "n_orders", "before").withColumn("max_gap", F.col("max_gap").cast("double"))


@query("assert_groupwise_constant", """SELECT count(*) AS n_keys, c AS column_name, count(*) FILTER (CASE c WHEN 'l_returnflag' THEN a ELSE b END) AS n_varying
FROM (SELECT min(l_returnflag) <> max(l_returnflag) AS a, min(l_linestatus) <> max(l_linestatus) AS b FROM lineitem GROUP BY l_orderkey),
(VALUES ('l_returnflag'), ('l_linestatus')) v(c) GROUP BY c""")
def _(spark, d):
    return quality.assert_groupwise_constant(t(spark, d, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_linestatus"])


@query("assert_slope", """WITH r AS (SELECT o_totalprice AS y, f FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS f FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)
SELECT round(regr_slope(y, f), 9) AS slope, count(*) AS n_rows, abs(regr_slope(y, f) - 1) <= 0.15 AS ok FROM r""")
def _(spark, d):
    """Order totals on the sums of their lines."""
    f = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("f"))
    return quality.assert_slope(t(spark, d, "orders").join(f, "o_orderkey"), "o_totalprice", "f").withColumn("slope", F.round("slope", 9))


@query("assert_censoring", fx.with_fixtures("""WITH r AS (SELECT a.c_custkey, a.ym, CASE WHEN a.ym < 24018 THEN CAST(b.ym IS NOT NULL AS INT) WHEN a.c_custkey % 5 = 0 THEN 0 END AS back, CAST(b.n > a.n OR a.c_custkey % 11 = 0 AS INT) AS promoted FROM fx_cust_month a LEFT JOIN fx_cust_month b ON b.c_custkey = a.c_custkey AND b.ym = a.ym + 1)
SELECT 'last_is_null' AS rule, count(*) FILTER (ym = 24018) AS n_rows, count(*) FILTER (ym = 24018 AND back IS NOT NULL) AS n_broken FROM r UNION ALL SELECT 'earlier_is_known', count(*) FILTER (ym < 24018), count(*) FILTER (ym < 24018 AND back IS NULL) FROM r
UNION ALL SELECT 'promoted_is_retained', count(*) FILTER (promoted = 1 AND ym < 24018), count(*) FILTER (promoted = 1 AND ym < 24018 AND NOT coalesce(back = 1, false)) FROM r""", "fx_cust_month"))
def _(spark, d):
    """Outcomes asserted after the last month for some customers, and promotions of some who left."""
    m = fx.cust_month(spark, d).select("c_custkey", "ym", "n")
    rows = panel.next_period_outcome(m, ["c_custkey"], "ym", 24018, "back")
    rows = panel.lag_consecutive(rows, ["c_custkey"], "ym", "n", "next_n", -1)
    last = F.col("ym") == 24018
    back = F.when(last & (F.col("c_custkey") % 5 == 0), 0).otherwise(F.col("back"))
    rows = rows.withColumns({"back": back, "promoted": ((F.col("next_n") > F.col("n")) | (F.col("c_custkey") % 11 == 0)).cast("int")})
    earlier = F.col("ym") < 24018
    rules = {"last_is_null": (last, F.col("back").isNull()), "earlier_is_known": (earlier, F.col("back").isNotNull()), "promoted_is_retained": (earlier & (F.col("promoted") == 1), F.col("back") == 1)}
    return quality.assert_censoring(rows, rules)


@query("profile_columns", """WITH r AS (SELECT l_orderkey, l_quantity, l_returnflag, CASE WHEN l_tax > 0.02 THEN CAST(l_linenumber AS INT) END AS doubtful FROM lineitem)
SELECT 'l_orderkey' AS variable, 'bigint' AS type, count(*) AS n_rows, count(l_orderkey) / count(*) AS share_present, CAST(min(l_orderkey) AS VARCHAR) AS min_value, CAST(max(l_orderkey) AS VARCHAR) AS max_value FROM r UNION ALL SELECT 'l_quantity', 'double', count(*), count(l_quantity) / count(*), CAST(min(l_quantity) AS VARCHAR), CAST(max(l_quantity) AS VARCHAR) FROM r
UNION ALL SELECT 'l_returnflag', 'string', count(*), count(l_returnflag) / count(*), min(l_returnflag), max(l_returnflag) FROM r UNION ALL SELECT 'doubtful', 'int', count(*), count(doubtful) / count(*), CAST(min(doubtful) AS VARCHAR), CAST(max(doubtful) AS VARCHAR) FROM r""")
def _(spark, d):
    line = t(spark, d, "lineitem")
    return quality.profile_columns(line.select("l_orderkey", "l_quantity", "l_returnflag", F.when(F.col("l_tax") > 0.02, F.col("l_linenumber").cast("int")).alias("doubtful")))
