"""Queries of key and reference checks, on rows with planted faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.operators import quality
from panelkit.plans import fixtures as fx
from panelkit.registry import query

t = fx.table


@query("assert_unique_key", """WITH r AS (SELECT CASE WHEN l_tax > 0 THEN l_orderkey END AS k, l_linenumber AS n FROM lineitem), c AS (SELECT k, n, count(*) AS m FROM r GROUP BY 1, 2)
SELECT CAST(sum(m) AS BIGINT) AS n_rows, CAST(sum(CASE WHEN k IS NULL THEN m ELSE 0 END) AS BIGINT) AS n_null_keys, count(*) FILTER (k IS NOT NULL AND m > 1) AS n_repeated_keys FROM c""")
def _(spark, d):
    """Lines whose order is hidden where no tax is due."""
    rows = t(spark, d, "lineitem").select(F.when(F.col("l_tax") > 0, F.col("l_orderkey")).alias("k"), F.col("l_linenumber").alias("n"))
    return quality.assert_unique_key(rows, ["k", "n"])


@query("assert_references", """WITH c AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN -1 - o_custkey ELSE o_custkey END AS k FROM orders), p AS (SELECT c_custkey FROM customer WHERE c_custkey % 7 > 0)
SELECT count(*) AS n_child, count(*) FILTER (k IN (SELECT c_custkey FROM p)) AS n_found, (SELECT count(*) FROM p WHERE c_custkey NOT IN (SELECT k FROM c)) AS n_parents_without_child, count(*) FILTER (k IN (SELECT c_custkey FROM p)) / count(*) AS share_found, count(*) FILTER (k IN (SELECT c_custkey FROM p)) / count(*) >= 0.9 AS ok FROM c""")
def _(spark, d):
    """Some orders name customers that are not there, and some customers are taken out."""
    c = t(spark, d, "orders").select(F.when(F.col("o_orderkey") % 10 == 0, -1 - F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("k"))
    return quality.assert_references(c, t(spark, d, "customer").where("c_custkey % 7 > 0"), [("k", "c_custkey")], 0.9)


@query("assert_mapped", """SELECT 'o_custkey' AS column_name, count(DISTINCT o_custkey) AS n_codes, count(DISTINCT o_custkey) FILTER (o_custkey % 9 = 0) AS n_unmapped, count(*) FILTER (o_custkey % 9 > 0) / count(*) AS share_mapped, false AS ok FROM orders
UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus), 0, 1, true FROM orders""")
def _(spark, d):
    o = t(spark, d, "orders")
    return quality.assert_mapped(o, {"o_custkey": t(spark, d, "customer").where("c_custkey % 9 > 0").select("c_custkey"), "o_orderstatus": o.select("o_orderstatus")})


@query("assert_recount", """WITH a AS (SELECT l_orderkey, count(*) + CASE WHEN l_orderkey % 50 = 0 THEN 2 ELSE 0 END AS n FROM lineitem WHERE l_orderkey % 20 > 0 OR l_orderkey % 50 = 0 GROUP BY 1), b AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT count(*) AS n_keys, count(*) FILTER (a.n IS NULL OR b.n IS NULL) AS n_one_side, count(*) FILTER (a.n <> b.n) AS n_differ, max(abs(a.n - b.n)) AS max_gap FROM a FULL JOIN b USING (l_orderkey)""")
def _(spark, d):
    """Stored counts of lines with a fault on some orders, and without some others."""
    line = t(spark, d, "lineitem")
    stored = line.where("l_orderkey % 20 > 0 OR l_orderkey % 50 = 0").groupBy("l_orderkey").agg((F.count("*") + F.when(F.col("l_orderkey") % 50 == 0, 2).otherwise(0)).alias("n"))
    return quality.assert_recount(stored, line.groupBy("l_orderkey").agg(F.count("*").alias("n")), ["l_orderkey"], "n")
