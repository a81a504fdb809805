"""Queries of readers and checked writers; files that they need are first written by Spark beside the checkpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit import sources
from panelkit.operators._state import scratch
from panelkit.plans import fixtures as fx
from panelkit.registry import query

t = fx.table


@query("scan_partitioned", """SELECT o_orderkey, CASE WHEN year(o_orderdate) < 1998 THEN o_totalprice END AS o_totalprice, CASE WHEN year(o_orderdate) >= 1998 THEN o_orderpriority END AS o_orderpriority FROM orders""")
def _(spark, d):
    """Two generations of files, each with a column that the other lacks."""
    o, path = t(spark, d, "orders"), scratch(spark, "orders")
    o.where(F.year("o_orderdate") < 1998).select("o_orderkey", "o_totalprice").write.parquet(f"{path}/period=1")
    o.where(F.year("o_orderdate") >= 1998).select("o_orderkey", "o_orderpriority").write.parquet(f"{path}/period=2")
    return sources.scan_partitioned(spark, [f"{path}/period=1", f"{path}/period=2"]).select("o_orderkey", "o_totalprice", "o_orderpriority")


@query("empty_partitions", """SELECT CAST(y AS INT) AS yr FROM generate_series(1993, 2003) x(y) WHERE y NOT IN (SELECT year(o_orderdate) FROM orders)""")
def _(spark, d):
    expected = spark.range(1993, 2004).select(F.col("id").cast("int").alias("yr"))
    return sources.empty_partitions(t(spark, d, "orders").select(F.year("o_orderdate").alias("yr")), "yr", expected)


@query("scan_json_flatten", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS p_k, user_id AS p_by_id, event_type AS p_by_kind FROM events""")
def _(spark, d):
    nested = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("kind")).alias("By")))
    e = t(spark, d, "events").select("event_id", nested.alias("payload"))
    return sources.scan_json_flatten(e, "payload", "k long, By struct<id:long,kind:string>", "p", {"p_by_id": F.col("p_by_id")}).drop("payload")


@query("explode_nested_history", """SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS INT) AS seq, l_linenumber AS n, l_partkey AS part FROM lineitem""")
def _(spark, d):
    """Orders with their lines as a list, stated twice and once with an empty entry."""
    entry = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", entry.alias("e"))
    lists = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["e"]).alias("lines"))
    kind = "array<struct<n:int,part:bigint>>"
    blank = F.array(F.struct(F.lit(None).cast("int").alias("n"), F.lit(None).cast("long").alias("part")))
    rows = lists.select("l_orderkey", F.concat(F.col("lines").cast(kind), blank.cast(kind)).alias("lines"))
    return sources.explode_nested_history(rows.union(rows), ["l_orderkey"], "lines")


@query("scan_csv_suppressed", fx.with_fixtures("""WITH w AS (SELECT p_brand, sum(n) FILTER (band = 0) / sum(n) AS a, sum(n) FILTER (band = 1) / sum(n) AS b, sum(n) FILTER (band = 2) / sum(n) AS c, sum(n) FILTER (band = 3) / sum(n) AS d, CAST(substr(p_brand, 7) AS INT) % 3 AS r FROM fx_shares GROUP BY 1),
f AS (SELECT p_brand, round(a, 6) AS a, CASE WHEN r > 0 THEN round(b, 6) END AS b, CASE WHEN r > 1 THEN round(c, 6) END AS c, round(d, 6) AS d FROM w), g AS (SELECT *, CASE WHEN b IS NULL THEN 1 ELSE 0 END + CASE WHEN c IS NULL THEN 1 ELSE 0 END AS gaps, greatest(1 - (a + coalesce(b, 0) + coalesce(c, 0) + d), 0) AS rest FROM f),
h AS (SELECT CASE WHEN p_brand = 'Brand#1' THEN 'NULL' ELSE p_brand END AS name, a, coalesce(b, rest / gaps) AS b, coalesce(c, rest / gaps) AS c, d FROM g) SELECT name, round(a / (a + b + c + d), 7) AS a, round(b / (a + b + c + d), 7) AS b, round(c / (a + b + c + d), 7) AS c, round(d / (a + b + c + d), 7) AS d FROM h""", "fx_shares"))
def _(spark, d):
    n = lambda i: F.try_divide(F.sum(F.when(F.col("band") == i, F.col("n")).otherwise(0)), F.sum("n"))
    w = fx.shares(spark, d).groupBy("p_brand").agg(*[F.round(n(i), 6).cast("decimal(18,6)").cast("string").alias(c) for i, c in enumerate("abcd")])
    r = F.substring("p_brand", 7, 9).cast("int") % 3
    name = F.when(F.col("p_brand") == "Brand#1", "NULL").otherwise(F.col("p_brand"))
    path = scratch(spark, "shares")
    w.select(name.alias("name"), "a", F.when(r > 0, F.col("b")).otherwise("(S)").alias("b"), F.when(r > 1, F.col("c")).otherwise("(S)").alias("c"), "d").write.option("header", True).csv(path)
    out = sources.fill_suppressed(sources.read_suppressed_csv(spark, path, "name string, a double, b double, c double, d double"), list("abcd"))
    return out.select("name", *[F.round(c, 7).alias(c) for c in "abcd"])


@query("write_full_refresh", """SELECT 'orders' AS table_name, count(*) AS n_rows, CAST(6 AS BIGINT) AS n_cols, 'driver' AS source, 'second' AS note, CAST(2 AS BIGINT) AS n_builds FROM orders
UNION ALL SELECT 'customer', count(*), 5, 'driver', 'first', 1 FROM customer""")
def _(spark, d):
    """The second write of a name replaces the first; the log keeps both."""
    path = scratch(spark, "refresh")
    for name, table, note in (("orders", "customer", "first"), ("customer", "customer", "first"), ("orders", "orders", "second")):
        sources.write_full_refresh(t(spark, d, table), path, name, "driver", note)
    return sources.build_log(spark, path).drop("built_at")


@query("write_sample", """SELECT 'c_custkey' AS variable, 'bigint' AS type, count(*) AS n_rows, CAST(1 AS DOUBLE) AS share_present, CAST(min(c_custkey) AS VARCHAR) AS min_value, CAST(max(c_custkey) AS VARCHAR) AS max_value, 'customer id' AS label FROM customer
UNION ALL SELECT 'c_mktsegment', 'string', count(*), count(c_mktsegment) / count(*), min(c_mktsegment), max(c_mktsegment), NULL FROM customer""")
def _(spark, d):
    return sources.write_sample(t(spark, d, "customer").select("c_custkey", "c_mktsegment"), scratch(spark, "sample"), "customers", ["c_custkey"], {"c_custkey": "customer id"})


@query("merge_curated_overlay", """WITH u AS (SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 4 > 0), s AS (SELECT c_custkey, 'old ' || c_name AS c_name, c_nationkey AS note FROM customer WHERE c_custkey % 3 > 0)
SELECT coalesce(u.c_custkey, s.c_custkey) AS c_custkey, coalesce(u.c_name, s.c_name) AS c_name, u.c_mktsegment, s.note, CAST(u.c_custkey IS NULL AS INT) AS stale FROM u FULL JOIN s ON u.c_custkey = s.c_custkey""")
def _(spark, d):
    c = t(spark, d, "customer")
    sheet = c.where("c_custkey % 3 > 0").select("c_custkey", F.concat(F.lit("old "), "c_name").alias("c_name"), F.col("c_nationkey").alias("note"))
    return sources.merge_curated_overlay(c.where("c_custkey % 4 > 0").select("c_custkey", "c_name", "c_mktsegment"), sheet, "c_custkey", ["note"])


@query("manual_cells", """SELECT 'note' AS "column", count(c_nationkey) AS n_before, count(c_nationkey) AS n_after, CAST(0 AS BIGINT) AS lost FROM customer WHERE c_custkey % 3 > 0""")
def _(spark, d):
    c = t(spark, d, "customer")
    sheet = c.where("c_custkey % 3 > 0").select("c_custkey", "c_name", F.col("c_nationkey").alias("note"))
    return sources.manual_cells(sheet, sources.merge_curated_overlay(c.where("c_custkey % 4 > 0").select("c_custkey", "c_name"), sheet, "c_custkey", ["note"]), ["note"])


@query("verify_source_checksum")
def _(spark, d):
    """Files of two tables against a manifest of their own sums, with one of them changed, one missing and one unlisted."""
    paths = [f"{d}/{n}.parquet" for n in ("region", "nation", "customer")]
    listed = spark.createDataFrame([("gone.parquet", "00"), ("nation.parquet", "changed")], "file_name string, recorded string")
    own = sources.verify_source_checksum(spark, paths[:1], listed.limit(0)).select("file_name", F.col("sha256").alias("recorded"))
    return sources.verify_source_checksum(spark, paths, listed.union(own)).select("file_name", "status")
