"""Derived tables that the operators are exercised on: a Spark form and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SQL = {
    "fx_nation_year": """SELECT c.c_nationkey AS n_nationkey, CAST(year(o.o_orderdate) AS INT) AS yr, count(*) AS n_orders,
        sum(o.o_totalprice) AS revenue FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2""",
    "fx_cust_month": """SELECT o_custkey AS c_custkey, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INT) AS ym,
        count(*) AS n, sum(o_totalprice) AS spend FROM orders GROUP BY 1, 2""",
    "fx_user_week": """SELECT user_id, wk, min(pr) AS pr, count(*) AS n_rows FROM (
        SELECT user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7 AS INT) AS wk,
        CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 WHEN 'view' THEN 4 ELSE 5 END AS pr
        FROM events) GROUP BY 1, 2""",
    "fx_mirror": """SELECT l_orderkey, CAST(rn - 1 AS INT) AS side, l_suppkey, l_extendedprice FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) rn,
        count(*) OVER (PARTITION BY l_orderkey) n FROM lineitem) WHERE n >= 2 AND rn <= 2""",
    "fx_shares": """SELECT b.p_brand, k.band, count(p.p_partkey) AS n FROM (SELECT DISTINCT p_brand FROM part) b
        CROSS JOIN (VALUES (0), (1), (2), (3)) k(band)
        LEFT JOIN part p ON p.p_brand = b.p_brand AND (p.p_size - 1) * 4 // 50 = k.band GROUP BY 1, 2""",
    "fx_labels": """SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "fx_registry": """SELECT * FROM (VALUES ('RuleA', 1996, 1996, CAST(NULL AS INT)), ('RuleB', 1998, 1999, 2000)) t(indicator, first_season, first_full, last_season)""",
    "fx_design": """SELECT ln(l_extendedprice) AS y, l_quantity AS x1, l_discount AS x2, l_returnflag AS grp,
        CAST(year(l_shipdate) AS INT) AS yr, l_suppkey AS fe, l_partkey AS cl FROM lineitem""",
}


def with_fixtures(body: str, *names: str) -> str:
    """SQL text with the named fixtures in front as common table expressions; the text may have more of them."""
    ours = "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names)
    return f"{ours},\n{body[5:]}" if body.startswith("WITH ") else f"{ours}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation_year(spark, d) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    keyed = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_nationkey").alias("n_nationkey"), F.year("o_orderdate").alias("yr"), "o_totalprice")
    return keyed.groupBy("n_nationkey", "yr").agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("revenue"))


def cust_month(spark, d) -> DataFrame:
    ym = (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).cast("int")
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), ym.alias("ym")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("spend"))


def event_rank(col="event_type"):
    return F.when(F.col(col) == "purchase", 1).when(F.col(col) == "signup", 2).when(F.col(col) == "click", 3).when(F.col(col) == "view", 4).otherwise(5)


def week(col="ts"):
    return F.floor(F.datediff(F.col(col).cast("date"), F.lit("2024-01-01").cast("date")) / 7).cast("int")


def user_week(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", week().alias("wk")).agg(F.min(event_rank()).alias("pr"), F.count("*").alias("n_rows"))


def mirror(spark, d) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey")
    o = w.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    rows = table(spark, d, "lineitem").withColumn("rn", F.row_number().over(o)).withColumn("n", F.count("*").over(w))
    return rows.where("n >= 2 AND rn <= 2").select("l_orderkey", (F.col("rn") - 1).alias("side"), "l_suppkey", "l_extendedprice")


def shares(spark, d) -> DataFrame:
    p = table(spark, d, "part").select("p_brand", F.floor((F.col("p_size") - 1) * 4 / 50).cast("int").alias("band"), "p_partkey")
    grid = p.select("p_brand").distinct().withColumn("band", F.explode(F.array(*map(F.lit, range(4)))))
    return grid.join(p, ["p_brand", "band"], "left").groupBy("p_brand", "band").agg(F.count("p_partkey").alias("n"))


def labels(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")


def registry(spark, d=None) -> DataFrame:
    return spark.createDataFrame([("RuleA", 1996, 1996, None), ("RuleB", 1998, 1999, 2000)], "indicator string, first_season int, first_full int, last_season int")


def design(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.log("l_extendedprice").alias("y"), F.col("l_quantity").alias("x1"), F.col("l_discount").alias("x2"), F.col("l_returnflag").alias("grp"), F.year("l_shipdate").alias("yr"), F.col("l_suppkey").alias("fe"), F.col("l_partkey").alias("cl"))
