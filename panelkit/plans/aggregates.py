"""Queries of aggregates, reshaping and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.operators import aggregate
from panelkit.operators._state import checkpointed
from panelkit.plans import fixtures as fx
from panelkit.registry import query

t = fx.table
with_fx = fx.with_fixtures


def rounded(df, digits: int, *names: str):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("agg_conditional", """SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS n_clicks, max(value) FILTER (event_type = 'purchase') AS top_purchase, round(sum(value) FILTER (event_type = 'view'), 4) AS viewed, round(avg(value) FILTER (value > 10), 6) AS mean_large FROM events GROUP BY 1""")
def _(spark, d):
    kind, v = F.col("event_type"), F.col("value")
    cells = {"n": ("count", None, None), "n_clicks": ("count", None, kind == "click"), "top_purchase": ("max", v, kind == "purchase"), "viewed": ("sum", v, kind == "view"), "mean_large": ("avg", v, v > 10)}
    return rounded(rounded(aggregate.agg_conditional(t(spark, d, "events"), ["user_id"], cells), 4, "viewed"), 6, "mean_large")


@query("agg_two_level", """SELECT l_suppkey, count(*) AS n_groups, count(*) FILTER (n >= 2 AND change > 0) AS n_kept, round(sum(change) FILTER (n >= 2 AND change > 0), 2) AS total_change, round(max(change) FILTER (n >= 2 AND change > 0), 2) AS top_change
FROM (SELECT l_suppkey, l_returnflag, l_linenumber, count(*) AS n, arg_max(l_quantity, k) - arg_min(l_quantity, k) AS change FROM (SELECT *, l_orderkey * 1000000 + l_partkey AS k FROM lineitem WHERE l_quantity > 3) GROUP BY 1, 2, 3) GROUP BY 1""")
def _(spark, d):
    rows = t(spark, d, "lineitem").where("l_quantity > 3").withColumn("k", F.col("l_orderkey") * 1000000 + F.col("l_partkey"))
    out = aggregate.agg_two_level(rows, ["l_suppkey", "l_returnflag", "l_linenumber"], ["l_suppkey"], "k", "l_quantity", (F.col("n") >= 2) & (F.col("change") > 0))
    return rounded(out, 2, "total_change", "top_change")


@query("agg_season_summary", """SELECT c_nationkey, yr, count(*) AS n_rows, round(sum(o_totalprice), 2) AS total, arg_min(o_custkey, r) AS first_holder, arg_max(o_custkey, r) AS last_holder, count(DISTINCT o_custkey) AS n_holders, round(avg(o_totalprice), 4) AS mean, round(abs(sum(o_totalprice) - sum(o_totalprice)), 2) AS gap
FROM (SELECT *, year(o_orderdate) AS yr, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS r FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1, 2""")
def _(spark, d):
    rows = t(spark, d, "orders").join(t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").withColumn("yr", F.year("o_orderdate"))
    check = fx.nation_year(spark, d).select(F.col("n_nationkey").alias("c_nationkey"), "yr", "revenue")
    out = aggregate.agg_season_summary(rows, ["c_nationkey", "yr"], ["o_orderdate", "o_orderkey"], "o_totalprice", "o_custkey", check, "revenue")
    return rounded(rounded(out.withColumn("gap", F.abs("gap")), 2, "total", "gap"), 4, "mean")


@query("agg_rollup", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag) + grouping(l_linestatus) AS level, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(spark, d):
    return aggregate.agg_rollup(t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], {"n": F.count("*")})


@query("agg_arg_extreme", """SELECT c_custkey, o_orderkey, o_totalprice, n FROM (SELECT DISTINCT o_custkey AS c_custkey FROM orders) LEFT JOIN (SELECT o_custkey, o_orderkey, o_totalprice, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus = 'F') ON o_custkey = c_custkey AND rn = 1""".replace("o_totalprice, n FROM (SELECT DISTINCT", "o_totalprice, coalesce(n, 0) AS n FROM (SELECT DISTINCT", 1))
def _(spark, d):
    o = t(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return aggregate.agg_arg_extreme(o, ["c_custkey"], ["o_orderkey", "o_totalprice"], [F.col("o_orderdate"), F.col("o_orderkey")], F.col("o_orderstatus") == "F")


@query("agg_collect_lists", """SELECT l_suppkey, string_agg(DISTINCT l_linenumber, ',' ORDER BY l_linenumber) AS text, count(DISTINCT l_linenumber) AS n_values, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT x FROM (SELECT l_returnflag AS x, l_suppkey AS s FROM lineitem UNION ALL SELECT l_linestatus, l_suppkey FROM lineitem) WHERE s = l_suppkey)) AS entries FROM lineitem GROUP BY 1""")
def _(spark, d):
    rows = t(spark, d, "lineitem").withColumn("flags", F.array("l_returnflag", "l_linestatus"))
    out = aggregate.agg_collect_lists(rows, ["l_suppkey"], "l_linenumber", "flags")
    return out.select("l_suppkey", "text", "n_values", F.array_join("entries", ",").alias("entries"))


@query("agg_mode_tiebreak", """SELECT o_custkey, o_orderpriority AS mode, n FROM (SELECT o_custkey, o_orderpriority, count(*) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, max(o_orderdate) DESC, o_orderpriority) AS rn FROM orders GROUP BY 1, 2) WHERE rn = 1""")
def _(spark, d):
    return aggregate.agg_mode_tiebreak(t(spark, d, "orders"), ["o_custkey"], "o_orderpriority", "o_orderdate")


@query("agg_weighted", """SELECT l_suppkey, round(sum(x * l_quantity) FILTER (x IS NOT NULL) / sum(l_quantity) FILTER (x IS NOT NULL), 6) AS mean_x, round(sum(l_quantity) FILTER (x IS NOT NULL) / sum(l_quantity), 9) AS coverage_x, round(sum(x), 2) AS sum_x FROM (SELECT *, CASE WHEN l_tax > 0.03 THEN l_extendedprice END AS x FROM lineitem) GROUP BY 1""")
def _(spark, d):
    rows = t(spark, d, "lineitem").withColumn("x", F.when(F.col("l_tax") > 0.03, F.col("l_extendedprice")))
    out = aggregate.agg_weighted(rows, ["l_suppkey"], ["x"], "l_quantity")
    return rounded(rounded(rounded(out, 6, "mean_x"), 9, "coverage_x"), 2, "sum_x")


@query("agg_share_of_total", """WITH m AS (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2), u AS (SELECT *, sum(q) OVER (PARTITION BY l_suppkey) AS total FROM m), s AS (SELECT *, round(q / total, 3) AS printed FROM u),
r AS (SELECT l_suppkey, round(arg_max(q, q * 1000 + printed) / arg_max(printed, q * 1000 + printed)) AS recovered FROM s WHERE printed > 0 GROUP BY 1)
SELECT l_suppkey, l_partkey, q, total, round(q / total, 9) AS share_of_total, recovered FROM u LEFT JOIN r USING (l_suppkey)""")
def _(spark, d):
    m = t(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    shares = aggregate.agg_share_of_total(m, ["l_suppkey"], "l_partkey", "q")
    printed = shares.withColumn("printed", F.round("share_of_total", 3))
    back = aggregate.agg_share_of_total(printed.drop("total", "share_of_total").select("l_suppkey", "l_partkey", "q", "printed"), ["l_suppkey"], "l_partkey", "q", "printed").select("l_suppkey", "l_partkey", F.col("total").alias("recovered"))
    return rounded(shares.join(back, ["l_suppkey", "l_partkey"]), 9, "share_of_total")


@query("agg_quantiles", """SELECT o_orderpriority, count(o_totalprice) AS n, round(quantile_cont(o_totalprice, 0.1), 4) AS q0, round(quantile_cont(o_totalprice, 0.5), 4) AS q1, round(quantile_cont(o_totalprice, 0.99), 4) AS q2,
(SELECT count(*) FROM orders p WHERE p.o_orderpriority = o.o_orderpriority AND p.o_totalprice <= (SELECT quantile_cont(x.o_totalprice, 0.99) FROM orders x WHERE x.o_orderpriority = o.o_orderpriority)) AS n_trimmed FROM orders o GROUP BY 1""")
def _(spark, d):
    o = t(spark, d, "orders").select("o_orderpriority", "o_totalprice")
    kept = aggregate.trim_quantile(o, ["o_orderpriority"], "o_totalprice").groupBy("o_orderpriority").agg(F.count("*").alias("n_trimmed"))
    return rounded(aggregate.agg_quantiles(o, ["o_orderpriority"], "o_totalprice", [0.1, 0.5, 0.99]), 4, "q0", "q1", "q2").join(kept, "o_orderpriority")


@query("pivot_wide", """SELECT user_id, round(sum(value) FILTER (event_type = 'click'), 4) AS click, round(sum(value) FILTER (event_type = 'purchase'), 4) AS purchase, round(sum(value) FILTER (event_type = 'error'), 4) AS error FROM events WHERE event_type IN ('click', 'purchase', 'error') GROUP BY 1""")
def _(spark, d):
    long = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("v"))
    return aggregate.pivot_wide(long, ["user_id"], "event_type", "v", ["click", "purchase", "error"])


@query("crosstab", """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'X') AS "X" FROM orders GROUP BY 1""")
def _(spark, d):
    return aggregate.crosstab(t(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "X"])


@query("unpivot_long", """SELECT l_orderkey, l_linenumber, l_partkey, 'l_quantity' AS stat, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'l_tax', l_tax FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'cheap', l_extendedprice FROM lineitem WHERE l_extendedprice < 20000""")
def _(spark, d):
    rows = t(spark, d, "lineitem").withColumn("cheap", F.when(F.col("l_extendedprice") < 20000, F.col("l_extendedprice")))
    return aggregate.unpivot_long(rows, ["l_orderkey", "l_linenumber", "l_partkey"], ["l_quantity", "l_tax", "cheap"])


@query("set_operations", """SELECT 'all' AS kind, id FROM (SELECT o_custkey AS id FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT user_id FROM events WHERE value > 150) UNION ALL SELECT 'distinct', id FROM (SELECT o_custkey AS id FROM orders WHERE o_totalprice > 400000 UNION SELECT user_id FROM events WHERE value > 150)
UNION ALL SELECT 'difference', id FROM (SELECT o_custkey AS id FROM orders WHERE o_totalprice > 400000 EXCEPT SELECT user_id FROM events WHERE value > 150)""")
def _(spark, d):
    a = t(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("id"))
    b = t(spark, d, "events").where("value > 150").select(F.col("user_id").alias("id"))
    parts = {"all": aggregate.set_union(a, b, keep_all=True), "distinct": aggregate.set_union(a, b), "difference": aggregate.set_difference(a, b, ["id"])}
    out = [df.select(F.lit(k).alias("kind"), "id") for k, df in parts.items()]
    return out[0].union(out[1]).union(out[2])


@query("first_per_group", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, filled, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY filled DESC, l_linenumber, l_partkey, l_suppkey) = 1 AS INT) AS is_primary FROM (SELECT *, CAST(l_tax > 0.04 AS INT) + 1 AS filled FROM lineitem)""")
def _(spark, d):
    rows = t(spark, d, "lineitem").withColumn("known", F.when(F.col("l_tax") > 0.04, F.col("l_tax")))
    rows = rows.withColumn("filled", aggregate.filled_fields(["known", "l_quantity"]))
    out = aggregate.first_per_group(rows, ["l_orderkey"], [F.desc("filled"), "l_linenumber", "l_partkey", "l_suppkey"], "is_primary")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "filled", "is_primary")


@query("rank_within_group", "SELECT c_custkey, rank() OVER w AS place, dense_rank() OVER w AS dense_place, count(*) OVER (PARTITION BY c_nationkey) AS peers FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY round(c_acctbal, -2) DESC)")
def _(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_nationkey", F.round("c_acctbal", -2).alias("bal"))
    return aggregate.rank_within_group(c, ["c_nationkey"], "bal").select("c_custkey", "place", "dense_place", "peers")


@query("group_primary_owner", """SELECT l_partkey, yr, l_suppkey AS primary_owner, n_owners, n_qualifying FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, yr ORDER BY q DESC, n DESC, late DESC, l_suppkey) AS rn, count(*) OVER (PARTITION BY l_partkey, yr) AS n_owners, count(*) FILTER (q > 0) OVER (PARTITION BY l_partkey, yr) AS n_qualifying
FROM (SELECT l_partkey, year(l_shipdate) AS yr, l_suppkey, count(*) FILTER (l_quantity > 25) AS q, count(*) AS n, max(l_shipdate) AS late FROM lineitem GROUP BY 1, 2, 3)) WHERE rn = 1""")
def _(spark, d):
    line = t(spark, d, "lineitem").withColumn("yr", F.year("l_shipdate"))
    return aggregate.group_primary_owner(line, ["l_partkey", "yr"], "l_suppkey", F.col("l_quantity") > 25, "l_shipdate")


@query("compose_group", """WITH m AS (SELECT c_nationkey, year(o_orderdate) AS yr, o_orderstatus AS st, o_totalprice AS w, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN CAST(o_orderpriority = '1-URGENT' AS INT) END AS urgent FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT c_nationkey, yr, count(*) AS all_n, round(count(urgent) / count(*), 9) AS all_urgent_coded, round(sum(urgent * w) / sum(w) FILTER (urgent IS NOT NULL), 9) AS all_urgent_share, count(*) FILTER (st = 'F') AS done_n, round(count(urgent) FILTER (st = 'F') / nullif(count(*) FILTER (st = 'F'), 0), 9) AS done_urgent_coded,
round(sum(urgent * w) FILTER (st = 'F') / sum(w) FILTER (urgent IS NOT NULL AND st = 'F'), 9) AS done_urgent_share FROM m GROUP BY 1, 2""")
def _(spark, d):
    p = F.col("o_orderpriority")
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("yr"), "o_orderstatus", "o_totalprice", F.when(p != "4-NOT SPECIFIED", (p == "1-URGENT").cast("int")).alias("urgent"))
    m = o.join(t(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    out = aggregate.compose_group(m, ["c_nationkey", "yr"], {"all": F.lit(True), "done": F.col("o_orderstatus") == "F"}, "o_totalprice", ["urgent"])
    return rounded(out, 9, "all_urgent_coded", "all_urgent_share", "done_urgent_coded", "done_urgent_share")


@query("diversity_index", """WITH p AS (SELECT c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.8 ELSE 0.1 END AS a, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.1 ELSE 0.6 END AS b, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.1 ELSE 0.3 END AS c FROM customer)
SELECT c_nationkey, count(*) AS n, round(CASE WHEN count(*) >= 2 THEN 1 - (pow(sum(CAST(a AS DOUBLE)), 2) - sum(CAST(a AS DOUBLE) * a) + pow(sum(CAST(b AS DOUBLE)), 2) - sum(CAST(b AS DOUBLE) * b) + pow(sum(CAST(c AS DOUBLE)), 2) - sum(CAST(c AS DOUBLE) * c)) / (count(*) * (count(*) - 1)) END, 8) AS blau FROM p GROUP BY 1""")
def _(spark, d):
    own = F.col("c_mktsegment") == "BUILDING"
    p = t(spark, d, "customer").select("c_nationkey", F.when(own, 0.8).otherwise(0.1).alias("a"), F.when(own, 0.1).otherwise(0.6).alias("b"), F.when(own, 0.1).otherwise(0.3).alias("c"))
    return rounded(aggregate.diversity_index(p, ["c_nationkey"], ["a", "b", "c"]), 8, "blau")


@query("expected_share_loo", """WITH m AS (SELECT year(o_orderdate) AS yr, c_nationkey AS g, o_orderpriority AS cat, CAST(o_orderstatus = 'F' AS INT) AS x, o_totalprice AS w FROM orders JOIN customer ON o_custkey = c_custkey),
o AS (SELECT yr, g, cat, sum(w) AS w, sum(w * x) AS x FROM m GROUP BY 1, 2, 3), r AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY yr, cat) > 1 THEN (sum(x) OVER (PARTITION BY yr, cat) - x) / nullif(sum(w) OVER (PARTITION BY yr, cat) - w, 0) END AS p FROM o)
SELECT yr, g, round(sum(x) / sum(w), 8) AS observed, round(sum(p * w) / sum(w) FILTER (p IS NOT NULL), 8) AS expected, round(sum(x) / sum(w) - sum(p * w) / sum(w) FILTER (p IS NOT NULL), 8) AS residual FROM r GROUP BY 1, 2""")
def _(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("yr"), F.col("o_orderpriority").alias("cat"), (F.col("o_orderstatus") == "F").cast("int").alias("x"), F.col("o_totalprice").alias("w"))
    m = o.join(t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("g")), "c_custkey")
    return rounded(aggregate.expected_share_loo(m, ["g"], ["yr"], "cat", "x", "w"), 8, "observed", "expected", "residual")


@query("share_uncertainty", with_fx("""SELECT lang, round(sum(q * w) / sum(w) FILTER (q IS NOT NULL), 9) AS share, round(sum(w * w * q * (1 - q)) / pow(sum(w) FILTER (q IS NOT NULL), 2), 12) AS variance, count(q) AS n_known, round(sum(q * w) / sum(w), 9) AS lower, round(sum(coalesce(q, 1) * w) / sum(w), 9) AS upper,
round(sqrt(sum(q * w) / sum(w) FILTER (q IS NOT NULL) * (1 - sum(q * w) / sum(w) FILTER (q IS NOT NULL)) / count(q)), 9) AS binomial_se FROM (SELECT lang, 0.1 + 0.8 * CAST(quality AS DOUBLE) AS q, CAST(n_chars AS DOUBLE) AS w FROM fx_labels) GROUP BY 1""", "fx_labels"))
def _(spark, d):
    rows = fx.labels(spark, d).select("lang", (0.1 + 0.8 * F.col("quality").cast("double")).alias("q"), "n_chars")
    return rounded(rounded(aggregate.share_uncertainty(rows, ["lang"], "q", "n_chars"), 9, "share", "lower", "upper", "binomial_se"), 12, "variance")


def _score_sql(rows: str, value: str) -> str:
    """id and score of ``value`` among all rows of the class up to the row's year."""
    return f"""(WITH c AS (SELECT cls, yr, {value} AS v, count(*) AS n FROM {rows} WHERE {value} IS NOT NULL GROUP BY 1, 2, 3), s AS (SELECT a.cls, a.yr, a.v, CASE WHEN sum(b.n) >= 10 THEN 10 * sum(CASE WHEN b.v < a.v THEN b.n WHEN b.v = a.v THEN b.n / 2 ELSE 0 END) / sum(b.n) END AS score
FROM c a JOIN c b ON a.cls = b.cls AND b.yr <= a.yr GROUP BY 1, 2, 3) SELECT o_orderkey, score FROM {rows} r LEFT JOIN s ON r.cls = s.cls AND r.yr = s.yr AND r.{value} = s.v)"""


@query("percentile_score_cumulative", f"""WITH r AS (SELECT o_orderkey, o_orderpriority AS cls, year(o_orderdate) AS yr, o_totalprice AS v FROM orders) SELECT o_orderkey, round(score, 8) AS score FROM {_score_sql("r", "v")}""")
def _(spark, d):
    r = t(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("cls"), F.year("o_orderdate").alias("yr"), F.col("o_totalprice").alias("v"))
    return rounded(aggregate.percentile_score_cumulative(r, ["cls"], "yr", "v"), 8, "score").select("o_orderkey", "score")


_PARTS = ["lines", "quantity", "price", "discount", "tax", "suppliers"]
_PART_ROWS = """r AS (SELECT o_orderkey, o_orderpriority AS cls, year(o_orderdate) AS yr, count(l_orderkey) AS lines, sum(l_quantity) AS quantity, CASE WHEN o_orderkey % 11 > 0 THEN o_totalprice END AS price, CAST(round(100 * sum(l_discount)) AS INT) AS discount, CAST(round(100 * sum(l_tax)) AS INT) AS tax, count(DISTINCT l_suppkey) AS suppliers
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, cls, yr, o_totalprice)"""


@query("composite_rescore", f"""WITH {_PART_ROWS}, {", ".join(f"s_{c} AS {_score_sql('r', c)}" for c in _PARTS)},
m AS (SELECT o_orderkey, cls, yr, CASE WHEN {" AND ".join(f"s_{c}.score IS NOT NULL" for c in _PARTS)} THEN round(({" + ".join(f"s_{c}.score" for c in _PARTS)}) / 6, 7) END AS composite FROM r {" ".join(f"JOIN s_{c} USING (o_orderkey)" for c in _PARTS)})
SELECT o_orderkey, composite, round(score, 8) AS score FROM m JOIN {_score_sql("m", "composite")} USING (o_orderkey)""")
def _(spark, d):
    """Six measures of an order, each scored among its class so far; their mean where all are known, scored again."""
    line = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"), F.round(100 * F.sum("l_discount")).cast("int").alias("discount"), F.round(100 * F.sum("l_tax")).cast("int").alias("tax"), F.countDistinct("l_suppkey").alias("suppliers"))
    r = t(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("cls"), F.year("o_orderdate").alias("yr"), F.when(F.col("o_orderkey") % 11 > 0, F.col("o_totalprice")).alias("price")).join(line, "o_orderkey")
    r = checkpointed(r.withColumn("row", F.monotonically_increasing_id()))
    base = r.select("row", "o_orderkey", "cls", "yr")
    for c in _PARTS:
        scored = aggregate.percentile_score_cumulative(r, ["cls"], "yr", c)
        base = base.join(scored.select("row", F.col("score").alias(f"s_{c}")), "row")
    r = checkpointed(base.withColumn("composite", F.round(aggregate.composite_score([f"s_{c}" for c in _PARTS]), 7)))
    return rounded(aggregate.percentile_score_cumulative(r, ["cls"], "yr", "composite"), 8, "score").select("o_orderkey", "composite", "score")


@query("modal_mass_reference", """WITH c AS (SELECT CAST(floor(l_quantity) AS INT) % 9 AS cell, round(l_tax + CASE WHEN l_quantity > 30 THEN l_discount ELSE 0 END, 2) AS v, count(*) AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT cell, sum(n) AS n, max(n) AS top, arg_max(v, n * 1000 - v) AS modal FROM c GROUP BY 1),
g AS (SELECT cell, n, CASE WHEN top >= 3 AND top >= 0.1 * n THEN modal END AS modal FROM m), f AS (SELECT *, last_value(modal IGNORE NULLS) OVER (ORDER BY cell) AS reference FROM g)
SELECT cell, CAST(n AS BIGINT) AS n, modal, reference, max(reference) OVER (ORDER BY cell) AS running_max FROM f""")
def _(spark, d):
    rows = t(spark, d, "lineitem").select((F.floor("l_quantity").cast("int") % 9).alias("cell"), (F.col("l_tax") + F.when(F.col("l_quantity") > 30, F.col("l_discount")).otherwise(0)).alias("v"))
    return aggregate.modal_mass_reference(rows, "cell", "v")


@query("select_authoritative", """WITH r AS (SELECT user_id, CAST(ts AS DATE) AS day, value, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 0 ELSE 1 END AS tier, event_type = 'error' AS bad FROM events), b AS (SELECT user_id, day, first(value ORDER BY tier, bad, value) AS chosen, count(*) AS n_values, min(tier) AS best FROM r GROUP BY 1, 2)
SELECT user_id, CAST(day AS VARCHAR) AS day, chosen, n_values, len(list_distinct(list(value) FILTER (value <> chosen))) AS n_alternatives, median(value) FILTER (tier = best) AS tier_median FROM r JOIN b USING (user_id, day) GROUP BY ALL""")
def _(spark, d):
    kind = F.col("event_type")
    r = t(spark, d, "events").select("user_id", F.col("ts").cast("date").cast("string").alias("day"), "value", F.when(kind.isin("purchase", "signup"), 0).otherwise(1).alias("tier"), (kind == "error").alias("bad"))
    out = aggregate.select_authoritative(r, ["user_id", "day"], "value", [F.col("tier"), F.col("bad")])
    n = F.when(F.col("alternatives") == "", None).otherwise(F.size(F.split("alternatives", ";")))
    return out.withColumn("n_alternatives", n).select("user_id", "day", "chosen", "n_values", "n_alternatives", "tier_median")


@query("series_with_basis", """WITH s AS (SELECT c_nationkey, year(o_orderdate) AS yr, CASE WHEN c_nationkey % 3 > 0 THEN count(*) FILTER (o_orderstatus = 'F') END AS cnt, CASE WHEN c_nationkey % 4 > 0 THEN round(100 * avg(CAST(o_orderstatus = 'F' AS INT))) END AS pct, count(*) AS base FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT c_nationkey, yr, CASE WHEN cnt IS NOT NULL AND yr > 1996 THEN round(100.0 * cnt / base, 8) WHEN cnt IS NULL THEN pct END AS percent_used, CASE WHEN cnt IS NOT NULL AND yr > 1996 THEN 'derived' WHEN cnt IS NULL AND pct IS NOT NULL THEN 'printed' END AS basis FROM s""")
def _(spark, d):
    o = t(spark, d, "orders").join(t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").groupBy("c_nationkey", F.year("o_orderdate").alias("yr"))
    done = (F.col("o_orderstatus") == "F").cast("int")
    s = o.agg(F.sum(done).alias("c"), F.round(100 * F.avg(done)).alias("p"), F.count("*").alias("base"))
    series = s.select("c_nationkey", "yr", F.when(F.col("c_nationkey") % 3 > 0, F.col("c")).alias("cnt"), F.when(F.col("c_nationkey") % 4 > 0, F.col("p")).alias("pct"))
    out = aggregate.series_with_basis(series, s.where("yr > 1996"), ["c_nationkey", "yr"], "cnt", "pct", "base")
    return rounded(out, 8, "percent_used").select("c_nationkey", "yr", "percent_used", "basis")


@query("assign_first_tier", """SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000) THEN 'top' WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate < DATE '1995-03-01') THEN 'early' WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'any' ELSE 'none' END AS tier FROM customer""")
def _(spark, d):
    o = t(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return aggregate.assign_first_tier(t(spark, d, "customer").select("c_custkey"), "c_custkey", [("top", o.where("o_totalprice > 480000")), ("early", o.where("o_orderdate < DATE '1995-03-01'")), ("any", o)])


@query("topk_context_list", """SELECT user_id, array_to_string(list(item ORDER BY r) FILTER (r <= 3), '; ') || CASE WHEN count(*) > 3 THEN '; +' || (count(*) - 3) || ' more' ELSE '' END AS context, count(*) AS n_items
FROM (SELECT user_id, event_type || ' ' || event_id AS item, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_type || ' ' || event_id) AS r FROM events) GROUP BY 1""")
def _(spark, d):
    e = t(spark, d, "events").select("user_id", F.concat_ws(" ", "event_type", "event_id").alias("item"), "value")
    return aggregate.topk_context_list(e, ["user_id"], "item", [-F.col("value")], 3)


@query("pool_evidence", """WITH s AS (SELECT o_custkey AS e, o_orderstatus AS src, CASE WHEN o_orderpriority < '3' THEN 'high' WHEN o_orderpriority < '5' THEN 'mid' END AS cat FROM orders), k AS (SELECT e, src, min(cat) AS lo, max(cat) AS hi FROM s WHERE cat IS NOT NULL GROUP BY 1, 2),
p AS (SELECT e, count(*) AS n_sources, bool_or(lo <> hi) AS multi, min(lo) AS a, max(hi) AS b, arg_min(lo, CASE src WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END) AS first FROM k GROUP BY 1)
SELECT e, n_sources, CASE WHEN multi THEN 'multi' WHEN a = b THEN 'agreed' ELSE 'conflict' END AS status, CASE WHEN NOT multi THEN first END AS label FROM p""")
def _(spark, d):
    p = F.substring("o_orderpriority", 1, 1).cast("int")
    s = t(spark, d, "orders").select(F.col("o_custkey").alias("e"), F.col("o_orderstatus").alias("src"), F.when(p < 3, "high").when(p < 5, "mid").alias("cat"))
    return aggregate.pool_evidence(s, "e", "src", "cat", ["P", "F"])


@query("agreement_kappa", with_fx("""WITH k AS (SELECT lang, quality AS a, CASE WHEN n_chars % 5 = 0 THEN 1 - quality ELSE quality END AS b FROM fx_labels WHERE quality IS NOT NULL),
p AS (SELECT lang, count(*) AS n, avg(CAST(a = b AS INT)) AS po, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS pe, count(*) FILTER (a = 1 AND b = 1) / nullif(count(*) FILTER (a = 1), 0) AS sens, count(*) FILTER (a = 0 AND b = 0) / nullif(count(*) FILTER (a = 0), 0) AS spec, count(*) FILTER (a = 1 AND b = 1) / nullif(count(*) FILTER (b = 1), 0) AS ppv FROM k GROUP BY 1)
SELECT lang, n, round(po, 9) AS agreement, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 9) AS kappa, round(sens, 9) AS sensitivity, round(spec, 9) AS specificity, round(ppv, 9) AS ppv FROM p""", "fx_labels"))
def _(spark, d):
    rows = fx.labels(spark, d).where("quality IS NOT NULL").select("lang", F.col("quality").alias("a"), F.when(F.col("n_chars") % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("b"))
    out = aggregate.agreement_kappa(rows, "a", "b", ["lang"]).join(aggregate.confusion_rates(rows, F.col("a"), F.col("b"), ["lang"]), "lang")
    return rounded(out, 9, "agreement", "kappa", "sensitivity", "specificity", "ppv")


@query("adjudication_list", with_fx("""SELECT doc_id, quality AS a, b, reasons FROM (SELECT *, concat_ws('; ', CASE WHEN quality <> b THEN 'coders disagree' END, CASE WHEN (quality IS NULL) <> (b IS NULL) THEN 'one coder only' END, CASE WHEN n_chars < 200 THEN 'short text' END) AS reasons
FROM (SELECT doc_id, n_chars, quality, CASE WHEN n_chars % 7 = 0 THEN NULL WHEN n_chars % 5 = 0 THEN 1 - quality ELSE quality END AS b FROM fx_labels)) WHERE reasons <> ''""", "fx_labels"))
def _(spark, d):
    other = F.when(F.col("n_chars") % 7 != 0, F.when(F.col("n_chars") % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    rows = fx.labels(spark, d).select("doc_id", "n_chars", F.col("quality").alias("a"), other.alias("b"))
    return aggregate.adjudication_list(rows, ["doc_id"], "a", "b", {"short text": F.col("n_chars") < 200})


@query("era_summary", """WITH s AS (SELECT year(o_orderdate) AS yr, o_orderpriority, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2), e AS (SELECT 'early' AS era, * FROM s WHERE yr <= 1997 UNION ALL SELECT 'late', * FROM s WHERE yr >= 1998 UNION ALL SELECT 'all', * FROM s)
SELECT o_orderpriority, era, count(*) AS n, round(avg(v), 4) AS mean, round(min(v), 4) AS low, round(max(v), 4) AS high FROM e GROUP BY 1, 2""")
def _(spark, d):
    s = t(spark, d, "orders").groupBy(F.year("o_orderdate").alias("yr"), "o_orderpriority").agg(F.avg("o_totalprice").alias("v"))
    out = aggregate.era_summary(s, "yr", "v", {"early": (None, 1997), "late": (1998, None), "all": (None, None)}, ["o_orderpriority"])
    return rounded(out, 4, "mean", "low", "high")


@query("coverage_table", with_fx("""WITH c AS (SELECT lang, source, avg(CAST(quality IS NOT NULL AS INT)) AS cov FROM fx_labels GROUP BY 1, 2) SELECT doc_id, CASE WHEN cov >= 0.4 THEN quality END AS quality, round(cov, 9) AS cov FROM fx_labels JOIN c USING (lang, source)""", "fx_labels"))
def _(spark, d):
    rows = fx.labels(spark, d)
    cov = aggregate.coverage_table(rows, ["lang", "source"], ["quality"]).select("lang", "source", F.round("cov_quality", 9).alias("cov"))
    return aggregate.gate_by_coverage(rows, ["lang", "source"], ["quality"], 0.4).join(cov, ["lang", "source"]).select("doc_id", "quality", "cov")


@query("benchmark_gap", """WITH a AS (SELECT year(o_orderdate) AS yr, month(o_orderdate) AS mo, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2), b AS (SELECT year(l_shipdate) AS yr, month(l_shipdate) AS mo, avg(l_extendedprice) * 6 AS p FROM lineitem GROUP BY 1, 2)
SELECT yr, count(*) AS n, round(avg(v - p), 4) AS mean_gap, round(avg(abs(v - p)), 4) AS mae, round(CASE WHEN count(*) >= 3 THEN corr(v, p) END, 7) AS correlation, round(avg(CAST(v BETWEEN 0.9 * p AND 1.1 * p AS INT)), 9) AS inside FROM a JOIN b USING (yr, mo) GROUP BY 1""")
def _(spark, d):
    ym = lambda c: [F.year(c).alias("yr"), F.month(c).alias("mo")]
    a = t(spark, d, "orders").groupBy(*ym("o_orderdate")).agg(F.avg("o_totalprice").alias("v"))
    b = t(spark, d, "lineitem").groupBy(*ym("l_shipdate")).agg((F.avg("l_extendedprice") * 6).alias("p")).withColumns({"lo": 0.9 * F.col("p"), "hi": 1.1 * F.col("p")})
    out = aggregate.benchmark_gap(a, b, ["yr", "mo"], ["yr"], "v", "p", "lo", "hi")
    return rounded(rounded(rounded(out, 4, "mean_gap", "mae"), 7, "correlation"), 9, "inside")


@query("summary_by_group", """SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS mean_l_extendedprice, round(sum(l_discount * 10), 4) AS expected_n FROM lineitem GROUP BY 1""")
def _(spark, d):
    rows = t(spark, d, "lineitem").withColumn("p", F.col("l_discount") * 10)
    return rounded(aggregate.summary_by_group(rows, "l_returnflag", ["l_extendedprice"], "l_quantity", "p"), 4, "mean_l_extendedprice", "expected_n")

