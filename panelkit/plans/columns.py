"""Queries of code maps, cleaned measures and feature columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.functions import fold_accents, normalize_name_key
from panelkit.operators import columns
from panelkit.plans import fixtures as fx
from panelkit.registry import query

t = fx.table

PART_CODES = {"small": 1, "large": 2, "red": 3, "blue": 4, "ring": 5, "bolt": 6, "gear": 7}
_CODES = "CASE {} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PART_CODES.items()) + " END"


@query("map_codes_effective_dated", """SELECT o.o_orderkey, CASE WHEN n.n_nationkey < 5 AND year(o.o_orderdate) <= 1997 THEN n.n_nationkey + 100 WHEN n.n_nationkey >= 20 THEN NULL ELSE n.n_nationkey END AS canonical_id
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def _(spark, d):
    n = t(spark, d, "nation")
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("yr"))
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    rows = o.join(c, "o_custkey").join(n.select("n_nationkey", F.concat(F.lit(" "), F.lower("n_name")).alias("code")), "n_nationkey")
    always = n.where("n_nationkey < 20").select(F.col("n_name").alias("alias"), F.col("n_nationkey").alias("id"), F.lit(None).cast("int").alias("valid_to"))
    until = n.where("n_nationkey < 5").select(F.concat("n_name", F.lit(" ")).alias("alias"), (F.col("n_nationkey") + 100).alias("id"), F.lit(1997).alias("valid_to"))
    return columns.map_codes_effective_dated(rows, "code", always.union(until), "canonical_id", "yr").select("o_orderkey", "canonical_id")


@query("split_multi_code", f"""SELECT p_partkey, 2 AS n_codes, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a || ',' || b END AS ids, CAST(NULL AS INT) AS code_id FROM (
SELECT p_partkey, {_CODES.format("split_part(p_name, ' ', 1)")} AS a, {_CODES.format("split_part(p_name, ' ', 2)")} AS b FROM part)
UNION ALL SELECT p_partkey + 1000000, 1, CAST({_CODES.format("split_part(p_name, ' ', 2)")} AS VARCHAR), {_CODES.format("split_part(p_name, ' ', 2)")} FROM part""")
def _(spark, d):
    p = t(spark, d, "part")
    both = p.select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("/")).alias("code"))
    single = p.select((F.col("p_partkey") + 1000000).alias("p_partkey"), F.split("p_name", " ")[1].alias("code"))
    return columns.split_multi_code(both.union(single), "code", PART_CODES).select("p_partkey", "n_codes", F.array_join(F.col("code_ids").cast("array<string>"), ",").alias("ids"), "code_id")


@query("map_first_of", f"SELECT p_partkey, coalesce({_CODES.format('lower(p_type)')}, {_CODES.format("split_part(p_name, ' ', 1)")}) AS kind FROM part")
def _(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.concat(F.lit("T-"), F.lower("p_type")).alias("a"), F.replace("p_name", F.lit(" "), F.lit("/")).alias("b"))
    return columns.map_first_of(p, ["a", "b"], PART_CODES, "kind", prefix="T-").select("p_partkey", "kind")


@query("refine_within_parent", """SELECT p_partkey, parent, coalesce(CASE WHEN l1 <> 'ANY' THEN l1 END, CASE WHEN p2 = parent AND l2 <> 'ANY' THEN l2 END, l1, CASE WHEN p2 = parent THEN l2 END) AS level FROM (
SELECT p_partkey, coalesce(p1, p2) AS parent, p2, CASE WHEN p1 IS NULL THEN NULL WHEN p_size % 3 = 0 THEN 'ANY' ELSE p_brand END AS l1, p_type AS l2 FROM (
SELECT *, CASE WHEN p_size % 5 > 0 THEN split_part(p_name, ' ', 1) END AS p1, CASE WHEN p_size % 2 = 0 THEN split_part(p_name, ' ', 1) ELSE 'other' END AS p2 FROM part))""")
def _(spark, d):
    first = F.split("p_name", " ")[0]
    p = t(spark, d, "part").withColumn("p1", F.when(F.col("p_size") % 5 > 0, first)).withColumn("p2", F.when(F.col("p_size") % 2 == 0, first).otherwise("other"))
    p = p.withColumn("l1", F.when(F.col("p1").isNull(), F.lit(None)).when(F.col("p_size") % 3 == 0, "ANY").otherwise(F.col("p_brand")))
    return columns.refine_within_parent(p, [("p1", "l1"), ("p2", "p_type")], "ANY", "parent", "level").select("p_partkey", "parent", "level")


@query("clean_range", """SELECT o_orderkey, CASE WHEN o_totalprice BETWEEN 20000 AND 400000 THEN o_totalprice END AS o_totalprice, CAST(o_totalprice NOT BETWEEN 20000 AND 400000 AS INT) AS o_totalprice_suspect FROM orders""")
def _(spark, d):
    return columns.clean_range(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), {"o_totalprice": (20000, 400000)})


@query("parse_measure_string", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 > 0 THEN l_linenumber * 12 + l_quantity END AS inches FROM lineitem""")
def _(spark, d):
    text = F.when(F.col("l_linenumber") % 3 > 0, F.concat_ws("-", "l_linenumber", F.col("l_quantity").cast("int"))).otherwise(F.concat_ws("'", "l_linenumber", "l_quantity"))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", columns.parse_measure_string(text).alias("inches"))


@query("normalize_name_key", r"""SELECT doc_id, key, folded FROM (SELECT doc_id,
regexp_replace(regexp_replace(trim(regexp_replace(lower(strip_accents(title)), '[^a-z ]', '', 'g')), '\s+(jr|sr|ii|iii|iv|v)$', ''), '\s+', '', 'g') AS key, lower(strip_accents(title)) AS folded
FROM (SELECT doc_id, split_part(text, chr(10), 1) || ' Jr.' AS title FROM documents))""")
def _(spark, d):
    title = F.concat(F.split("text", "\n")[0], F.lit(" Jr."))
    return t(spark, d, "documents").select("doc_id", normalize_name_key(title).alias("key"), F.lower(fold_accents(title)).alias("folded"))


@query("lookup_candidates", """SELECT p_partkey, CASE WHEN replace(p_name, ' ', '') IN (SELECT k FROM v) THEN replace(p_name, ' ', '') WHEN split_part(p_name, ' ', 1) IN (SELECT k FROM v) THEN split_part(p_name, ' ', 1)
WHEN split_part(p_name, ' ', 2) IN (SELECT k FROM v) THEN split_part(p_name, ' ', 2) ELSE 'ALL OTHER' END AS key,
CAST(replace(p_name, ' ', '') IN (SELECT k FROM v) OR split_part(p_name, ' ', 1) IN (SELECT k FROM v) OR split_part(p_name, ' ', 2) IN (SELECT k FROM v) AS INT) AS matched
FROM part, (SELECT 1) WHERE true""".replace("SELECT p_partkey", "WITH v AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS k FROM part WHERE p_size < 8 AND p_type = 'PROMO' AND p_brand < 'Brand#2' UNION SELECT 'redring') SELECT p_partkey", 1))
def _(spark, d):
    p = t(spark, d, "part")
    words = F.split("p_name", " ")
    vocabulary = p.where("p_size < 8 AND p_type = 'PROMO' AND p_brand < 'Brand#2'").select(words[0].alias("k")).union(spark.createDataFrame([("redring",)], "k string"))
    return columns.lookup_candidates(p, [F.replace("p_name", F.lit(" "), F.lit("")), words[0], words[1]], vocabulary, "k", "ALL OTHER", "key").select("p_partkey", "key", "matched")


@query("unpivot_home_away", """SELECT l_orderkey, l_linenumber, 1 AS is_home, l_suppkey AS team, l_partkey AS opp_team, l_quantity AS pts, l_tax * 500 AS opp_pts, l_discount AS spread,
CAST(l_quantity > l_tax * 500 AS INT) AS won, CAST(l_quantity < l_tax * 500 AS INT) AS lost, CAST(l_quantity = l_tax * 500 AS INT) AS tied FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 0, l_partkey, l_suppkey, l_tax * 500, l_quantity, -l_discount, CAST(l_tax * 500 > l_quantity AS INT), CAST(l_tax * 500 < l_quantity AS INT), CAST(l_tax * 500 = l_quantity AS INT) FROM lineitem""")
def _(spark, d):
    g = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", (F.col("l_tax") * 500).alias("away_pts"), F.col("l_discount").alias("spread"))
    return columns.unpivot_home_away(g, {"team": ("l_suppkey", "l_partkey"), "pts": ("l_quantity", "away_pts")}, ["spread"], "pts")


@query("derived_ratios", """SELECT l_suppkey, round(rev / nullif(qty, 0), 6) AS price, round(late / nullif(never, 0), 6) AS none, round(pow(qty, 2.37) / (pow(qty, 2.37) + pow(n, 2.37)), 9) AS expected FROM (
SELECT l_suppkey, sum(l_extendedprice) AS rev, sum(l_quantity) AS qty, count(*) AS n, sum(l_tax) AS late, sum(CASE WHEN l_quantity < 0 THEN 1.0 ELSE 0.0 END) AS never FROM lineitem GROUP BY 1)""")
def _(spark, d):
    s = t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("rev"), F.sum("l_quantity").alias("qty"), F.count("*").alias("n"), F.sum("l_tax").alias("late"), F.sum(F.when(F.col("l_quantity") < 0, 1.0).otherwise(0.0)).alias("never"))
    out = columns.derived_ratios(s, {"price": ("rev", "qty"), "none": ("late", "never")}, {"expected": ("qty", "n")})
    return out.select("l_suppkey", F.round("price", 6).alias("price"), F.round("none", 6).alias("none"), F.round("expected", 9).alias("expected"))


@query("implied_probability", """WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity - 25.5 AS spread, CASE WHEN l_tax < 0.02 THEN NULL WHEN l_quantity > 25 THEN -100 - 10 * l_quantity ELSE 100 + 10 * l_quantity END AS home, CASE WHEN l_quantity > 25 THEN 100 + 8 * l_quantity ELSE -100 - 8 * l_quantity END AS away FROM lineitem),
p AS (SELECT *, h / (h + a) AS p FROM (SELECT *, CASE WHEN home < 0 THEN -home / (100 - home) WHEN home > 0 THEN 100.0 / (home + 100) END AS h, CASE WHEN away < 0 THEN -away / (100 - away) WHEN away > 0 THEN 100.0 / (away + 100) END AS a FROM g)),
f AS (SELECT sum(spread * ln(p / (1 - p))) / sum(spread * spread) AS b FROM p WHERE p IS NOT NULL),
r AS (SELECT sqrt(avg(pow(p - 1 / (1 + exp(-b * spread)), 2))) AS rmse FROM p, f WHERE p IS NOT NULL)
SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(p, 1 / (1 + exp(-b * spread))), 9) AS p_home, CASE WHEN p IS NOT NULL THEN 'odds' ELSE 'spread' END AS p_source, round(b, 9) AS b, round(rmse, 9) AS rmse FROM p, f, r""")
def _(spark, d):
    q = F.col("l_quantity")
    g = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (q - 25.5).alias("spread"), F.when(F.col("l_tax") < 0.02, F.lit(None)).when(q > 25, -100 - 10 * q).otherwise(100 + 10 * q).alias("home"), F.when(q > 25, 100 + 8 * q).otherwise(-100 - 8 * q).alias("away"))
    out = columns.implied_probability(g, "home", "away", "spread")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("p_home", 9).alias("p_home"), "p_source", F.round("b", 9).alias("b"), F.round("rmse", 9).alias("rmse"))


@query("fill_missing_flag", """SELECT c_custkey, coalesce(n, 0) AS n, coalesce(spend, 0) AS spend, c_acctbal, CAST(n IS NULL AS INT) AS n_miss FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS spend FROM orders WHERE o_orderdate < DATE '1995-06-01' GROUP BY 1) ON o_custkey = c_custkey""")
def _(spark, d):
    o = t(spark, d, "orders").where("o_orderdate < DATE '1995-06-01'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("spend"))
    rows = t(spark, d, "customer").select("c_custkey", "c_acctbal").join(o, "c_custkey", "left")
    return columns.fill_missing_flag(rows, ["n", "spend", "c_acctbal"], base="n")


@query("bin_values", """SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 150000 THEN 'mid' WHEN o_totalprice < 300000 THEN 'high' ELSE 'top' END AS band, CASE WHEN year(o_orderdate) < 1998 THEN 'early' ELSE 'late' END AS era FROM orders""")
def _(spark, d):
    return t(spark, d, "orders").select("o_orderkey", columns.bin_values(F.col("o_totalprice"), [50000, 150000, 300000], ["low", "mid", "high", "top"]).alias("band"), columns.bin_values(F.year("o_orderdate"), [1998], ["early", "late"]).alias("era"))


@query("expand_dummies", """SELECT o_orderkey, CAST(o_orderpriority = '2-HIGH' AS INT) AS p_2_HIGH, CAST(o_orderpriority = '3-MEDIUM' AS INT) AS p_3_MEDIUM, CAST(o_orderpriority = '4-NOT SPECIFIED' AS INT) AS p_4_NOT_SPECIFIED, CAST(o_orderpriority = '5-LOW' AS INT) AS p_5_LOW FROM orders""")
def _(spark, d):
    levels = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    out = columns.expand_dummies(t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "1-URGENT", levels, "p_").drop("o_orderpriority")
    return out.toDF(*[c.replace("-", "_").replace(" ", "_") for c in out.columns])


@query("build_control_design", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag IN ('A', 'R') THEN l_quantity ELSE 0 END AS qty_ar, l_discount AS disc FROM lineitem""")
def _(spark, d):
    controls = [
        {"block": "volume", "name": "qty_ar", "column": "l_quantity", "group": "l_returnflag", "groups": ["A", "R"]},
        {"block": "price", "name": "disc", "column": "l_discount"},
        {"block": "unused", "name": "tax", "column": "l_tax"},
    ]
    out, names = columns.build_control_design(t(spark, d, "lineitem"), controls, ["volume", "price"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", *names)


@query("drop_constant_columns", "SELECT l_orderkey, l_linenumber, l_quantity, CAST(l_returnflag = 'A' AS INT) AS is_a FROM lineitem")
def _(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_returnflag") == "A").cast("int").alias("is_a"), (F.col("l_returnflag") < "B").cast("int").alias("also_a"), (F.col("l_quantity") > 0).cast("int").alias("always"))
    return columns.drop_constant_columns(rows, ["l_quantity", "is_a", "also_a", "always"])


@query("select_measure", fx.with_fixtures("""SELECT source, lang, n, CASE WHEN cov >= 0.4 THEN good END AS share FROM (
SELECT source, lang, count(*) AS n, avg(CAST(quality IS NOT NULL AS INT)) AS cov, avg(quality) AS good FROM fx_labels GROUP BY 1, 2)""", "fx_labels"))
def _(spark, d):
    g = fx.labels(spark, d).groupBy("source", "lang").agg(F.count("*").alias("n"), F.avg(F.col("quality").isNotNull().cast("int")).alias("label_cov"), F.avg("quality").alias("label_share"))
    return columns.select_measure(g, "label", ["share"], "cov", 0.4).select("source", "lang", "n", "share")


@query("apply_policy_registry", """SELECT o_orderkey, CAST(yr BETWEEN 1996 AND coalesce(NULL, 9999) AS INT) AS "RuleA", CAST(yr BETWEEN 1999 AND 2000 AS INT) AS "RuleB", CASE WHEN yr >= 1999 THEN 'RuleB' WHEN yr >= 1996 THEN 'RuleA' END AS era
FROM (SELECT o_orderkey, year(o_orderdate) AS yr FROM orders)""")
def _(spark, d):
    registry = [r.asDict() for r in fx.registry(spark).collect()]
    rows = t(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("yr"))
    return columns.apply_policy_registry(rows, registry, "yr", "full").drop("yr")


_RULES = [(1, "sm.ll", "S", 3), (2, "^(red|blue)$", "C", 2), (3, "r$|rod", "R", 2), (4, "ring|gear", "G", 1)]


@query("classify_by_rules", """WITH f AS (SELECT p_partkey, 0 AS place, split_part(p_name, ' ', 1) AS fragment FROM part UNION ALL SELECT p_partkey, 1, split_part(p_name, ' ', 2) FROM part),
c AS (SELECT *, CASE WHEN regexp_matches(fragment, 'sm.ll') THEN 'S' WHEN regexp_matches(fragment, '^(red|blue)$') THEN 'C' WHEN regexp_matches(fragment, 'r$|rod') THEN 'R' WHEN regexp_matches(fragment, 'ring|gear') THEN 'G' END AS code FROM f),
r AS (SELECT *, CASE code WHEN 'S' THEN 3 WHEN 'C' THEN 2 WHEN 'R' THEN 2 WHEN 'G' THEN 1 END AS rank FROM c)
SELECT *, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY rank NULLS LAST, place) = 1 AS INT) AS is_primary FROM r""")
def _(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit(" / ")).alias("title"))
    return columns.classify_by_rules(p, ["p_partkey"], "title", spark.createDataFrame(_RULES, "rule_order int, pattern string, code string, rank int"))


@query("classify_joined_titles", """WITH w AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_size % 4 = 0 AS mark, p_size % 3 = 0 AS kept FROM part),
c AS (SELECT *, CASE WHEN regexp_matches(a, 'sm.ll') THEN 'S' WHEN regexp_matches(a, '^(red|blue)$') THEN 'C' WHEN regexp_matches(a, 'r$|rod') THEN 'R' WHEN regexp_matches(a, 'ring|gear') THEN 'G' END AS ca, CASE WHEN regexp_matches(b, 'sm.ll') THEN 'S' WHEN regexp_matches(b, '^(red|blue)$') THEN 'C' WHEN regexp_matches(b, 'r$|rod') THEN 'R' WHEN regexp_matches(b, 'ring|gear') THEN 'G' END AS cb,
CASE WHEN kept THEN a || ' and ' || b || ' to all' ELSE a || ' and ' || b END AS j FROM w), s AS (SELECT *, NOT kept AND (coalesce(ca, '') IN ('C', 'G') OR coalesce(cb, '') IN ('C', 'G')) AS apart FROM c),
f AS (SELECT p_partkey, 0 AS place, a AS fragment, ca AS code, mark FROM s WHERE apart UNION ALL SELECT p_partkey, 1, b, cb, mark FROM s WHERE apart
UNION ALL SELECT p_partkey, 0, j, CASE WHEN regexp_matches(j, 'sm.ll') THEN 'S' WHEN regexp_matches(j, '^(red|blue)$') THEN 'C' WHEN regexp_matches(j, 'r$|rod') THEN 'R' WHEN regexp_matches(j, 'ring|gear') THEN 'G' END, mark FROM s WHERE NOT apart),
g AS (SELECT *, min(place) OVER (PARTITION BY p_partkey, code) AS first, max(code = 'G') OVER (PARTITION BY p_partkey) AS has FROM f), o AS (SELECT *, CASE code WHEN 'S' THEN 3 WHEN 'C' THEN 2 WHEN 'R' THEN 2 WHEN 'G' THEN 1 END AS rank FROM g WHERE code IS NULL OR place = first)
SELECT p_partkey, CAST(place AS INT) AS place, fragment, code, rank, CAST(mark AND (NOT coalesce(has, FALSE) OR coalesce(code = 'G', FALSE)) AS INT) AS interim, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY rank NULLS LAST, place) = 1 AS INT) AS is_primary FROM o""")
def _(spark, d):
    """Names joined by "and", parted where a piece stands alone; some say that they are for the time being, some are kept whole."""
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit(" and ")), F.when(F.col("p_size") % 3 == 0, " to all").otherwise(""))
    p = t(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("Interim "), name)).otherwise(name).alias("title"))
    rules = spark.createDataFrame(_RULES, "rule_order int, pattern string, code string, rank int")
    return columns.classify_by_rules(p, ["p_partkey"], "title", rules, joiner=r"\s+and\s+", standalone=["C", "G"], whole=" to all$", interim="\\binterim\\s+", head=["G"], once=True)


@query("detect_unrecorded_periods", """WITH p AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'purchase' AND value <> 0 AND day(ts) % 7 <> 3) AS buys, count(*) FILTER (event_type = 'click' AND value <> 0) AS clicks FROM events GROUP BY 1),
l AS (SELECT day, 'buys' AS stat, buys AS n_nonzero FROM p UNION ALL SELECT day, 'clicks', clicks FROM p), m AS (SELECT stat, quantile_cont(n_nonzero, 0.5) AS median FROM l GROUP BY 1)
SELECT stat, CAST(day AS VARCHAR) AS day, n_nonzero, median, CAST(n_nonzero >= 0.25 * median AS INT) AS recorded FROM l JOIN m USING (stat)""")
def _(spark, d):
    kind, day = F.col("event_type"), F.dayofmonth("ts")
    e = t(spark, d, "events").select(F.col("ts").cast("date").alias("day"), F.when((kind == "purchase") & (day % 7 != 3), F.col("value")).otherwise(0.0).alias("buys"), F.when(kind == "click", F.col("value")).otherwise(0.0).alias("clicks"))
    return columns.detect_unrecorded_periods(e, "day", ["buys", "clicks"]).withColumn("day", F.col("day").cast("string"))


@query("flag_array_categories", """SELECT p_partkey, CAST(len(h) > 0 AS INT) AS metal, array_to_string(h, ',') AS hits FROM (SELECT p_partkey, list_filter(split(p_name, ' '), lambda x: regexp_matches(x, '^r|g') AND NOT regexp_matches(x, 'red')) AS h FROM part)""")
def _(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    return columns.flag_array_categories(p, "words", {"metal": ("^r|g", "red")}).select("p_partkey", "metal", F.array_join("metal_hits", ",").alias("hits"))
