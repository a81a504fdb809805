"""Queries of spells, mobility, retention and other outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.operators import spells
from panelkit.plans import fixtures as fx
from panelkit.registry import query

t = fx.table
with_fx = fx.with_fixtures

_WEEK = "CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7 AS INT)"


def user_days(spark, d):
    return t(spark, d, "events").select("user_id", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("day"), "event_type", "event_id", "value", "ts")


_DAYS = "days AS (SELECT user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS day, event_type, event_id, value, ts FROM events)"


@query("mobility_measures", f"""WITH m AS (SELECT l_suppkey % 50 AS person, l_returnflag AS owner, year(l_shipdate) AS yr, CAST(min(l_linenumber) AS INT) AS tier FROM lineitem GROUP BY 1, 2, 3),
ob AS (SELECT DISTINCT owner, yr FROM m WHERE yr % 3 > 0), c AS (SELECT person, yr, row_number() OVER w AS periods_anywhere, lag(o) OVER w AS previous_owners FROM (SELECT person, yr, string_agg(DISTINCT owner, '|' ORDER BY owner) AS o FROM m GROUP BY 1, 2) WINDOW w AS (PARTITION BY person ORDER BY yr))
SELECT m.*, c.periods_anywhere, c.previous_owners, CASE WHEN ob.owner IS NOT NULL THEN CAST(b.person IS NULL AS INT) END AS new_to_owner, CASE WHEN ob.owner IS NOT NULL THEN CAST(coalesce(m.tier < b.tier, false) AS INT) END AS promoted
FROM m JOIN c USING (person, yr) LEFT JOIN ob ON ob.owner = m.owner AND ob.yr = m.yr - 1 LEFT JOIN m b ON b.person = m.person AND b.owner = m.owner AND b.yr = m.yr - 1""")
def _(spark, d):
    line = t(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("person"), F.col("l_returnflag").alias("owner"), F.year("l_shipdate").alias("yr"))
    m = line.agg(F.min("l_linenumber").cast("int").alias("tier"))
    return spells.mobility_measures(m, m.where("yr % 3 > 0"), "person", "owner", "yr", "tier")


@query("incumbent_resolve", """WITH o AS (SELECT l_partkey AS u, CAST(year(l_shipdate) AS INT) AS yr, min(l_suppkey) AS h, CASE WHEN count(*) > 1 THEN max(l_suppkey) END AS a FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2), g AS (SELECT l_partkey AS u, CAST(year(l_shipdate) AS INT) AS yr, arg_min(l_suppkey, CAST(epoch(l_shipdate) AS BIGINT) * 10000 + l_suppkey) AS h FROM lineitem WHERE l_linenumber > 1 GROUP BY 1, 2),
r AS (SELECT u, yr, CASE WHEN o.h IS NOT NULL AND (g.h IS NULL OR o.h = g.h OR coalesce(o.a = g.h, false)) THEN o.h ELSE g.h END AS incumbent, CASE WHEN o.h IS NOT NULL AND (g.h IS NULL OR o.h = g.h OR coalesce(o.a = g.h, false)) THEN 'opening' ELSE 'first_game' END AS source FROM o FULL JOIN g USING (u, yr))
SELECT *, sum(new) OVER (PARTITION BY u ORDER BY yr) AS run_id FROM (SELECT *, CASE WHEN yr - lag(yr) OVER w = 1 AND incumbent = lag(incumbent) OVER w THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY u ORDER BY yr))""".replace("SELECT *, sum(new)", "SELECT u, yr, incumbent, source, CAST(sum(new)").replace("ORDER BY yr) AS run_id", "ORDER BY yr) AS BIGINT) AS run_id"))
def _(spark, d):
    line = t(spark, d, "lineitem").select(F.col("l_partkey").alias("u"), F.year("l_shipdate").alias("yr"), "l_suppkey", "l_linenumber", "l_shipdate")
    opening = line.where("l_linenumber <= 3").groupBy("u", "yr").agg(F.min("l_suppkey").alias("holder"), F.when(F.count("*") > 1, F.max("l_suppkey")).alias("acting"))
    games = line.where("l_linenumber > 1").groupBy("u", "yr").agg(F.min_by("l_suppkey", F.struct("l_shipdate", "l_suppkey")).alias("holder"))
    return spells.incumbent_resolve(opening, games, "u", "yr")


@query("spells_interval_censored", f"""WITH {_DAYS}, s AS (SELECT DISTINCT user_id % 10 AS unit, day FROM days WHERE (user_id + day) % 7 > 0), k AS (SELECT *, row_number() OVER w AS k, lag(day) OVER w AS b, lead(day) OVER w AS a FROM s WINDOW w AS (PARTITION BY unit ORDER BY day)),
l AS (SELECT DISTINCT user_id % 10 AS unit, user_id AS person, event_type AS role, day FROM days WHERE event_type IN ('click', 'view')), r AS (SELECT l.*, k.k, k.b, k.a, k.k - row_number() OVER (PARTITION BY l.unit, person, role ORDER BY k.k) AS run FROM l JOIN k ON l.unit = k.unit AND l.day = k.day)
SELECT unit, person, role, min(day) AS first_seen, max(day) AS last_seen, count(*) AS n_seen, arg_min(struct_pack(x := b), k).x AS entry_lower, arg_max(struct_pack(x := a), k).x AS exit_upper, CAST(arg_min(struct_pack(x := b), k).x IS NULL AS INT) AS left_censored, CAST(arg_max(struct_pack(x := a), k).x IS NULL AS INT) AS right_censored FROM r GROUP BY unit, person, role, run""")
def _(spark, d):
    e = user_days(spark, d).select((F.col("user_id") % 10).alias("unit"), F.col("user_id").alias("person"), F.col("event_type").alias("role"), "day")
    return spells.spells_interval_censored(e.where("(person + day) % 7 > 0"), e.where("role IN ('click', 'view')"), "unit", "day", "person", "role")


@query("reclassify_leak", f"""WITH w AS (SELECT user_id, {_WEEK} AS wk, arg_min(event_type, event_id) AS status FROM events GROUP BY 1, 2), a AS (SELECT DISTINCT user_id, {_WEEK} AS wk FROM events WHERE value > 150), l AS (SELECT DISTINCT user_id FROM w WHERE wk >= 3 AND status IN ('click'))
SELECT user_id, wk, CASE WHEN wk < 2 AND status = 'click' AND (user_id, wk) NOT IN (SELECT (user_id, wk) FROM a) AND user_id NOT IN (SELECT user_id FROM l) THEN 'Unverified' ELSE status END AS status FROM w""")
def _(spark, d):
    e = t(spark, d, "events").withColumn("wk", fx.week())
    w = e.groupBy("user_id", "wk").agg(F.min_by("event_type", "event_id").alias("status"))
    return spells.reclassify_leak(w, e.where("value > 150"), "user_id", "wk", "status", F.col("wk") < 2, ["click"], F.col("wk") >= 3)


@query("season_aggregate_status", f"""WITH {_DAYS}, p AS (SELECT user_id, day // 7 AS wk, day, event_type, event_id % 3 AS owner FROM days)
SELECT user_id, wk, count(*) AS n_weeks, count(*) FILTER (event_type IN ('purchase', 'signup')) AS weeks_active, count(*) FILTER (event_type = 'error') AS weeks_broken, min(day) FILTER (event_type IN ('purchase', 'click')) AS first_employed, max(day) FILTER (event_type IN ('purchase', 'click')) AS last_employed,
min(owner) FILTER (event_type IN ('purchase', 'click') AND day = top) AS end_owner, count(DISTINCT owner) FILTER (event_type IN ('purchase', 'click')) AS n_owners, CAST(min(owner) FILTER (event_type IN ('purchase', 'click') AND day = top) <> max(owner) FILTER (event_type IN ('purchase', 'click') AND day = top) AS INT) AS end_tied,
CASE WHEN bool_or(event_type IN ('purchase', 'click')) THEN 'Employed' WHEN bool_and(event_type = 'error') THEN 'AmbiguousOnly' ELSE 'Other' END AS employment FROM (SELECT *, max(CASE WHEN event_type IN ('purchase', 'click') THEN day END) OVER (PARTITION BY user_id, wk) AS top FROM p) GROUP BY 1, 2""")
def _(spark, d):
    p = user_days(spark, d).select("user_id", F.floor(F.col("day") / 7).cast("int").alias("wk"), "day", "event_type", (F.col("event_id") % 3).alias("owner"))
    return spells.season_aggregate_status(p, ["user_id", "wk"], "day", "event_type", "owner", {"active": ["purchase", "signup"], "broken": ["error"]}, ["purchase", "click"], ["error"])


_SEASONS = "s AS (SELECT o_custkey AS e, CAST(year(o_orderdate) * 2 + (quarter(o_orderdate) - 1) // 2 AS INT) AS p, count(*) FILTER (o_orderstatus <> 'P') AS held, count(*) FILTER (o_totalprice > 250000) AS large, list(DISTINCT o_orderpriority) AS owners, CAST(bool_and(o_orderstatus = 'P') AS INT) AS amb FROM orders GROUP BY 1, 2)"


@query("retention_outcomes", f"""WITH {_SEASONS}, j AS (SELECT s.*, n.held AS nh, n.large AS nl, n.owners AS no, s.p >= 4002 AS cens, CASE WHEN s.p < 4002 THEN coalesce(n.amb, 0) END AS namb FROM s LEFT JOIN s n ON n.e = s.e AND n.p = s.p + 1), f AS (SELECT *, NOT cens AND coalesce(namb = 0, false) AS seen FROM j)
SELECT e, p, CASE WHEN seen THEN CAST(coalesce(nh > 0, false) AS INT) END AS retained, CASE WHEN seen THEN CAST(coalesce(nl > 0, false) AS INT) END AS retained_large, CASE WHEN seen THEN CAST(coalesce(len(list_intersect(owners, no)) > 0, false) AS INT) END AS same_owner, CAST(cens AS INT) AS censored, namb AS next_ambiguous, CAST(seen AS INT) AS observed,
CAST(p IN (3994) AS INT) AS source_break, CAST(seen AND p <> 3994 AS INT) AS in_risk_set, CASE WHEN NOT cens AND namb = 1 THEN 0 WHEN seen THEN CAST(coalesce(nh > 0, false) AS INT) END AS retained_ambiguous_as_exit FROM f""")
def _(spark, d):
    half = (F.year("o_orderdate") * 2 + F.floor((F.quarter("o_orderdate") - 1) / 2)).cast("int")
    s = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("e"), half.alias("p")).agg(
        F.count(F.when(F.col("o_orderstatus") != "P", 1)).alias("held"), F.count(F.when(F.col("o_totalprice") > 250000, 1)).alias("large"), F.collect_set("o_orderpriority").alias("owners"), F.bool_and(F.col("o_orderstatus") == "P").cast("int").alias("amb")
    )
    return spells.retention_outcomes(s, "e", "p", {"retained": "held", "retained_large": "large"}, "owners", "amb", 4002, [3994]).drop("held", "large", "owners", "amb")


@query("effective_start_recurrence", """WITH RECURSIVE c AS (SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) AS INT) AS signed, CASE WHEN o_orderkey % 13 > 0 THEN CAST(1 + o_orderkey % 5 AS INT) END AS years, o_orderpriority < '3' AS ext, row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate), o_orderkey) AS i FROM orders),
r AS (SELECT o_orderkey, o_custkey, i, signed AS eff_start, CASE WHEN years >= 1 THEN signed + years - 1 END AS fin FROM c WHERE i = 1
UNION ALL SELECT o_orderkey, o_custkey, i, s, CASE WHEN years >= 1 THEN s + years - 1 END FROM (SELECT c.*, CASE WHEN c.ext AND r.fin IS NOT NULL THEN greatest(c.signed, least(r.fin + 1, c.signed + 2)) ELSE c.signed END AS s FROM r JOIN c ON c.o_custkey = r.o_custkey AND c.i = r.i + 1))
SELECT o_orderkey, eff_start FROM r""")
def _(spark, d):
    c = t(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("signed"), F.when(F.col("o_orderkey") % 13 > 0, (1 + F.col("o_orderkey") % 5).cast("int")).alias("years"), (F.col("o_orderpriority") < "3").alias("ext"))
    return spells.effective_start_recurrence(c, ["o_custkey"], ["o_orderkey"], "signed", "years", "ext").select("o_orderkey", "eff_start")


_MONTHS = "m AS (SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INT) AS ym FROM orders), n AS (SELECT *, count(*) OVER (PARTITION BY o_custkey, ym) AS k FROM m), s AS (SELECT *, CASE WHEN k > 1 THEN 'ambiguous' WHEN ym > min(CASE WHEN k > 1 THEN ym END) OVER (PARTITION BY o_custkey) THEN 'after_ambiguous' ELSE 'ordered' END AS state FROM n)"


def _ordered(spark, d):
    m = t(spark, d, "orders").select("o_orderkey", "o_custkey", (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).cast("int").alias("ym"))
    return spells.order_events_strict(m, "o_custkey", "ym")


@query("order_events_strict", f"""WITH {_MONTHS} SELECT o_orderkey, o_custkey, ym, state, CASE WHEN state = 'ordered' THEN row_number() OVER (PARTITION BY o_custkey, state ORDER BY ym) END AS event_order, CASE WHEN state = 'ordered' THEN count(*) OVER (PARTITION BY o_custkey, state) END AS n_events,
CASE WHEN state = 'ordered' THEN ym - lag(ym) OVER (PARTITION BY o_custkey, state ORDER BY ym) END AS gap FROM s""")
def _(spark, d):
    return _ordered(spark, d)


@query("event_flow", f"""WITH {_MONTHS}, c AS (SELECT *, count(*) OVER (PARTITION BY o_custkey, state) AS ev FROM s) SELECT count(*) AS n_rows, count(*) FILTER (state = 'ambiguous') AS n_ambiguous, count(*) FILTER (state = 'after_ambiguous') AS n_after, count(*) FILTER (state = 'ordered') AS n_ordered, count(*) FILTER (state = 'ordered' AND ev = 1) AS n_single,
count(*) FILTER (state = 'ordered' AND ev >= 2) AS n_repeat, count(DISTINCT o_custkey) FILTER (state = 'ordered' AND ev >= 2) AS n_repeat_entities, CAST(count(*) = count(*) FILTER (k > 1) + count(*) FILTER (state = 'after_ambiguous') + count(*) FILTER (state = 'ordered') AS INT) AS adds_up FROM c""")
def _(spark, d):
    return spells.event_flow(_ordered(spark, d), "o_custkey")


@query("classify_transitions", """WITH h AS (SELECT l_partkey AS u, CAST(year(l_shipdate) AS INT) AS yr, arg_min(l_suppkey % 4, CAST(epoch(l_shipdate) AS BIGINT) * 100 + l_suppkey % 4) AS f, arg_max(l_suppkey % 4, CAST(epoch(l_shipdate) AS BIGINT) * 100 + l_suppkey % 4) AS l FROM lineitem GROUP BY 1, 2),
p AS (SELECT h.*, b.l AS pl, b.f AS pf, n.f AS nf, h.f <> b.l AS between_, h.f = b.l AND h.f <> b.f AS interim FROM h LEFT JOIN h b ON b.u = h.u AND b.yr = h.yr - 1 LEFT JOIN h n ON n.u = h.u AND n.yr = h.yr + 1),
e AS (SELECT *, EXISTS (SELECT 1 FROM h x WHERE x.u = p.u AND (x.f = p.f OR x.l = p.f) AND x.yr >= p.yr - 2 AND x.yr < p.yr - CAST(coalesce(p.interim, false) AS INT)) AS earlier FROM p),
k AS (SELECT *, CASE WHEN between_ IS NULL THEN NULL WHEN NOT (between_ OR interim) THEN 'none' WHEN between_ AND coalesce(pl = nf, false) THEN 'stand_in' WHEN earlier THEN 'return' WHEN interim THEN 'retained_interim' ELSE 'between_season' END AS transition FROM e)
SELECT u, yr, f, l, transition, CAST(transition IN ('between_season', 'retained_interim') AS INT) AS is_hire FROM k""")
def _(spark, d):
    at, who = F.struct("l_shipdate", "h"), F.col("h")
    line = t(spark, d, "lineitem").select(F.col("l_partkey").alias("u"), F.year("l_shipdate").alias("yr"), "l_shipdate", (F.col("l_suppkey") % 4).alias("h"))
    h = line.groupBy("u", "yr").agg(F.min_by(who, at).alias("f"), F.max_by(who, at).alias("l"))
    return spells.classify_transitions(h, "u", "yr", "f", "l")


@query("predetermined_weights", """WITH m AS (SELECT c_nationkey AS u, o_custkey AS c, CAST(year(o_orderdate) AS INT) AS yr, max(c_acctbal) AS bal, sum(o_totalprice) AS use FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3), f AS (SELECT u, c FROM m WHERE yr = (SELECT min(yr) FROM m x WHERE x.u = m.u))
SELECT m.u, m.yr, count(*) AS n_members, round(sum(m.bal * b.use) FILTER (b.use IS NOT NULL) / sum(b.use), 6) AS weighted, round((SELECT sum(x.use) FROM m x WHERE x.u = m.u AND x.yr = m.yr - 1), 2) AS lagged_usage FROM m JOIN f USING (u, c) LEFT JOIN m b ON b.u = m.u AND b.c = m.c AND b.yr = m.yr - 1 GROUP BY m.u, m.yr""")
def _(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("c"), F.year("o_orderdate").alias("yr"), "o_totalprice")
    m = o.join(t(spark, d, "customer").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("u"), "c_acctbal"), "c").groupBy("u", "c", "yr").agg(F.max("c_acctbal").alias("bal"), F.sum("o_totalprice").alias("use"))
    out = spells.predetermined_weights(m, "u", "c", "yr", "bal", "use")
    return out.select("u", "yr", "n_members", F.round("weighted", 6).alias("weighted"), F.round("lagged_usage", 2).alias("lagged_usage"))


@query("observability_rules", """WITH m AS (SELECT DISTINCT o_custkey AS e, CAST(year(o_orderdate) AS INT) AS yr FROM orders), c AS (SELECT CAST(year(o_orderdate) AS INT) AS yr, bool_and(month(o_orderdate) < 13 AND year(o_orderdate) < 2001) AS ok FROM orders GROUP BY 1),
s AS (SELECT o_custkey AS e, CAST(year(o_orderdate) AS INT) AS yr, sum(o_totalprice) AS v FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2), r AS (SELECT e, yr, coalesce(ok, false) AS ok, CASE WHEN ok THEN coalesce(v, 0) END AS v FROM m LEFT JOIN c USING (yr) LEFT JOIN s USING (e, yr))
SELECT e, count(*) AS n_periods, round(CASE WHEN bool_and(ok) THEN sum(v) END, 2) AS total, round(arg_max(struct_pack(x := v), yr).x, 2) AS final_value FROM r GROUP BY 1""")
def _(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("e"), F.year("o_orderdate").alias("yr"), "o_totalprice", "o_orderpriority")
    out = spells.observability_rules(o.where("o_orderpriority = '1-URGENT'"), o.select("yr", (F.col("yr") < 2001).alias("ok")), "e", "yr", "o_totalprice", "ok", o)
    return out.select("e", "n_periods", F.round("total", 2).alias("total"), F.round("final_value", 2).alias("final_value"))


@query("usage_merge_sources", f"""WITH {_DAYS}, d AS (SELECT user_id, day // 7 AS wk, day, event_type FROM days), a AS (SELECT DISTINCT user_id, wk, day FROM d WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id, wk, day FROM d WHERE event_type = 'view'), g AS (SELECT DISTINCT wk, day FROM d WHERE day % 3 > 0), st AS (SELECT DISTINCT user_id, wk, day FROM d WHERE event_type = 'purchase'),
p AS (SELECT user_id, wk, count(*) AS weeks_played, count(*) FILTER (b.day IS NULL) AS only_a, count(*) FILTER (a.day IS NULL) AS only_b FROM a FULL JOIN b USING (user_id, wk, day) GROUP BY 1, 2)
SELECT p.*, CASE WHEN wk >= 1 THEN (SELECT count(*) FROM st WHERE st.user_id = p.user_id AND st.wk = p.wk AND (st.wk, st.day) IN (SELECT (wk, day) FROM g)) END AS starts FROM p""".replace("count(*) FILTER (b.day IS NULL) AS only_a, count(*) FILTER (a.day IS NULL) AS only_b FROM a FULL JOIN b", "count(*) FILTER (y IS NULL) AS only_a, count(*) FILTER (x IS NULL) AS only_b FROM (SELECT *, 1 AS x FROM a) FULL JOIN (SELECT *, 1 AS y FROM b)"))
def _(spark, d):
    e = user_days(spark, d).select("user_id", F.floor(F.col("day") / 7).cast("int").alias("wk"), "day", "event_type")
    of = lambda kind: e.where(F.col("event_type") == kind)
    return spells.usage_merge_sources(of("click"), of("view"), e.where("day % 3 > 0"), of("purchase"), "user_id", "wk", "day", 1)


@query("multi_total_rows", """SELECT l_suppkey, p, CASE WHEN l_suppkey % 3 > 0 THEN s ELSE 2 * s END AS q, CAST(l_suppkey % 3 = 0 AS INT) AS from_total FROM (SELECT l_suppkey, l_partkey % 10 AS p, sum(l_quantity) AS s FROM lineitem GROUP BY 1, 2) WHERE l_suppkey % 3 > 0 OR l_suppkey % 5 > 0""")
def _(spark, d):
    line = t(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") % 10).alias("p"), F.col("l_quantity").alias("q"))
    totals = line.where("l_suppkey % 5 > 0").groupBy("l_suppkey", "p").agg((2 * F.sum("q")).alias("q"))
    rows = line.where("l_suppkey % 3 > 0").withColumn("is_total", F.lit(False)).unionByName(totals.withColumn("is_total", F.lit(True)))
    return spells.multi_total_rows(rows, ["l_suppkey", "p"], "is_total", ["q"])
