"""Queries of the panel operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.operators import panel
from panelkit.plans import fixtures as fx
from panelkit.registry import query

with_fx = fx.with_fixtures


@query("lag_consecutive", with_fx("""SELECT a.n_nationkey, a.yr, round(a.revenue, 2) AS revenue, round(b.revenue, 2) AS revenue_before
FROM fx_nation_year a LEFT JOIN fx_nation_year b ON a.n_nationkey = b.n_nationkey AND b.yr = a.yr - 1""", "fx_nation_year"))
def _(spark, d):
    out = panel.lag_consecutive(fx.nation_year(spark, d), ["n_nationkey"], "yr", "revenue", "revenue_before")
    return out.select("n_nationkey", "yr", F.round("revenue", 2).alias("revenue"), F.round("revenue_before", 2).alias("revenue_before"))


@query("change_flags", """WITH e AS (SELECT user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7 AS INT) AS wk, event_type, event_id FROM events),
p AS (SELECT user_id, wk, count(DISTINCT event_type) AS n_holders, arg_min(event_type, event_id) AS first_holder, arg_max(event_type, event_id) AS last_holder FROM e GROUP BY 1, 2)
SELECT a.*, b.last_holder AS previous_holder, CAST(a.n_holders > 1 AS INT) AS changed_within, CAST(a.first_holder <> b.last_holder AS INT) AS changed_before
FROM p a LEFT JOIN p b ON a.user_id = b.user_id AND b.wk = a.wk - 1""")
def _(spark, d):
    e = fx.table(spark, d, "events").select("user_id", fx.week().alias("wk"), "event_type", F.col("event_id").alias("seq"))
    return panel.change_flags(e, ["user_id"], "wk", "event_type", "seq")


_RUNS = """r AS (SELECT c_custkey, ym, ym - row_number() OVER (PARTITION BY c_custkey ORDER BY ym) AS g FROM fx_cust_month)"""


@query("runs_islands", with_fx(_RUNS.replace("r AS (", "SELECT c_custkey, ym, dense_rank() OVER (PARTITION BY c_custkey ORDER BY g) AS run_id, row_number() OVER (PARTITION BY c_custkey, g ORDER BY ym) AS position, CAST(min(ym) OVER (PARTITION BY c_custkey, g) = 23940 AS INT) AS left_censored FROM (", 1), "fx_cust_month"))
def _(spark, d):
    return panel.runs_islands(fx.cust_month(spark, d).select("c_custkey", "ym"), ["c_custkey"], "ym", F.lit(1995 * 12))


@query("format_spans", with_fx(f"""SELECT c_custkey, string_agg(t, ', ' ORDER BY lo) AS spans FROM (
SELECT c_custkey, min(ym) AS lo, CASE WHEN min(ym) = max(ym) THEN CAST(min(ym) AS VARCHAR) ELSE min(ym) || '-' || max(ym) END AS t
FROM ({_RUNS[6:-1]}) GROUP BY c_custkey, g) GROUP BY 1""", "fx_cust_month"))
def _(spark, d):
    return panel.format_spans(fx.cust_month(spark, d), ["c_custkey"], "ym")


@query("dedupe_priority_weeks", """SELECT user_id, wk, event_id, event_type, n_candidates FROM (
SELECT *, count(*) OVER (PARTITION BY user_id, wk) AS n_candidates, row_number() OVER (PARTITION BY user_id, wk ORDER BY pr, value DESC, event_id) AS rn FROM (
SELECT user_id, event_id, event_type, value, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7 AS INT) AS wk,
CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 WHEN 'view' THEN 4 ELSE 5 END AS pr FROM events)) WHERE rn = 1""")
def _(spark, d):
    e = fx.table(spark, d, "events").withColumn("wk", fx.week()).withColumn("pr", fx.event_rank())
    return panel.dedupe_priority(e, ["user_id", "wk"], [F.col("pr"), -F.col("value"), F.col("event_id")]).select("user_id", "wk", "event_id", "event_type", "n_candidates")


@query("count_spells_bye", with_fx("""SELECT c_custkey, sum(CASE WHEN owner = po AND (gap = 1 OR (gap = 2 AND excused)) THEN 0 ELSE 1 END) AS n_spells, count(*) AS n_periods FROM (
SELECT *, ym - lag(ym) OVER w AS gap, lag(owner) OVER w AS po FROM (SELECT c_custkey, ym, n > 1 AS owner, ym % 12 = 1 AS excused FROM fx_cust_month)
WINDOW w AS (PARTITION BY c_custkey ORDER BY ym)) GROUP BY 1""", "fx_cust_month"))
def _(spark, d):
    m = fx.cust_month(spark, d).select("c_custkey", "ym", (F.col("n") > 1).alias("owner"), (F.col("ym") % 12 == 1).alias("excused"))
    return panel.count_spells(m, ["c_custkey"], "ym", "owner", "excused")


@query("next_period_outcomes", with_fx("""SELECT a.c_custkey, a.ym, CASE WHEN a.ym + 1 <= 24018 THEN CAST(b.ym IS NOT NULL AS INT) END AS back_next
FROM fx_cust_month a LEFT JOIN fx_cust_month b ON a.c_custkey = b.c_custkey AND b.ym = a.ym + 1""", "fx_cust_month"))
def _(spark, d):
    return panel.next_period_outcome(fx.cust_month(spark, d).select("c_custkey", "ym"), ["c_custkey"], "ym", 2001 * 12 + 6, "back_next")


@query("first_event_hazard", with_fx("""SELECT user_id, wk, f AS first_event, CAST(coalesce(wk <= f, true) AS INT) AS at_risk, CAST(coalesce(wk < f, true) AS INT) AS before,
CAST(coalesce(wk = f, false) AS INT) AS event_now FROM (SELECT *, min(CASE WHEN pr = 1 THEN wk END) OVER (PARTITION BY user_id) AS f FROM fx_user_week)""", "fx_user_week"))
def _(spark, d):
    return panel.first_event_hazard(fx.user_week(spark, d).select("user_id", "wk", "pr"), ["user_id"], "wk", F.col("pr") == 1).drop("pr")


@query("career_to_date", with_fx("""SELECT c_custkey, ym, n, CAST(sum(n) OVER (PARTITION BY c_custkey ORDER BY ym ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS n_before FROM fx_cust_month""", "fx_cust_month"))
def _(spark, d):
    return panel.career_to_date(fx.cust_month(spark, d).select("c_custkey", "ym", "n"), ["c_custkey"], "ym", ["n"])


@query("prior_count", with_fx("SELECT c_custkey, ym, dense_rank() OVER (PARTITION BY c_custkey ORDER BY ym) - 1 AS n_prior FROM fx_cust_month", "fx_cust_month"))
def _(spark, d):
    return panel.prior_count(fx.cust_month(spark, d).select("c_custkey", "ym"), ["c_custkey"], "ym")


@query("expand_spans", """SELECT c_custkey, unnest(generate_series(greatest(lo, 1996), least(hi, 1999))) AS yr FROM (
SELECT o_custkey AS c_custkey, year(min(o_orderdate)) AS lo, CASE WHEN year(max(o_orderdate)) >= 2001 THEN 1999 ELSE year(max(o_orderdate)) END AS hi FROM orders GROUP BY 1) WHERE greatest(lo, 1996) <= least(hi, 1999)""")
def _(spark, d):
    last = F.year(F.max("o_orderdate"))
    o = fx.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.year(F.min("o_orderdate")).alias("lo"), F.when(last < 2001, last).alias("hi"))
    return panel.expand_spans(o, "lo", "hi", 1996, 1999, "yr").select("c_custkey", "yr")


@query("adjacent_change", with_fx("""SELECT a.n_nationkey, a.yr, a.n_orders - b.n_orders AS d_n_orders FROM fx_nation_year a LEFT JOIN fx_nation_year b ON a.n_nationkey = b.n_nationkey AND b.yr = a.yr - 1""", "fx_nation_year"))
def _(spark, d):
    return panel.adjacent_change(fx.nation_year(spark, d).select("n_nationkey", "yr", "n_orders"), ["n_nationkey"], "yr", ["n_orders"]).drop("n_orders")


@query("collapse_roles", """SELECT user_id, day, arg_min(event_type, pr) AS primary_role, count(DISTINCT event_type) AS n_roles, max(CAST(event_type = 'error' AS INT)) AS any_error FROM (
SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day, event_type, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 WHEN 'view' THEN 4 ELSE 5 END AS pr FROM events) GROUP BY 1, 2""")
def _(spark, d):
    e = fx.table(spark, d, "events").withColumn("day", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")))
    return panel.collapse_roles(e, ["user_id", "day"], "event_type", fx.event_rank(), {"any_error": F.col("event_type") == "error"})
