"""Entity-by-period operators: lags, runs, spells, transitions and outcomes that may be unobserved.

Periods are integers. Each operator shuffles once, on the entity key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.operators._names import refuse, spare


def lag_consecutive(df: DataFrame, by: list[str], time: str, value: str, out: str, n: int = 1) -> DataFrame:
    """Value of the same unit exactly n periods before (after, for negative n); null where that period is absent.

    (by, time) is a key: with one row per period, the neighbour n periods away lies within n rows.
    """
    step, width = (F.lag, n) if n > 0 else (F.lead, -n)
    w = Window.partitionBy(*by).orderBy(time)
    found = F.lit(None)
    for k in range(1, width + 1):
        found = F.when(step(time, k).over(w) == F.col(time) - n, step(value, k).over(w)).otherwise(found)
    return df.withColumn(out, found)


def change_flags(df: DataFrame, by: list[str], time: str, holder: str, order: str) -> DataFrame:
    """Holders per unit and period, whether they changed within it, and against the last of the period before.

    ``order`` gives the order of rows in a period; null holders are passed over. changed_before is null where the period
    before isn't there.
    """
    at = F.when(F.col(holder).isNotNull(), F.col(order))
    per = df.groupBy(*by, time).agg(F.countDistinct(holder).alias("n_holders"), F.min_by(holder, at).alias("first_holder"), F.max_by(holder, at).alias("last_holder"))
    out = lag_consecutive(per, by, time, "last_holder", "previous_holder")
    return out.withColumn("changed_within", (F.col("n_holders") > 1).cast("int")).withColumn(
        "changed_before", (F.col("first_holder") != F.col("previous_holder")).cast("int")
    )


def runs_islands(df: DataFrame, by: list[str], time: str, first_observed: Column | None = None) -> DataFrame:
    """Runs of consecutive periods: run_id (from 1), position (from 1), left_censored when a run starts the data.

    (by, time) is a key. Columns of these names raise.
    """
    refuse(df, "run_id", "position", *(["left_censored"] if first_observed is not None else []))
    (new,) = spare(df, "new")
    w = Window.partitionBy(*by).orderBy(time)
    starts = F.coalesce(F.col(time) - F.lag(time).over(w) != 1, F.lit(True)).cast("int")
    out = df.withColumn(new, starts).withColumn("run_id", F.sum(new).over(w))
    run = Window.partitionBy(*by, "run_id").orderBy(time)
    out = out.withColumn("position", F.row_number().over(run)).drop(new)
    if first_observed is None:
        return out
    return out.withColumn("left_censored", (F.col(time) - F.col("position") + 1 == first_observed).cast("int"))


def format_spans(df: DataFrame, by: list[str], time: str, out: str = "spans") -> DataFrame:
    """Periods of a unit as text, runs joined: 2007-2009, 2012."""
    runs = runs_islands(df.select(*by, time).distinct(), by, time).groupBy(*by, "run_id").agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    text = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo").cast("string")).otherwise(F.concat_ws("-", "_lo", "_hi"))
    listed = runs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_lo", text.alias("t")))).alias("_l"))
    return listed.select(*by, F.array_join("_l.t", ", ").alias(out))


def dedupe_priority(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The row of smallest ``order`` of each key, with the number of rows of the key as n_candidates; equal orders: any one of them.

    One aggregate that combines on the map side, so a key with very many rows is no window.
    """
    refuse(df, "n_candidates")
    rest = [c for c in df.columns if c not in key]
    best = F.min_by(F.struct(*rest), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    out = df.groupBy(*key).agg(best.alias("_row"), F.count("*").alias("n_candidates"))
    return out.select(*[f"_row.{c}" if c in rest else c for c in df.columns], "n_candidates")


def count_spells(df: DataFrame, by: list[str], time: str, owner: str, excused: str) -> DataFrame:
    """Spells per unit: a new owner or a gap starts one, but a gap of one period with ``excused`` set on the row after it doesn't."""
    (new,) = spare(df, "new")
    w = Window.partitionBy(*by).orderBy(time)
    gap, same = F.col(time) - F.lag(time).over(w), F.col(owner).eqNullSafe(F.lag(owner).over(w))
    goes_on = same & ((gap == 1) | ((gap == 2) & F.col(excused)))
    return df.withColumn(new, (~F.coalesce(goes_on, F.lit(False))).cast("int")).groupBy(*by).agg(F.sum(new).alias("n_spells"), F.count("*").alias("n_periods"))


def next_period_outcome(df: DataFrame, by: list[str], time: str, last_observed: int, out: str, k: int = 1) -> DataFrame:
    """1 if the unit is there k periods later, 0 if not, null where period t+k isn't observed at all."""
    (nxt,) = spare(df, "next")
    there = lag_consecutive(df, by, time, time, nxt, -k)
    known = F.col(time) + k <= last_observed
    return there.withColumn(out, F.when(known, F.col(nxt).isNotNull().cast("int"))).drop(nxt)


def first_event_hazard(df: DataFrame, by: list[str], time: str, event: Column) -> DataFrame:
    """First period with the event per unit; before, at_risk (not yet hit when the period starts) and event_now.

    The first events are one small aggregate that joins back; units with a null key have none.
    """
    refuse(df, "first_event", "at_risk", "before", "event_now")
    first = df.groupBy(*by).agg(F.min(F.when(event, F.col(time))).alias("first_event")).where("first_event IS NOT NULL")
    hit = F.col("first_event")
    out = df.join(first, by, "left").select(*df.columns, "first_event")
    return out.withColumns({
        "at_risk": F.coalesce(F.col(time) <= hit, F.lit(True)).cast("int"),
        "before": F.coalesce(F.col(time) < hit, F.lit(True)).cast("int"),
        "event_now": F.coalesce(F.col(time) == hit, F.lit(False)).cast("int"),
    })


def career_to_date(df: DataFrame, by: list[str], time: str, values: list[str]) -> DataFrame:
    """Sums over strictly earlier periods as ``<value>_before``, null where none is recorded."""
    refuse(df, *[f"{v}_before" for v in values])
    w = Window.partitionBy(*by).orderBy(time).rangeBetween(Window.unboundedPreceding, -1)
    for v in values:
        df = df.withColumn(f"{v}_before", F.sum(v).over(w))
    return df


def prior_count(df: DataFrame, by: list[str], time: str, out: str = "n_prior") -> DataFrame:
    """Number of distinct earlier periods of the key."""
    w = Window.partitionBy(*by).orderBy(time)
    return df.withColumn(out, F.dense_rank().over(w) - 1)


def expand_spans(df: DataFrame, start: str, end: str, lo: int, hi: int, out: str) -> DataFrame:
    """One row per period from start to end (null: open) inside [lo, hi]; spans outside, and those with a null start, give none."""
    a = F.greatest(F.col(start), F.lit(lo))
    b = F.least(F.coalesce(F.col(end), F.lit(hi)), F.lit(hi))
    return df.where(F.col(start).isNotNull() & (a <= b)).withColumn(out, F.explode(F.sequence(a, b)))


def adjacent_change(df: DataFrame, by: list[str], order: str, values: list[str]) -> DataFrame:
    """First differences between events of consecutive order; null otherwise."""
    refuse(df, *[f"d_{v}" for v in values])
    names, out = spare(df, *values), df
    for v, n in zip(values, names, strict=True):
        out = lag_consecutive(out, by, order, v, n)
    return out.select(*df.columns, *[(F.col(v) - F.col(n)).alias(f"d_{v}") for v, n in zip(values, names, strict=True)])


def collapse_roles(df: DataFrame, key: list[str], role: str, rank: Column, flags: dict[str, Column]) -> DataFrame:
    """One row per key: the role of smallest (rank, role), the number of roles, and any-of flags."""
    order = F.struct(rank.alias("r"), F.col(role).alias("v"))
    return df.groupBy(*key).agg(F.min(order)["v"].alias("primary_role"), F.countDistinct(role).alias("n_roles"), *[F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(n) for n, c in flags.items()])
