"""Spells, mobility, retention and other outcomes of entities over periods that may be unobserved."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.operators.aggregate import ratio


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def mobility_measures(df: DataFrame, observed: DataFrame, person: str, owner: str, period: str, tier: str) -> DataFrame:
    """Adds periods_anywhere, previous_owners, new_to_owner and promoted to (person, owner, period) rows, a key.

    periods_anywhere counts the person's periods so far; previous_owners lists, joined by "|", the owners of the last
    earlier one. new_to_owner and promoted (a smaller tier than before with the same owner) are null where the owner's
    previous period isn't among ``observed`` (owner, period).
    """
    career = df.groupBy(person, period).agg(F.array_join(F.array_sort(F.collect_set(F.col(owner).cast("string"))), "|").alias("_owners"))
    w = Window.partitionBy(person).orderBy(period)
    career = career.select(person, period, F.row_number().over(w).alias("periods_anywhere"), F.lag("_owners").over(w).alias("previous_owners"))
    known = observed.select(owner, (F.col(period) + 1).alias(period)).distinct().withColumn("_known", F.lit(True))
    before = df.select(person, owner, (F.col(period) + 1).alias(period), F.col(tier).alias("_tier"), F.lit(True).alias("_there"))
    out = df.join(career, [person, period]).join(known, [owner, period], "left").join(before, [person, owner, period], "left")
    there = F.coalesce(F.col("_there"), F.lit(False))
    promoted = F.when(~there, 0).otherwise((F.col(tier) < F.col("_tier")).cast("int"))
    return out.select(*df.columns, "periods_anywhere", "previous_owners", F.when(F.col("_known"), (~there).cast("int")).alias("new_to_owner"), F.when(F.col("_known"), promoted).alias("promoted"))


def incumbent_resolve(opening: DataFrame, first_game: DataFrame, unit: str, period: str) -> DataFrame:
    """(unit, period, incumbent, source, run_id): the opening holder where it agrees with the first game or lists an acting stand-in, else the first game's.

    ``opening``: unit, period, holder, acting (or null); ``first_game``: unit, period, holder. Periods seen by either
    source count; a run is consecutive periods with one incumbent.
    """
    both = opening.select(unit, period, F.col("holder").alias("_o"), F.col("acting").alias("_a"), F.lit(True).alias("_has")).join(first_game.select(unit, period, F.col("holder").alias("_g")), [unit, period], "full_outer")
    keep = F.col("_has") & (F.col("_g").isNull() | (F.col("_o") == F.col("_g")) | (F.col("_a") == F.col("_g")))
    who = F.when(keep, F.col("_o")).otherwise(F.col("_g"))
    rows = both.select(unit, period, who.alias("incumbent"), F.when(keep, "opening").otherwise("first_game").alias("source"))
    w = Window.partitionBy(unit).orderBy(period)
    same = F.coalesce((F.col(period) - F.lag(period).over(w) == 1) & F.col("incumbent").eqNullSafe(F.lag("incumbent").over(w)), F.lit(False))
    return rows.withColumn("_new", (~same).cast("int")).withColumn("run_id", F.sum("_new").over(w)).drop("_new")


def spells_interval_censored(snapshots: DataFrame, listings: DataFrame, unit: str, at: str, person: str, role: str) -> DataFrame:
    """Spells of (unit, person, role) over a unit's ordered snapshots: first and last listing, bounds of entry and exit, censoring.

    ``snapshots`` (unit, at) are all observations of a unit; a spell is a run of consecutive ones that list the person in the
    role. entry_lower is the snapshot before it, exit_upper the one after; left and right are 1 where there is none, and
    then that bound is null. Snapshots are numbered per unit, which is the table of observations, not of listings.
    """
    w = Window.partitionBy(unit).orderBy(at)
    ks = snapshots.select(unit, at).distinct().withColumns({"_k": F.row_number().over(w), "_before": F.lag(at).over(w), "_after": F.lead(at).over(w)})
    rows = listings.select(unit, person, role, at).distinct().join(ks, [unit, at])
    run = Window.partitionBy(unit, person, role).orderBy("_k")
    rows = rows.withColumn("_run", F.col("_k") - F.row_number().over(run))
    out = rows.groupBy(unit, person, role, "_run").agg(
        F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("n_seen"), F.min_by("_before", "_k").alias("entry_lower"), F.max_by("_after", "_k").alias("exit_upper")
    )
    return out.drop("_run").withColumns({"left_censored": F.col("entry_lower").isNull().cast("int"), "right_censored": F.col("exit_upper").isNull().cast("int")})


def with_fallback_bounds(spells: DataFrame, any_role: DataFrame, unit: str, person: str, first: str, last: str) -> DataFrame:
    """Adds entry_lower, exit_upper and from_role_run to ``spells`` (unit, person, first, last) from their own run in ``any_role``, a result of ``spells_interval_censored`` over one common role.

    The run of a bound is the one that holds the spell's first (or last) snapshot.
    """
    runs = any_role.select(F.col(unit).alias("_u"), F.col(person).alias("_p"), "first_seen", "last_seen", "entry_lower", "exit_upper")
    out = spells
    for col, bound in ((first, "entry_lower"), (last, "exit_upper")):
        r = runs.select("_u", "_p", "first_seen", "last_seen", F.col(bound).alias(f"_{bound}"))
        out = out.join(r, (F.col(unit) == F.col("_u")) & (F.col(person) == F.col("_p")) & F.col(col).between(F.col("first_seen"), F.col("last_seen")), "left").drop("_u", "_p", "first_seen", "last_seen")
    return out.withColumnsRenamed({"_entry_lower": "entry_lower", "_exit_upper": "exit_upper"})


def reclassify_leak(weeks: DataFrame, activity: DataFrame, person: str, week: str, status: str, leak: Column, covered: list[str], later: Column, label: str = "Unverified") -> DataFrame:
    """Rows of a leak period in a covered status keep it only with activity in that week, or a covered status in a later period.

    ``leak`` marks the rows in doubt, ``later`` the rows that corroborate; others become ``label``.
    """
    seen = activity.select(person, week).distinct().withColumn("_active", F.lit(True))
    ever = weeks.where(later & F.col(status).isin(covered)).select(person).distinct().withColumn("_later", F.lit(True))
    out = weeks.join(seen, [person, week], "left").join(ever, person, "left")
    doubt = F.coalesce(leak, F.lit(False)) & F.col(status).isin(covered) & F.col("_active").isNull() & F.col("_later").isNull()
    return out.select(*[F.when(doubt, label).otherwise(F.col(status)).alias(status) if c == status else F.col(c) for c in weeks.columns])


def season_aggregate_status(weeks: DataFrame, by: list[str], week: str, status: str, owner: str, classes: dict[str, list[str]], employed: list[str], ambiguous: list[str]) -> DataFrame:
    """Per entity and season: weeks in each class, first and last employed week, the owner at the end, whether several held that week, and the employment class.

    Class: Employed with a week in an employed status, AmbiguousOnly with weeks in ambiguous statuses only, else Other.
    One aggregate; the end owner is the smallest of the last employed week.
    """
    work = F.col(status).isin(employed)
    last = F.max(F.when(work, F.col(week)))
    cells = [F.count(F.when(F.col(status).isin(v), 1)).alias(f"weeks_{n}") for n, v in classes.items()]
    out = weeks.groupBy(*by).agg(
        F.count("*").alias("n_weeks"), *cells, F.min(F.when(work, F.col(week))).alias("first_employed"), last.alias("last_employed"), F.max(F.when(work, F.struct(week, owner)))[owner].alias("_hi"),
        F.min(F.when(work, F.struct((-F.col(week)).alias("w"), owner)))[owner].alias("end_owner"), F.countDistinct(F.when(work, F.col(owner))).alias("n_owners"), F.max(work.cast("int")).alias("_w"), F.min(F.col(status).isin(ambiguous).cast("int")).alias("_a"),
    )
    tie = F.when(F.col("end_owner").isNotNull(), (F.col("_hi") != F.col("end_owner")).cast("int"))
    kind = F.when(F.col("_w") == 1, "Employed").when(F.col("_a") == 1, "AmbiguousOnly").otherwise("Other")
    return out.withColumns({"end_tied": tie, "employment": kind}).drop("_hi", "_w", "_a")


def retention_outcomes(seasons: DataFrame, entity: str, period: str, measures: dict[str, str], owners: str, ambiguous: str, last_observed: int, breaks: list[int]) -> DataFrame:
    """Outcomes of the next period, null (never 0) where it is unobserved: censored, ambiguous evidence only.

    ``measures`` map an outcome to a column that is positive when it holds; an entity without a row in the next
    period has left, so the outcome is 0. Adds same_owner (the sets of owners, an array column, overlap), censored,
    next_ambiguous, observed, source_break, in_risk_set and, for the first measure, ``<outcome>_ambiguous_as_exit``.
    """
    nxt = seasons.select(F.col(entity), (F.col(period) - 1).alias(period), *[F.col(c).alias(f"_n_{n}") for n, c in measures.items()], F.col(owners).alias("_n_owners"), F.col(ambiguous).alias("_n_amb"), F.lit(True).alias("_n_there"))
    out = seasons.join(nxt, [entity, period], "left")
    censored = F.col(period) >= last_observed
    amb = F.when(~censored, _flag(F.col("_n_amb") == 1))
    seen = ~censored & (amb == 0)
    made = {n: F.when(seen, _flag(F.col(f"_n_{n}") > 0)) for n in measures}
    same = F.when(seen & F.col(owners).isNotNull(), _flag(F.arrays_overlap(F.col(owners), F.col("_n_owners"))))
    first = next(iter(measures))
    broken = F.col(period).isin(breaks)
    return out.select(
        *seasons.columns, *[c.alias(n) for n, c in made.items()], same.alias("same_owner"), censored.cast("int").alias("censored"), amb.alias("next_ambiguous"), seen.cast("int").alias("observed"), broken.cast("int").alias("source_break"),
        (seen & ~broken).cast("int").alias("in_risk_set"), F.when(~censored & (amb == 1), 0).otherwise(made[first]).alias(f"{first}_ambiguous_as_exit"),
    )


def effective_start_recurrence(contracts: DataFrame, by: list[str], order: list[str], signed: str, years: str, extension: str, cap: int = 2) -> DataFrame:
    """Adds eff_start: the signing period, but for an extension max(signed, min(previous end + 1, signed + cap)).

    The previous end is that of the owner's previous contract in order, itself eff_start + years - 1 (unknown below one
    year or for null years), so the state is carried through a sorted array per owner with ``aggregate``; an owner's
    contracts are few. Rows with a null owner or signing period keep the signing period.
    """
    keyed = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*by, signed]])
    entry = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate([signed, *order])], F.col(signed).alias("s"), F.col(years).alias("y"), F.coalesce(F.col(extension), F.lit(False)).alias("x"), F.struct(*contracts.columns).alias("row"))
    lists = contracts.where(keyed).groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("l"))
    kind = "struct<out:array<int>,end:int>"

    def step(state: Column, c: Column) -> Column:
        ext = c["x"] & state["end"].isNotNull()
        start = F.when(ext, F.greatest(c["s"], F.least(state["end"] + 1, c["s"] + cap))).otherwise(c["s"]).cast("int")
        end = F.when(c["y"] >= 1, start + c["y"] - 1).cast("int")
        return F.struct(F.concat(state["out"], F.array(start)).alias("out"), end.alias("end")).cast(kind)

    empty = F.struct(F.array().cast("array<int>").alias("out"), F.lit(None).cast("int").alias("end")).cast(kind)
    starts = lists.withColumn("_s", F.aggregate("l", empty, step)["out"])
    rows = starts.select(F.inline(F.arrays_zip("l", "_s"))).select("l.row.*", F.col("_s").alias("eff_start"))
    return rows.union(contracts.where(~keyed).select("*", F.col(signed).cast("int").alias("eff_start")))


def order_events_strict(df: DataFrame, entity: str, period: str) -> DataFrame:
    """Adds state (ordered, ambiguous, after_ambiguous), and for ordered events order, n_events and gap.

    Two events of an entity in one period can't be ordered: both are ambiguous, and the sequence ends there.
    """
    counts = df.groupBy(entity, period).agg(F.count("*").alias("_n"))
    ends = counts.where("_n > 1").groupBy(entity).agg(F.min(period).alias("_end"))
    rows = df.join(counts, [entity, period]).join(ends, entity, "left")
    state = F.when(F.col("_n") > 1, "ambiguous").when(F.col(period) > F.col("_end"), "after_ambiguous").otherwise("ordered")
    rows = rows.withColumn("state", state)
    w = Window.partitionBy(entity, "state")
    ordered = F.col("state") == "ordered"
    return rows.select(
        *df.columns, "state", F.when(ordered, F.row_number().over(w.orderBy(period))).alias("event_order"), F.when(ordered, F.count("*").over(w)).alias("n_events"), F.when(ordered, F.col(period) - F.lag(period).over(w.orderBy(period))).alias("gap")
    )


def event_flow(ordered: DataFrame, entity: str) -> DataFrame:
    """Counts of ``order_events_strict`` that must add up, and whether they do."""
    n = lambda c: F.count(F.when(c, 1))
    own = F.col("state") == "ordered"
    out = ordered.agg(
        F.count("*").alias("n_rows"), n(F.col("state") == "ambiguous").alias("n_ambiguous"), n(F.col("state") == "after_ambiguous").alias("n_after"), n(own).alias("n_ordered"), n(own & (F.col("n_events") == 1)).alias("n_single"),
        n(own & (F.col("n_events") >= 2)).alias("n_repeat"), F.countDistinct(F.when(own & (F.col("n_events") >= 2), F.col(entity))).alias("n_repeat_entities"),
    )
    return out.withColumn("adds_up", (F.expr("n_rows = n_ambiguous + n_after + n_ordered") & F.expr("n_ordered = n_single + n_repeat")).cast("int"))


def classify_transitions(df: DataFrame, unit: str, period: str, first: str, last: str) -> DataFrame:
    """Adds transition and is_hire to one row per (unit, period) with its first and last holder.

    Against the previous period: another first holder is between_season, the interim of the last one is retained_interim;
    one who held the unit in the two periods before (the interim's own period aside) is a return, one who gives way to the
    last holder in the next period is a stand_in. is_hire is null where the previous period is unobserved.
    """
    w = Window.partitionBy(unit).orderBy(period)
    back = F.col(period) - F.lag(period).over(w) == 1
    ahead = F.lead(period).over(w) - F.col(period) == 1
    rows = df.withColumns({"_last": F.when(back, F.lag(last).over(w)), "_first": F.when(back, F.lag(first).over(w)), "_next": F.when(ahead, F.lead(first).over(w))})
    between = F.col(first) != F.col("_last")
    interim = (F.col(first) == F.col("_last")) & (F.col(first) != F.col("_first"))
    rows = rows.withColumns({"_between": between, "_interim": interim})
    held = df.select(F.col(unit).alias("_u"), F.col(period).alias("_t"), F.explode(F.array_distinct(F.array(first, last))).alias("_h")).distinct()
    near = rows.select(unit, period, first, "_interim").join(held, (F.col(unit) == F.col("_u")) & (F.col(first) == F.col("_h")))
    near = near.where((F.col("_t") >= F.col(period) - 2) & (F.col("_t") < F.col(period) - F.coalesce(F.col("_interim").cast("int"), F.lit(0))))
    rows = rows.join(near.select(unit, period, F.lit(True).alias("_earlier")).distinct(), [unit, period], "left")
    moved = F.col("_between") | F.col("_interim")
    stand = F.col("_between") & F.coalesce(F.col("_last") == F.col("_next"), F.lit(False))
    kind = F.when(moved, F.when(stand, "stand_in").when(F.col("_earlier"), "return").when(F.col("_interim"), "retained_interim").otherwise("between_season")).when(moved.isNotNull(), "none")
    rows = rows.withColumn("transition", kind)
    return rows.select(*df.columns, "transition", F.when(F.col("transition").isNotNull(), F.col("transition").isin("between_season", "retained_interim").cast("int")).alias("is_hire"))


def predetermined_weights(df: DataFrame, unit: str, member: str, period: str, value: str, usage: str) -> DataFrame:
    """(unit, period): the weighted mean of the value over members of the unit's first period, by usage in the period before.

    Members without usage in exactly the period before count nothing; adds n_members and lagged_usage, null where the
    unit has no consecutive period before.
    """
    first = df.groupBy(unit).agg(F.min(period).alias("_t0"))
    founders = df.join(first, unit).where(F.col(period) == F.col("_t0")).select(unit, member).distinct()
    before = df.groupBy(unit, member, (F.col(period) + 1).alias(period)).agg(F.sum(usage).alias("_w"))
    rows = df.join(founders, [unit, member], "left_semi").join(before, [unit, member, period], "left")
    totals = df.groupBy(unit, (F.col(period) + 1).alias(period)).agg(F.sum(usage).alias("lagged_usage"))
    known = F.col(value).isNotNull() & F.col("_w").isNotNull()
    out = rows.groupBy(unit, period).agg(F.count("*").alias("n_members"), ratio(F.sum(F.when(known, F.col(value) * F.col("_w"))), F.sum(F.when(known, F.col("_w")))).alias("weighted"))
    return out.join(totals, [unit, period], "left")


def observability_rules(stats: DataFrame, coverage: DataFrame, entity: str, period: str, value: str, complete: str, members: DataFrame) -> DataFrame:
    """(entity, total, final_value): sums over an entity's periods, null unless every one of them is completely covered.

    ``members`` (entity, period) are the contributing periods; inside a covered period absence is a true 0. final_value is
    that of the last period, null if that isn't covered.
    """
    cov = coverage.groupBy(period).agg(F.min(F.col(complete).cast("int")).alias("_ok"))
    sums = stats.groupBy(entity, period).agg(F.sum(value).alias("_v"))
    rows = members.select(entity, period).distinct().join(cov, period, "left").join(sums, [entity, period], "left")
    ok = F.coalesce(F.col("_ok"), F.lit(0)) == 1
    v = F.when(ok, F.coalesce("_v", F.lit(0.0)))
    out = rows.groupBy(entity).agg(F.count("*").alias("n_periods"), F.bool_and(ok).alias("_all"), F.sum(v).alias("_sum"), F.max(F.struct(period, v.alias("v")))["v"].alias("final_value"))
    return out.select(entity, "n_periods", F.when(F.col("_all"), F.col("_sum")).alias("total"), "final_value")


def usage_merge_sources(a: DataFrame, b: DataFrame, real: DataFrame, starts: DataFrame, entity: str, season: str, week: str, starts_from: int) -> DataFrame:
    """Per entity and season: weeks played (the union of two sources), how many only one of them knows, and starts in real weeks.

    Starts are null before ``starts_from``, where nobody recorded them; starts outside the weeks of ``real`` (season, week) are
    left out.
    """
    key = [entity, season, week]
    both = a.select(*key).distinct().withColumn("_a", F.lit(1)).join(b.select(*key).distinct().withColumn("_b", F.lit(1)), key, "full_outer")
    played = both.groupBy(entity, season).agg(F.count("*").alias("weeks_played"), F.count(F.when(F.col("_b").isNull(), 1)).alias("only_a"), F.count(F.when(F.col("_a").isNull(), 1)).alias("only_b"))
    began = starts.select(*key).distinct().join(real.select(season, week).distinct(), [season, week], "left_semi").groupBy(entity, season).agg(F.count("*").alias("_s"))
    out = played.join(began, [entity, season], "left")
    return out.withColumn("starts", F.when(F.col(season) >= starts_from, F.coalesce("_s", F.lit(0)))).drop("_s")


def multi_total_rows(df: DataFrame, by: list[str], is_total: str, values: list[str]) -> DataFrame:
    """Sums of part rows per key; rows of pre-aggregated totals are used only for keys without a part row. ``from_total`` says so."""
    parts = ~F.coalesce(F.col(is_total), F.lit(False))
    cells = [c for v in values for c in (F.sum(F.when(parts, F.col(v))).alias(f"_p_{v}"), F.sum(F.when(~parts, F.col(v))).alias(f"_t_{v}"))]
    out = df.groupBy(*by).agg(F.count(F.when(parts, 1)).alias("_n"), *cells)
    whole = F.col("_n") == 0
    return out.select(*by, *[F.when(whole, F.col(f"_t_{v}")).otherwise(F.col(f"_p_{v}")).alias(v) for v in values], whole.cast("int").alias("from_total"))
