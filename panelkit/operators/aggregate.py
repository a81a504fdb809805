"""Aggregates, reshaping and set operations. All combine on the map side; windows only where rows must stay."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.operators._names import refuse, spare
from panelkit.operators.columns import ratio
from panelkit.operators.ranges import in_ranges, quantiles

#: Cells (value, period) that are compared with each other in one task.
CELLS_PER_BLOCK = 4096


def agg_conditional(df: DataFrame, by: list[str], cells: dict[str, tuple[str, Column | None, Column | None]]) -> DataFrame:
    """Aggregates with a filter each: name -> (count, sum, avg, min or max; value; condition). A null condition counts as false."""
    fs = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
    out = []
    for name, (kind, value, when) in cells.items():
        value = F.lit(1) if value is None else value
        kept = value if when is None else F.when(when, value)
        out.append((F.count(kept) if kind == "count" else fs[kind](kept)).alias(name))
    return df.groupBy(*by).agg(*out)


def agg_two_level(df: DataFrame, inner: list[str], outer: list[str], order: str, value: str, keep: Column) -> DataFrame:
    """Groups of ``inner`` kept where ``keep`` (over n, change) holds, then per ``outer``: n_groups, n_kept, total and top change.

    ``change`` is the value at the last order minus that at the first; ``outer`` must be columns of ``inner``. Outer keys
    without a kept group stay with 0 and nulls.
    """
    per = df.groupBy(*inner).agg(F.count("*").alias("n"), (F.max_by(value, order) - F.min_by(value, order)).alias("change"))
    return per.groupBy(*outer).agg(F.count("*").alias("n_groups"), F.count(F.when(keep, 1)).alias("n_kept"), F.sum(F.when(keep, F.col("change"))).alias("total_change"), F.max(F.when(keep, F.col("change"))).alias("top_change"))


def agg_season_summary(df: DataFrame, by: list[str], order: list[str], value: str, holder: str, check: DataFrame | None = None, check_col: str | None = None) -> DataFrame:
    """Totals, first and last holder by order, different holders, mean of totals; with ``check`` (by, check_col) the gap to an independent total."""
    at = F.struct(*order)
    out = df.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.sum(value).alias("total"), F.min_by(holder, at).alias("first_holder"), F.max_by(holder, at).alias("last_holder"), F.countDistinct(holder).alias("n_holders"), F.avg(value).alias("mean")
    )
    if check is None:
        return out
    return out.join(check.select(*by, check_col), by, "left").withColumn("gap", F.col("total") - F.col(check_col)).drop(check_col)


def agg_rollup(df: DataFrame, keys: list[str], cells: dict[str, Column]) -> DataFrame:
    """ROLLUP over the keys; ``level`` is the number of keys summed over."""
    level = reduce(lambda a, b: a + b, [F.grouping(k).cast("int") for k in keys])
    return df.rollup(*keys).agg(level.alias("level"), *[c.alias(n) for n, c in cells.items()])


def agg_arg_extreme(df: DataFrame, by: list[str], values: list[str], order: list[Column], when: Column | None = None, largest: bool = True) -> DataFrame:
    """The values of the row with the largest (or smallest) composite order among rows that meet the condition; nulls where none does."""
    row, key = F.struct(*values), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    key = key if when is None else F.when(when, key)
    pick = (F.max_by if largest else F.min_by)(row, key)
    return df.groupBy(*by).agg(pick.alias("_row"), F.count(F.lit(1) if when is None else F.when(when, 1)).alias("n")).select(*by, *[F.when(F.col("n") > 0, F.col(f"_row.{v}")).alias(v) for v in values], "n")


def agg_collect_lists(df: DataFrame, by: list[str], value: str, lists: str | None = None, sep: str = ",") -> DataFrame:
    """Distinct values sorted, as array and as text; with ``lists`` (an array column) also all of its entries, distinct and sorted."""
    cells = [F.array_sort(F.collect_set(value)).alias("values")]
    if lists is not None:
        cells.append(F.array_sort(F.array_distinct(F.flatten(F.collect_list(lists)))).alias("entries"))
    out = df.groupBy(*by).agg(*cells)
    return out.withColumns({"text": F.array_join("values", sep), "n_values": F.size("values")})


def agg_mode_tiebreak(df: DataFrame, by: list[str], value: str, latest: str | None = None) -> DataFrame:
    """Most frequent value that isn't null; ties: the one seen latest, then the smallest. Adds how often it occurs.

    Counted per (key, value) first, so a frequent key is combined on the map side.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"), (F.max(latest) if latest else F.lit(0)).alias("_at"))
    best = counts.groupBy(*by).agg(F.max(F.struct("_n", "_at")).alias("_b"))
    ties = counts.join(best, by).where((F.col("_n") == F.col("_b._n")) & F.col("_at").eqNullSafe(F.col("_b._at")))
    return ties.groupBy(*by).agg(F.min(value).alias("mode"), F.max("_n").alias("n"))


def weighted_mean(x: Column, w: Column) -> Column:
    """Mean over rows that have a value and a weight; null where there are none or their weights sum to zero."""
    known = x.isNotNull() & w.isNotNull()
    return ratio(F.sum(F.when(known, x * w)), F.sum(F.when(known, w)))


def agg_weighted(df: DataFrame, by: list[str], values: list[str], weight: str) -> DataFrame:
    """Weighted means, the covered share of the weight, and sums that are null only where no value is known."""
    w = F.col(weight)
    cells = [c for v in values for c in (weighted_mean(F.col(v), w).alias(f"mean_{v}"), ratio(F.sum(F.when(F.col(v).isNotNull(), w)), F.sum(w)).alias(f"coverage_{v}"), F.sum(v).alias(f"sum_{v}"))]
    return df.groupBy(*by).agg(*cells)


def agg_share_of_total(df: DataFrame, by: list[str], member: str, count: str, share: str | None = None) -> DataFrame:
    """Each member's share of its unit's total. With ``share`` the total is recovered from the member with the largest count as round(count / share)."""
    if share is None:
        totals = df.groupBy(*by).agg(F.sum(count).alias("total"))
    else:
        top = df.where(F.col(share) > 0).groupBy(*by).agg(F.max(F.struct(F.col(count).alias("c"), F.col(share).alias("s"))).alias("t"))
        totals = top.select(*by, F.round(F.col("t.c") / F.col("t.s")).alias("total"))
    return df.select(*by, member, count).join(totals, by, "left").withColumn("share_of_total", ratio(F.col(count), F.col("total")))


def agg_quantiles(df: DataFrame, by: list[str], value: str, probabilities: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation, as columns q0, q1, ...; nulls are left out. Groups may be of any size."""
    return quantiles(df, by, value, probabilities)


def trim_quantile(df: DataFrame, by: list[str], value: str, upper: float = 0.99) -> DataFrame:
    """Rows at or below their group's quantile; rows with a null value go, those of a null group stay by the same rule."""
    own = spare(df, *[f"by{i}" for i in range(len(by))], "cut")
    cut = quantiles(df, by, value, [upper]).select(*[F.col(b).alias(o) for b, o in zip(by, own, strict=False)], F.col("q0").alias(own[-1]))
    same = [F.col(b).eqNullSafe(F.col(o)) for b, o in zip(by, own, strict=False)]
    return (df.join(cut, same) if by else df.join(F.broadcast(cut))).where(F.col(value) <= F.col(own[-1])).select(*df.columns)


def pivot_wide(df: DataFrame, index: list[str], name: str, value: str, names: list) -> DataFrame:
    """A column for each of the names; a (index, name) that repeats raises while the query runs. Absent cells are null."""
    once = F.when(F.count("*") > 1, F.raise_error(F.lit(f"repeated {name}"))).otherwise(F.first(value))
    cells = df.where(F.col(name).isin(names)).groupBy(*index, name).agg(once.alias("_v"))
    return cells.groupBy(*index).pivot(name, names).agg(F.first("_v"))


def crosstab(df: DataFrame, row: str, col: str, cols: list) -> DataFrame:
    """Counts of two codes, absent cells 0."""
    return df.groupBy(row).agg(*[F.count(F.when(F.col(col) == F.lit(c), 1)).alias(str(c)) for c in cols])


def unpivot_long(df: DataFrame, ids: list[str], values: list[str], name: str = "stat", value: str = "value", keep_null: bool = False) -> DataFrame:
    """A row for each value column; nulls are left out unless asked for."""
    out = df.unpivot(ids, values, name, value)
    return out if keep_null else out.where(F.col(value).isNotNull())


def set_union(*frames: DataFrame, keep_all: bool = False) -> DataFrame:
    """UNION by name, with UNION ALL's repeats where asked for; columns that a frame lacks are null."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out if keep_all else out.distinct()


def set_difference(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Distinct keys of ``a`` that ``b`` doesn't hold; nulls are equal to nulls."""
    return a.select(*on).distinct().exceptAll(b.select(*on).distinct())


def first_per_group(df: DataFrame, key: list[str], order: list, flag: str | None = None) -> DataFrame:
    """The first row of each key in the order given; with ``flag`` all rows stay, the first marked 1. Equal orders: any one of them."""
    (rn,) = spare(df, "rn")
    out = df.withColumn(rn, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    if flag is None:
        return out.where(F.col(rn) == 1).drop(rn)
    return out.withColumn(flag, (F.col(rn) == 1).cast("int")).drop(rn)


def filled_fields(columns: list[str]) -> Column:
    """How many of the columns are not null."""
    return reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns])


def rank_within_group(df: DataFrame, by: list[str], value: str, descending: bool = True) -> DataFrame:
    """Adds place (ties share the smallest), dense_place and peers; null values come last and share a place."""
    refuse(df, "place", "dense_place", "peers")
    w = Window.partitionBy(*by)
    o = w.orderBy(F.desc_nulls_last(value) if descending else F.asc_nulls_last(value))
    return df.select("*", F.rank().over(o).alias("place"), F.dense_rank().over(o).alias("dense_place"), F.count("*").over(w).alias("peers"))


def group_primary_owner(df: DataFrame, unit: list[str], owner: str, qualifies: Column, at: str) -> DataFrame:
    """Primary owner of a unit: most qualifying rows, then most rows, then latest, then the smallest id; with counts of owners and of qualifying ones."""
    per = df.groupBy(*unit, owner).agg(F.count(F.when(qualifies, 1)).alias("_q"), F.count("*").alias("_n"), F.max(at).alias("_at"))
    lead = F.max(F.struct("_q", "_n", "_at"))
    best = per.groupBy(*unit).agg(lead.alias("_b"), F.count(owner).alias("n_owners"), F.count(F.when(F.col("_q") > 0, 1)).alias("n_qualifying"))
    ties = per.join(best, unit).where("_q = _b._q AND _n = _b._n AND _at <=> _b._at")
    return ties.groupBy(*unit).agg(F.min(owner).alias("primary_owner"), F.first("n_owners").alias("n_owners"), F.first("n_qualifying").alias("n_qualifying"))


def compose_group(members: DataFrame, by: list[str], sets: dict[str, Column], weight: str, measures: list[str]) -> DataFrame:
    """Composition of several member sets in one pass: for each set n, the coded share and the weighted mean of each measure.

    Sets may overlap. A set without members has n 0 and nulls.
    """
    cells = []
    for name, inside in sets.items():
        cells.append(F.count(F.when(inside, 1)).alias(f"{name}_n"))
        for m in measures:
            x, w = F.when(inside, F.col(m)), F.when(inside, F.col(weight))
            cells.append(ratio(F.count(x).cast("double"), F.count(F.when(inside, 1))).alias(f"{name}_{m}_coded"))
            cells.append(weighted_mean(x, w).alias(f"{name}_{m}_share"))
    return members.groupBy(*by).agg(*cells)


def diversity_index(members: DataFrame, by: list[str], probabilities: list[str]) -> DataFrame:
    """Expected Blau index without replacement from category probabilities, 1 - sum((sum p)^2 - sum p^2) / (n (n - 1)); null below two members.

    Members with a null probability are left out. The sums combine on the map side.
    """
    known = members.dropna(subset=probabilities)
    sums = [F.sum(F.col(p).cast("double")).alias(f"_s{i}") for i, p in enumerate(probabilities)] + [F.sum(F.col(p).cast("double") * F.col(p)).alias(f"_q{i}") for i, p in enumerate(probabilities)]
    pairs = reduce(lambda a, b: a + b, [F.col(f"_s{i}") * F.col(f"_s{i}") - F.col(f"_q{i}") for i in range(len(probabilities))])
    n = F.col("n").cast("double")
    return known.groupBy(*by).agg(F.count("*").alias("n"), *sums).select(*by, "n", F.when(F.col("n") >= 2, 1 - pairs / (n * (n - 1))).alias("blau"))


def expected_share_loo(members: DataFrame, group: list[str], period: list[str], category: str, value: str, weight: str) -> DataFrame:
    """Observed share, and the share expected from the group's category mix and the category shares of all other groups of the period.

    Categories without members elsewhere are left out and the mix is renormalised; residual is observed minus expected.
    """
    w, x = F.col(weight).cast("double"), F.col(value).cast("double")
    own = members.where(F.col(value).isNotNull() & F.col(weight).isNotNull()).groupBy(*period, *group, category).agg(F.sum(w).alias("_w"), F.sum(w * x).alias("_x"))
    all_ = own.groupBy(*period, category).agg(F.sum("_w").alias("_wa"), F.sum("_x").alias("_xa"), F.count("*").alias("_groups"))
    rows = own.join(all_, [*period, category]).withColumn("_p", F.when(F.col("_groups") > 1, ratio(F.col("_xa") - F.col("_x"), F.col("_wa") - F.col("_w"))))
    out = rows.groupBy(*period, *group).agg(ratio(F.sum("_x"), F.sum("_w")).alias("observed"), ratio(F.sum(F.col("_p") * F.col("_w")), F.sum(F.when(F.col("_p").isNotNull(), F.col("_w")))).alias("expected"))
    return out.withColumn("residual", F.col("observed") - F.col("expected"))


def share_uncertainty(df: DataFrame, by: list[str], p: str, weight: str) -> DataFrame:
    """Weighted share of known probabilities, its Berkson variance sum(w^2 p (1-p)) / (sum w)^2, the binomial standard error, and bounds with the unknown as 0 or 1."""
    x, w = F.col(p).cast("double"), F.col(weight).cast("double")
    known = F.when(F.col(p).isNotNull(), w)
    out = df.groupBy(*by).agg(weighted_mean(x, w).alias("share"), ratio(F.sum(w * w * x * (1 - x)), F.sum(known) * F.sum(known)).alias("variance"), F.count(p).alias("n_known"), ratio(F.sum(x * w), F.sum(w)).alias("lower"), ratio(F.sum(F.coalesce(x, F.lit(1.0)) * w), F.sum(w)).alias("upper"))
    return out.withColumn("binomial_se", F.sqrt(ratio(F.col("share") * (1 - F.col("share")), F.col("n_known"))))


def percentile_score_cumulative(df: DataFrame, by: list[str], period: str, value: str, minimum: int = 10, cells_per_block: int = CELLS_PER_BLOCK) -> DataFrame:
    """Adds score: 10 * (values below + half the equal ones) among all rows of the class up to and including the row's period; null below ``minimum`` peers.

    Dominance counting: rows are counted per (class, value, period), and these cells dealt into blocks of neighbouring
    values. What lies in lower blocks comes from a prefix table of (class, block, period) totals; only cells of one block
    are compared with each other, in a table of its values by its periods. Rows with a null class, period or value have no score.
    """
    place, n, low, same, peers = spare(df, "block", "n", "low", "same", "peers")
    cells = df.dropna(subset=[*by, period, value]).groupBy(*by, period, value).agg(F.count("*").alias(n))
    blocks = in_ranges(cells, [*by, value], place, cells_per_block)
    totals = blocks.groupBy(*by, place, period).agg(F.sum(n).alias(n))
    before = _lower_blocks(totals, by, place, period, n, low)
    schema = blocks.select(*by, place, period, value).schema.add(same, "double")

    def inside(key, pdf):
        values, v = np.unique(pdf[value].to_numpy(), return_inverse=True)
        periods, t = np.unique(pdf[period].to_numpy(), return_inverse=True)
        table = np.zeros((len(values), len(periods)))
        table[v, t] = pdf[n].to_numpy()
        up_to = table.cumsum(axis=1)
        return pdf[[*by, place, period, value]].assign(**{same: (up_to.cumsum(axis=0) - up_to / 2)[v, t]})

    counted = blocks.groupBy(*by, place).applyInPandas(inside, schema)
    all_ = Window.partitionBy(*by).orderBy(period)
    sizes = cells.groupBy(*by, period).agg(F.sum(n).alias(n)).select(*by, period, F.sum(n).over(all_).alias(peers))
    scored = counted.join(before, [*by, place, period]).join(sizes, [*by, period])
    score = F.when(F.col(peers) >= minimum, 10 * (F.col(low) + F.col(same)) / F.col(peers))
    return df.join(scored.select(*by, period, value, score.alias("score")), [*by, period, value], "left").select(*df.columns, "score")


def _lower_blocks(totals: DataFrame, by: list[str], place: str, period: str, n: str, name: str) -> DataFrame:
    """(by, block, period) with the rows of the class's lower blocks up to that period, from totals with a row for each that occurs.

    Running totals over the blocks for each period, then over the periods of a block; both windows run over the
    table of a class's blocks by its periods, a few thousandths of its cells.
    """
    along = Window.partitionBy(*by, period).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    up = Window.partitionBy(*by, place).orderBy(period)
    grid = totals.select(*by, place).distinct().join(totals.select(*by, period).distinct(), by)
    filled = grid.join(totals, [*by, place, period], "left")
    lower = filled.select(*by, place, period, F.col(n).isNotNull().alias("held"), F.coalesce(F.sum(n).over(along), F.lit(0)).alias(n))
    return lower.select(*by, place, period, "held", F.sum(n).over(up).alias(name)).where("held").drop("held")


def composite_score(parts: list[str], minimum: int = 6) -> Column:
    """Mean of the scores that are known, null where fewer than ``minimum`` are."""
    n = filled_fields(parts)
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in parts])
    return F.when(n >= minimum, total / n)


def modal_mass_reference(df: DataFrame, cell: str, value: str, digits: int = 2, share: float = 0.1, rows: int = 3) -> DataFrame:
    """Per ordered cell the modal rounded value that holds the share and number of rows (ties: smallest), filled down, and its running maximum.

    Windows run over the table of cells, which is as small as the number of cells.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(cell, F.round(value, digits).alias("_v")).agg(F.count("*").alias("_n"))
    total = counts.groupBy(cell).agg(F.sum("_n").alias("n"), F.max(F.struct("_n", (-F.col("_v")).alias("m"))).alias("_b"))
    held = (F.col("_b._n") >= rows) & (F.col("_b._n") >= share * F.col("n"))
    modal = total.select(cell, "n", F.when(held, -F.col("_b.m")).alias("modal"))
    w = Window.partitionBy(F.lit(1)).orderBy(cell)
    filled = modal.withColumn("reference", F.last("modal", ignorenulls=True).over(w))
    return filled.withColumn("running_max", F.max("reference").over(w))


def near_reference(df: DataFrame, reference: DataFrame, cell: str, value: str, factor: float = 1.1) -> DataFrame:
    """Adds near_reference: 1 at most ``factor`` times the cell's reference, 0 above, null where either is unknown."""
    return df.join(reference.select(cell, "reference"), cell, "left").withColumn("near_reference", (F.col(value) <= factor * F.col("reference")).cast("int")).drop("reference")


def select_authoritative(df: DataFrame, key: list[str], value: str, preference: list[Column]) -> DataFrame:
    """Many values per key -> the value of smallest preference (ties: smallest value), the number of values, the other values as text, and the median of the best tier.

    The first preference is the tier.
    """
    order = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(preference)], F.col(value).alias("v"))
    rows = df.where(F.col(value).isNotNull()).select(*key, value, preference[0].alias("_tier"), order.alias("_o"))
    best = rows.groupBy(*key).agg(F.min("_o").alias("_b"), F.min("_tier").alias("_t"))
    joined = rows.join(best, key)
    return joined.groupBy(*key).agg(
        F.first("_b.v").alias("chosen"), F.count("*").alias("n_values"), F.array_join(F.array_sort(F.collect_set(F.when(F.col(value) != F.col("_b.v"), F.col(value).cast("string")))), ";").alias("alternatives"),
        # The values of one key, few in number, so one task may hold them.
        F.percentile(F.when(F.col("_tier").eqNullSafe(F.col("_t")), F.col(value)), F.lit(0.5)).alias("tier_median"),
    )


def series_with_basis(series: DataFrame, denominators: DataFrame, key: list[str], count: str, percent: str, base: str) -> DataFrame:
    """percent_used and basis: count over the known denominator where a count exists ("derived"), else the printed percentage ("printed"), never mixed."""
    rows = series.join(denominators.select(*key, base), key, "left")
    derived = ratio(F.lit(100.0) * F.col(count), F.col(base))
    basis = F.when(derived.isNotNull(), "derived").when(F.col(count).isNull() & F.col(percent).isNotNull(), "printed")
    return rows.withColumns({"percent_used": F.when(basis == "derived", derived).when(basis == "printed", F.col(percent)), "basis": basis})


def era_summary(df: DataFrame, period: str, value: str, eras: dict[str, tuple[int | None, int | None]], by: list[str] | None = None) -> DataFrame:
    """era, n, mean, low and high of a series in each era (first and last period, null: open), per ``by``; eras may overlap.

    Null values and rows of a null period are left out, as are eras without a row.
    """
    open_or = lambda end, c: F.lit(True) if end is None else c
    inside = [F.when(open_or(first, F.col(period) >= F.lit(first)) & open_or(last, F.col(period) <= F.lit(last)), F.lit(name)) for name, (first, last) in eras.items()]
    known = df.where(F.col(period).isNotNull() & F.col(value).isNotNull())
    return known.select(*(by or []), F.col(value).alias("_v"), F.explode(F.array_compact(F.array(*inside))).alias("era")).groupBy(*(by or []), "era").agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), F.min("_v").alias("low"), F.max("_v").alias("high"))


def assign_first_tier(ids: DataFrame, key: str, sets: list[tuple[str, DataFrame]], rest: str = "none") -> DataFrame:
    """Adds tier: the name of the first set (frames with the key) that holds the id, else ``rest``; null ids are in none."""
    out, cases = ids, F.when(F.lit(False), F.lit(None).cast("string"))
    for i, (name, members) in enumerate(sets):
        out = out.join(members.select(key).distinct().withColumn(f"_in{i}", F.lit(True)), key, "left")
        cases = cases.when(F.col(f"_in{i}"), name)
    return out.select(*ids.columns, cases.otherwise(rest).alias("tier"))


def topk_context_list(items: DataFrame, by: list[str], text: str, order: list[Column], k: int, sep: str = "; ") -> DataFrame:
    """The first k items per entity in order, joined as text, with "+n more" where there are more; ties by text.

    The k smallest are kept while rows are combined: numbered inside salts first, so no entity's items meet as a list.
    """
    key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(text).alias("t"))
    salted = items.select(*by, key.alias("_k"), F.pmod(F.xxhash64(text), F.lit(32)).alias("_s"))
    near = salted.withColumn("_rn", F.row_number().over(Window.partitionBy(*by, "_s").orderBy("_k"))).where(F.col("_rn") <= k)
    counts = items.groupBy(*by).agg(F.count("*").alias("_n"))
    top = near.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list("_k")), 1, k).alias("_top"))
    joined = F.array_join(F.transform("_top", lambda x: x["t"]), sep)
    more = F.when(F.col("_n") > k, F.concat(F.lit(f"{sep}+"), (F.col("_n") - k).cast("string"), F.lit(" more"))).otherwise("")
    return counts.join(top, by).select(*by, F.concat(joined, more).alias("context"), F.col("_n").alias("n_items"))


def pool_evidence(statements: DataFrame, entity: str, source: str, category: str, precedence: list[str]) -> DataFrame:
    """One row per entity: label, status and the categories.

    A source that names one category is single. All sources single and equal: "agreed"; sources single but different:
    "conflict", label of the first source in ``precedence``; a source with several: "multi", no label.
    """
    rank = F.coalesce(*[F.when(F.col(source) == s, i) for i, s in enumerate(precedence)], F.lit(len(precedence)))
    known = statements.where(F.col(category).isNotNull()).groupBy(entity, source).agg(F.min(category).alias("_lo"), F.max(category).alias("_hi"))
    per = known.groupBy(entity).agg(
        F.max((F.col("_lo") != F.col("_hi")).cast("int")).alias("_multi"), F.min("_lo").alias("_min"), F.max("_hi").alias("_max"), F.min_by("_lo", F.struct(rank, source)).alias("_first"), F.count("*").alias("n_sources")
    )
    status = F.when(F.col("_multi") == 1, "multi").when(F.col("_min") == F.col("_max"), "agreed").otherwise("conflict")
    return per.select(entity, "n_sources", status.alias("status"), F.when(status != "multi", F.col("_first")).alias("label"))


def two_coder(adjudicated: Column, first: Column, second: Column) -> Column:
    """A label and its basis from two coders: adjudicated, else agreed, else the single one known, else disputed (no label)."""
    return F.when(adjudicated.isNotNull(), F.struct(adjudicated.alias("label"), F.lit("adjudicated").alias("basis"))).when(
        first == second, F.struct(first.alias("label"), F.lit("agreed").alias("basis"))
    ).when(first.isNotNull() & second.isNotNull(), F.struct(F.lit(None).cast("string").alias("label"), F.lit("disputed").alias("basis"))).when(
        first.isNotNull() | second.isNotNull(), F.struct(F.coalesce(first, second).alias("label"), F.lit("single").alias("basis"))
    )


def agreement_kappa(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """n, raw agreement and Cohen's kappa of two coders (nulls left out); null kappa where chance agreement is complete."""
    by = by or []
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = known.groupBy(*by, F.col(a).cast("string").alias("_a"), F.col(b).cast("string").alias("_b")).agg(F.count("*").alias("_n"))
    total = cells.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("_n")).otherwise(0)).alias("_same"))
    pa, pb = cells.groupBy(*by, F.col("_a").alias("_c")).agg(F.sum("_n").alias("_x")), cells.groupBy(*by, F.col("_b").alias("_c")).agg(F.sum("_n").alias("_y"))
    chance = pa.join(pb, [*by, "_c"]).groupBy(*by).agg(F.sum(F.col("_x") * F.col("_y")).alias("_e"))
    out = (total.join(chance, by, "left") if by else total.join(F.broadcast(chance))).withColumn("_e", F.coalesce("_e", F.lit(0)))
    po, pe = F.col("_same") / F.col("n"), F.col("_e") / (F.col("n") * F.col("n"))
    return out.select(*by, "n", po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def adjudication_list(df: DataFrame, key: list[str], a: str, b: str, also: dict[str, Column] | None = None) -> DataFrame:
    """Rows that need a decision: key, both codes and the reasons, joined by "; ".

    "coders disagree" where both codes are known and differ, "one coder only" where one is null; then the names of the
    conditions of ``also`` that hold (null: doesn't hold). Rows without a reason, those without any code among them, are left out.
    """
    one, two = F.col(a), F.col(b)
    reasons = [F.when(one != two, F.lit("coders disagree")), F.when(one.isNull() != two.isNull(), F.lit("one coder only"))]
    reasons += [F.when(c, F.lit(name)) for name, c in (also or {}).items()]
    return df.select(*key, one, two, F.concat_ws("; ", *reasons).alias("reasons")).where("reasons <> ''")


def confusion_rates(df: DataFrame, truth: Column, said: Column, by: list[str] | None = None) -> DataFrame:
    """Sensitivity, specificity and positive predictive value of a 0/1 code against another."""
    n = lambda c: F.count(F.when(c, 1))
    t1, s1 = truth == 1, said == 1
    t0, s0 = truth == 0, said == 0
    return df.groupBy(*(by or [])).agg(ratio(n(t1 & s1), n(t1 & (s1 | s0))).alias("sensitivity"), ratio(n(t0 & s0), n(t0 & (s1 | s0))).alias("specificity"), ratio(n(t1 & s1), n(s1 & (t1 | t0))).alias("ppv"))


def coverage_table(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Rows and the share of them with each column known."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(F.col(c).isNotNull().cast("int")).alias(f"cov_{c}") for c in columns])


def gate_by_coverage(df: DataFrame, by: list[str], columns: list[str], minimum: float = 0.8) -> DataFrame:
    """Values become null in cells whose coverage of the column is below the minimum."""
    cov = coverage_table(df, by, columns).drop("n")
    return df.join(cov, by).select(*[F.when(F.col(f"cov_{c}") >= minimum, F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def benchmark_gap(series: DataFrame, bench: DataFrame, key: list[str], by: list[str], value: str, published: str, low: str, high: str) -> DataFrame:
    """n, mean gap, mean absolute gap, correlation (three points or more) and the share inside the published bracket, per ``by``."""
    both = series.select(*key, value).join(bench.select(*key, published, low, high), key).where(F.col(value).isNotNull() & F.col(published).isNotNull())
    gap = F.col(value) - F.col(published)
    return both.groupBy(*by).agg(F.count("*").alias("n"), F.avg(gap).alias("mean_gap"), F.avg(F.abs(gap)).alias("mae"), F.when(F.count("*") >= 3, F.corr(value, published)).alias("correlation"), F.avg(F.col(value).between(F.col(low), F.col(high)).cast("int")).alias("inside"))


def summary_by_group(df: DataFrame, group: str, values: list[str], weight: str, probability: str | None = None) -> DataFrame:
    """Rows, weighted means and, with a probability, the expected count of members, per group."""
    cells = [F.count("*").alias("n"), *[weighted_mean(F.col(v), F.col(weight)).alias(f"mean_{v}") for v in values]]
    if probability:
        cells.append(F.sum(probability).alias("expected_n"))
    return df.groupBy(group).agg(*cells)
