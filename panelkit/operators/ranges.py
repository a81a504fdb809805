"""Order statistics of groups of any size: rows dealt into sampled ranges, and totals of ranges carried across.

Spark's range partitioner samples the splitters; the number of a row's partition is its range, fixed by a checkpoint. A
group's rows lie in neighbouring ranges, so what precedes a row is a window inside its range and one over the table of
(group, range) totals, which has no more rows than there are groups and ranges. No task holds a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.operators._names import spare
from panelkit.operators._state import checkpointed

#: Rows of a range, about, and ranges at most.
ROWS_PER_RANGE, MOST_RANGES = 100_000, 20_000


def in_ranges(df: DataFrame, keys: list[str], name: str = "_range", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Adds the number of the range of the order by ``keys`` that a row lies in; equal keys share a range. One count, one shuffle, one checkpoint."""
    n = df.count()
    ranges = max(1, min(MOST_RANGES, -(-n // rows_per_range)))
    return checkpointed(df.repartitionByRange(ranges, *keys).withColumn(name, F.spark_partition_id()))


def _spread(df: DataFrame, by: list[str], place: str, totals: dict[str, Column]) -> DataFrame:
    """(by, place) with the totals of the group's earlier ranges; sums of rows are null for a group's first range."""
    w = Window.partitionBy(*by).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*by, place).agg(*[c.alias(n) for n, c in totals.items()])
    return sums.select(*by, place, *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in totals])


def _joined(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """A join in which null keys meet."""
    inner = [f"_on{i}" for i in range(len(on))]
    right = other.withColumnsRenamed(dict(zip(on, inner, strict=True)))
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(on, inner, strict=True)]
    return df.join(right, same).drop(*inner)


def running(cells: DataFrame, by: list[str], value: str, weights: dict[str, str], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Adds for each new name the sum of its weight column over the group's smaller values; (by, value) is a key of ``cells``.

    Null values sort first, and null groups are a group. Sums are exact for whole numbers; the order of adding
    fractions depends on the ranges.
    """
    (place,) = spare(cells, "range")
    names = spare(cells, *[f"before_{n}" for n in weights])
    rows = in_ranges(cells, [*by, value], place, rows_per_range)
    early = _spread(rows, by, place, {a: F.sum(w) for a, w in zip(names, weights.values(), strict=True)})
    w = Window.partitionBy(place, *by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(n) for n, c in weights.items()])
    return _joined(inside, early, [*by, place]).select(*cells.columns, *[(F.col(n) + F.col(a)).alias(n) for n, a in zip(weights, names, strict=True)])


def dense_ranks(df: DataFrame, by: list[str], order: list[str], name: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Adds the place, from 0, of each row in its group's order; rows equal in ``order`` are numbered as they come."""
    place, early = spare(df, "range", "early")
    rows = in_ranges(df, [*by, *order], place, rows_per_range)
    before = _spread(rows, by, place, {early: F.count("*")})
    inside = rows.withColumn(name, F.row_number().over(Window.partitionBy(place, *by).orderBy(*order)) - 1)
    return _joined(inside, before, [*by, place]).select(*df.columns, (F.col(name) + F.col(early)).alias(name))


def quantiles(df: DataFrame, by: list[str], value: str, probabilities: list[float], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(by, n, q0, q1, ...): exact quantiles with linear interpolation of the known values; groups without one have n = 0 and nulls.

    Values are counted first, so that repeated ones are one row; then only the values at the asked ranks are kept.
    """
    n, held, below, v = spare(df.select(*by), "n", "held", "below", "v")
    known = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias(v)).agg(F.count("*").alias(held))
    cells = running(known, by, v, {below: held}, rows_per_range)
    totals = df.groupBy(*by).agg(F.count(value).alias(n))
    placed = _joined(cells, totals, by) if by else cells.join(F.broadcast(totals))
    picks = []
    for i, p in enumerate(probabilities):
        at = F.lit(float(p)) * (F.col(n) - 1)
        for end, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.max(F.when((F.col(below) <= rank) & (rank < F.col(below) + F.col(held)), F.col(v))).cast("double").alias(f"_{end}{i}"))
    found = placed.groupBy(*by, n).agg(*picks)
    out = [(F.col(f"_lo{i}") + (F.lit(float(p)) * (F.col(n) - 1) - F.floor(F.lit(float(p)) * (F.col(n) - 1))) * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(f"q{i}") for i, p in enumerate(probabilities)]
    done = found.select(*by, F.col(n).alias("n"), *out)
    empty = totals.where(F.col(n) == 0).select(*by, F.col(n).alias("n"), *[F.lit(None).cast("double").alias(f"q{i}") for i in range(len(probabilities))])
    return done.unionByName(empty)
