"""Running totals over a global order, by sampled splitters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bounds of the number of ranges, and so of what the driver and the executors hold of them.
LEAST_RANGES, MOST_RANGES, ROWS_PER_RANGE, SAMPLES_PER_RANGE = 1024, 20_000, 50_000, 8


def sortable(columns: list[np.ndarray]) -> np.ndarray:
    """Numbers as fixed-width bytes that sort as the numbers do."""
    out = np.empty((len(columns[0]), len(columns)), dtype=">u8")
    for i, x in enumerate(columns):
        if x.dtype.kind == "f":
            bits = (x.astype(np.float64) + 0.0).view(np.int64)
            out[:, i] = np.where(bits < 0, ~bits, bits ^ np.int64(-(2**63))).view(np.uint64)
        else:
            out[:, i] = x.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return out.view(f"S{8 * len(columns)}").ravel()


def _range_of(rows: DataFrame, keys: list[str], bounds: np.ndarray):
    shared = rows.sparkSession.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def place(frame: pd.DataFrame) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, sortable([frame[k].to_numpy() for k in keys]), side="right").astype(np.int32))

    return place(F.struct(*keys))


def _splitters(rows: DataFrame, keys: list[str], weight: str, ranges: int, n: int, total: float, seed: int) -> np.ndarray:
    """Quantiles of a sample in which a row's chance grows with its size; about SAMPLES_PER_RANGE rows a range are collected."""
    m = ranges * SAMPLES_PER_RANGE
    chance = m * 0.5 * (F.col(weight) / max(total, 1) + 1.0 / n)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / float(1 << 53)
    got = rows.where(draw < chance).select(*keys, F.greatest(chance, F.lit(1.0)).alias("_w")).toPandas()
    codes = sortable([got[k].to_numpy() for k in keys])
    order = np.argsort(codes)
    at = np.cumsum(got["_w"].to_numpy()[order])
    if not len(at):
        return codes
    cuts = np.searchsorted(at, at[-1] * np.arange(1, ranges) / ranges)
    return np.unique(codes[order][cuts])


def running_totals(rows: DataFrame, keys: list[str], weight: str, seed: int = 1) -> DataFrame:
    """Adds _before (sum of ``weight`` of all rows that sort earlier) and _row (their number).

    ``rows`` must be materialised and narrow, ``keys`` numeric, without nulls, and together unique; ``weight``
    is a non-negative long. Size-weighted samples give the splitters; a range that turns out overfull is
    subdivided by a sample of its own, so no task holds an unbounded range. Only splitters and the ranges'
    totals, of bounded number, reach the driver.
    """
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(weight), F.lit(0))).first()
    if n == 0:
        return rows.withColumn("_before", F.lit(0).cast("long")).withColumn("_row", F.lit(0).cast("long"))
    ranges = max(1, min(max(LEAST_RANGES, n // ROWS_PER_RANGE), MOST_RANGES, n // 8))
    bounds = _splitters(rows, keys, weight, ranges, n, total, seed)
    for again in range(4):
        placed = rows.withColumn("_range", _range_of(rows, keys, bounds))
        sums = placed.groupBy("_range").agg(F.count("*").alias("n"), F.sum(weight).alias("w")).toPandas().sort_values("_range")
        over = sums[(sums["n"] > max(64, 6 * n / ranges)) | (sums["w"] > 6 * total / ranges) & (sums["n"] > 16)]
        if over.empty or again == 3 or len(bounds) > 2 * MOST_RANGES:
            break
        inside = placed.join(F.broadcast(rows.sparkSession.createDataFrame(over[["_range"]].astype("int32"), "_range int")), "_range", "left_semi")
        parts = int(min(ranges, max(2, 2 * ranges * max(over["n"].sum() / n, over["w"].sum() / max(total, 1)))))
        more = _splitters(inside, keys, weight, parts, int(over["n"].sum()), float(over["w"].sum()), seed + again + 1)
        bounds = np.unique(np.concatenate([bounds, more])) if len(more) else bounds
    sums["b"] = sums["w"].cumsum() - sums["w"]
    sums["r"] = sums["n"].cumsum() - sums["n"]
    schema = T.StructType([T.StructField("_range", T.IntegerType()), T.StructField("_b", T.LongType()), T.StructField("_r", T.LongType())])
    starts = rows.sparkSession.createDataFrame([(int(a), int(b), int(c)) for a, b, c in sums[["_range", "b", "r"]].itertuples(index=False)], schema)
    order = Window.partitionBy("_range").orderBy(*keys)
    within = placed.withColumn("_sum", F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight)).withColumn("_no", F.row_number().over(order))
    joined = within.join(F.broadcast(starts), "_range")
    return joined.select(*rows.columns, (F.col("_b") + F.col("_sum")).alias("_before"), (F.col("_r") + F.col("_no") - 1).alias("_row"))
