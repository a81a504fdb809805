"""Quality and invariant jobs: each returns rows that state what was found; nothing is collected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assert_unique_key(df: DataFrame, key: list[str]) -> DataFrame:
    """n_rows, n_null_keys (rows with a null in the key) and n_repeated_keys (keys held by several rows)."""
    null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in key])
    per_key = df.groupBy(*key).agg(F.count("*").alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(null, F.col("_n"))), F.lit(0)).alias("n_null_keys"),
        F.count(F.when(~null & (F.col("_n") > 1), 1)).alias("n_repeated_keys"),
    )


def assert_references(child: DataFrame, parent: DataFrame, on: list[tuple[str, str]], floor: float = 1.0) -> DataFrame:
    """Child keys found in the parent, their share against a floor, and parents without a child."""
    parents = parent.select(*[F.col(p).alias(f"_p{i}") for i, (_, p) in enumerate(on)]).distinct()
    kids = child.groupBy(*[F.col(c).alias(f"_c{i}") for i, (c, _) in enumerate(on)]).agg(F.count("*").alias("_n"))
    same = reduce(lambda a, b: a & b, [F.col(f"_c{i}") == F.col(f"_p{i}") for i in range(len(on))])
    both = kids.join(parents, same, "full_outer")
    found, there = F.col("_p0").isNotNull(), F.col("_n").isNotNull()
    out = both.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_child"),
        F.coalesce(F.sum(F.when(found, F.col("_n"))), F.lit(0)).alias("n_found"),
        F.count(F.when(found & ~there, 1)).alias("n_parents_without_child"),
    )
    share = F.try_divide(F.col("n_found"), F.col("n_child"))
    return out.withColumn("share_found", share).withColumn("ok", F.coalesce(share >= floor, F.lit(True)))


def assert_mapped(df: DataFrame, codes: dict[str, DataFrame], floor: float = 1.0) -> DataFrame:
    """One row per code column: distinct codes, those that its dimension (one column) lacks, the share of rows mapped, ok.

    Rows with a null code don't count.
    """
    out = None
    for column, dim in codes.items():
        known = dim.toDF("_code").distinct().withColumn("_known", F.lit(True))
        counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_code")).agg(F.count("*").alias("_n")).join(known, "_code", "left")
        row = counts.agg(F.lit(column).alias("column_name"), F.count("*").alias("n_codes"), F.count(F.when(F.col("_known").isNull(), 1)).alias("n_unmapped"), F.try_divide(F.sum(F.when(F.col("_known"), F.col("_n")).otherwise(0)), F.sum("_n")).alias("share_mapped"))
        row = row.withColumn("ok", F.coalesce(F.col("share_mapped") >= floor, F.lit(True)))
        out = row if out is None else out.union(row)
    return out


def sums_to_one(columns: list[str], tolerance: float = 1e-6) -> Column:
    """A rule for ``assert_ranges``: probabilities in [0, 1] that sum to 1."""
    total = reduce(lambda a, b: a + b, [F.col(c) for c in columns])
    return reduce(lambda a, b: a & b, [F.col(c).between(0, 1) for c in columns], F.abs(total - 1) <= tolerance)


def assert_window_complete(df: DataFrame, period: str, first: int, last: int, columns: list[str]) -> DataFrame:
    """One row per expected period: rows, null shares of columns, severity (CRITICAL when the period is missing)."""
    spark = df.sparkSession
    expected = spark.range(first, last + 1).select(F.col("id").cast("int").alias(period))
    found = df.groupBy(period).agg(F.count("*").alias("n_rows"), *[F.avg(F.col(c).isNull().cast("double")).alias(f"null_{c}") for c in columns])
    out = expected.join(found, period, "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    worst = F.greatest(*[F.coalesce(f"null_{c}", F.lit(0.0)) for c in columns], F.lit(0.0))
    return out.withColumn("severity", F.when(F.col("n_rows") == 0, "CRITICAL").when(worst > 0, "WARN").otherwise("OK"))


def assert_ranges(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per rule: rows checked and rows that break it; a rule that is null on a row counts as broken."""
    sums = df.agg(F.count("*").alias("_all"), *[F.count(F.when(~F.coalesce(r, F.lit(False)), 1)).alias(n) for n, r in rules.items()])
    return sums.select("_all", F.explode(F.map_from_arrays(F.array(*map(F.lit, rules)), F.array(*rules))).alias("rule", "n_broken")).select("rule", F.col("_all").alias("n_rows"), "n_broken")


def assert_no_lookahead(df: DataFrame, known: str, cutoff: str, fact: str) -> DataFrame:
    """Rows whose information is later than the cutoff, or whose cutoff is later than the fact."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count(F.when(F.col(known) > F.col(cutoff), 1)).alias("n_known_too_late"),
        F.count(F.when(F.col(cutoff) > F.col(fact), 1)).alias("n_cutoff_too_late"),
    )


def assert_provenance(roles: DataFrame, sources: DataFrame, on: list[str], known: str, cutoff: str) -> DataFrame:
    """Opening roles: those without a source row, and those whose earliest source is later than the cutoff."""
    first = sources.groupBy(*on).agg(F.min(known).alias("_known"))
    rows = roles.join(first, on, "left")
    return rows.agg(F.count("*").alias("n_rows"), F.count(F.when(F.col("_known").isNull(), 1)).alias("n_without_source"), F.count(F.when(F.col("_known") > F.col(cutoff), 1)).alias("n_source_too_late"))


def assert_recount(stored: DataFrame, recount: DataFrame, key: list[str], value: str) -> DataFrame:
    """Stored totals against an independent recount: keys on one side only, keys that differ, and the largest gap."""
    a, b = stored.select(*key, F.col(value).alias("_a")), recount.select(*key, F.col(value).alias("_b"))
    both = a.join(b, key, "full_outer")
    return both.agg(
        F.count("*").alias("n_keys"), F.count(F.when(F.col("_a").isNull() | F.col("_b").isNull(), 1)).alias("n_one_side"), F.count(F.when(F.col("_a") != F.col("_b"), 1)).alias("n_differ"), F.coalesce(F.max(F.abs(F.col("_a") - F.col("_b"))), F.lit(0)).alias("max_gap")
    )


def assert_lag_identity(df: DataFrame, by: list[str], time: str, value: str, stored: str) -> DataFrame:
    """Compares a stored lag with the same unit's value in exactly the period before."""
    before = df.select(*by, (F.col(time) + 1).alias(time), F.col(value).alias("_before"))
    both = df.join(before, [*by, time], "left")
    return both.agg(
        F.count("*").alias("n_rows"),
        F.count(F.when(~F.col(stored).eqNullSafe(F.col("_before")), 1)).alias("n_wrong"),
        F.coalesce(F.max(F.abs(F.col(stored) - F.col("_before"))), F.lit(0.0)).alias("max_gap"),
    )


def assert_censoring(df: DataFrame, implications: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row per implication (premise, conclusion): rows under the premise and rows that break it."""
    return assert_ranges_under(df, implications)


def assert_ranges_under(df: DataFrame, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    cells = []
    for n, (premise, conclusion) in rules.items():
        held = F.coalesce(premise, F.lit(False))
        cells += [F.count(F.when(held, 1)).alias(f"{n}_all"), F.count(F.when(held & ~F.coalesce(conclusion, F.lit(False)), 1)).alias(f"{n}_bad")]
    row = df.agg(*cells)
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"{n}_all").alias("n_rows"), F.col(f"{n}_bad").alias("n_broken")) for n in rules])
    return row.select(F.inline(pairs))


def assert_groupwise_constant(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """For each column, the number of keys and of keys in which it takes several values (null counts as none)."""
    per_key = df.groupBy(*key).agg(*[F.min(c).alias(f"_lo_{c}") for c in columns], *[F.max(c).alias(f"_hi_{c}") for c in columns])
    row = per_key.agg(F.count("*").alias("n_keys"), *[F.count(F.when(F.col(f"_lo_{c}") != F.col(f"_hi_{c}"), 1)).alias(c) for c in columns])
    return row.select("n_keys", F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*columns))).alias("column_name", "n_varying"))


def assert_slope(df: DataFrame, y: str, x: str, margin: float = 0.15) -> DataFrame:
    """Slope of an outcome on its own forecast, and whether it lies within 1 ± margin."""
    out = df.agg(F.regr_slope(y, x).alias("slope"), F.count(F.when(F.col(y).isNotNull() & F.col(x).isNotNull(), 1)).alias("n_rows"))
    return out.withColumn("ok", F.abs(F.col("slope") - 1) <= margin)


def profile_columns(df: DataFrame) -> DataFrame:
    """One row per column: type, rows, share that is not null, smallest and largest value as text; one pass."""
    plain = [f for f in df.schema.fields if f.dataType.typeName() not in ("array", "map", "struct", "binary")]
    cells = [c for i, f in enumerate(plain) for c in (F.count(F.col(f"`{f.name}`")).alias(f"n{i}"), F.min(F.col(f"`{f.name}`")).cast("string").alias(f"lo{i}"), F.max(F.col(f"`{f.name}`")).cast("string").alias(f"hi{i}"))]
    row = df.agg(F.count("*").alias("n_rows"), *cells)
    rows = [F.struct(F.lit(f.name).alias("variable"), F.lit(f.dataType.simpleString()).alias("type"), F.col("n_rows"), F.try_divide(F.col(f"n{i}"), F.col("n_rows")).alias("share_present"), F.col(f"lo{i}").alias("min_value"), F.col(f"hi{i}").alias("max_value")) for i, f in enumerate(plain)]
    return row.select(F.inline(F.array(*rows)))
