"""Readers and checked writers."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.operators._names import refuse, spare
from panelkit.operators.quality import assert_unique_key, profile_columns

WHOLE_FILE = 1 << 28


def stack_partitions(frames: dict[object, DataFrame], period: str = "period") -> DataFrame:
    """Frames of one period each, stacked by column name; columns that a period lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn(period, F.lit(k)) for k, f in frames.items()])


def scan_partitioned(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet files of several periods with their schemas merged."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def empty_partitions(df: DataFrame, period: str, expected: DataFrame) -> DataFrame:
    """Expected periods without a row; a loader raises or warns on them."""
    return expected.join(df.select(period).distinct(), period, "left_anti")


def scan_json_flatten(df: DataFrame, column: str, schema: str, prefix: str, states: dict[str, Column] | None = None) -> DataFrame:
    """Nested objects of a JSON column as ``prefix_key`` columns; arrays stay arrays, null or broken payloads give nulls.

    ``states`` names flattened columns and what they must hold (the period that was asked for, say). A payload that states
    something else there is an error; one that states nothing passes.
    """
    (at,) = spare(df, "json")
    parsed = df.withColumn(at, F.from_json(column, schema))
    flat = _flat(parsed.schema[at].dataType, F.col(at), prefix)
    refuse(df, *[c for c in parsed.select(*flat).columns])
    out = parsed.select(*df.columns, *flat)
    if states:
        wrong = out.where(reduce(lambda a, b: a | b, [F.col(c) != v for c, v in states.items()]))
        n = wrong.count()
        if n:
            raise ValueError(f"{n} payloads state another {list(states)} than was asked for")
    return out


def _flat(kind: T.StructType, at, prefix: str) -> list:
    cols = []
    for f in kind.fields:
        name, value = f"{prefix}_{f.name}".lower(), at[f.name]
        cols += _flat(f.dataType, value, name) if isinstance(f.dataType, T.StructType) else [value.alias(name)]
    return cols


def explode_nested_history(df: DataFrame, key: list[str], column: str) -> DataFrame:
    """One row per entry of a list-of-struct column, taken once per key, with a sequence from 1; all-null entries go."""
    first = df.dropDuplicates(key)
    rows = first.select(*key, F.posexplode(column).alias("_pos", "_entry")).select(*key, (F.col("_pos") + 1).alias("seq"), "_entry.*")
    fields = [c for c in rows.columns if c not in (*key, "seq")]
    return rows.where(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in fields]))


def read_suppressed_csv(spark: SparkSession, path: str, schema: str, mark: str = "(S)") -> DataFrame:
    """CSV in which ``mark`` stands for a suppressed cell; the names NULL and NA stay text."""
    return spark.read.csv(path, header=True, schema=schema, nullValue=mark)


def fill_suppressed(df: DataFrame, shares: list[str]) -> DataFrame:
    """Spreads what the reported shares leave of 1 evenly over the suppressed cells and rescales the row to 1."""
    known = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in shares), F.lit(0.0))
    gaps = sum((F.col(c).isNull().cast("int") for c in shares), F.lit(0))
    each = F.when(gaps > 0, F.greatest(F.lit(1.0) - known, F.lit(0.0)) / gaps)
    filled = [F.coalesce(F.col(c), each) for c in shares]
    total = sum(filled, F.lit(0.0))
    return df.select(*[c for c in df.columns if c not in shares], *[F.try_divide(f, total).alias(c) for f, c in zip(filled, shares, strict=True)])


def write_full_refresh(df: DataFrame, path: str, name: str, source: str, note: str = "") -> DataFrame:
    """Replaces the Parquet table at ``path``/``name`` with the whole frame and appends its row to the log of ``path``; returns that row.

    The row counts what was read back from the files, which the log states only once they are complete.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/{name}")
    n = spark.read.schema(df.schema).parquet(f"{path}/{name}").count()
    row = spark.createDataFrame([(name, n, len(df.columns), source, note)], "table_name string, n_rows long, n_cols long, source string, note string").withColumn("built_at", F.current_timestamp())
    row.write.mode("append").parquet(f"{path}/_panelkit_log")
    return row


def build_log(spark: SparkSession, path: str) -> DataFrame:
    """The last row of the log for each table that ``write_full_refresh`` wrote below ``path``, with the number of its builds."""
    log = spark.read.parquet(f"{path}/_panelkit_log/*.parquet")
    kept = [c for c in log.columns if c != "table_name"]
    return log.groupBy("table_name").agg(F.max_by(F.struct(*kept), "built_at").alias("last"), F.count("*").alias("n_builds")).select("table_name", "last.*", "n_builds")


def write_sample(df: DataFrame, path: str, name: str, key: list[str], labels: dict[str, str]) -> DataFrame:
    """Checked write: the key must be complete and unique; Parquet, CSV and the codebook, which is returned."""
    bad = assert_unique_key(df, key).where("n_null_keys + n_repeated_keys > 0 OR n_rows = 0")
    if bad.take(1):
        raise ValueError(f"{name}: the key {key} is empty, incomplete or repeated")
    df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}.csv")
    names = F.create_map(*[F.lit(x) for kv in (labels or {"": ""}).items() for x in kv])
    book = profile_columns(df).withColumn("label", names[F.col("variable")])
    book.write.mode("overwrite").parquet(f"{path}/{name}-codebook.parquet")
    return book


def merge_curated_overlay(universe: DataFrame, sheet: DataFrame, key: str, manual: list[str]) -> DataFrame:
    """Refreshes a hand-kept sheet: identity columns from the universe, manual columns from the sheet, departed keys kept as stale.

    A key that either side repeats is an error, since it would repeat manual cells. Rows with a null key meet nothing and stay.
    """
    for side, rows in (("universe", universe), ("sheet", sheet)):
        if rows.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError(f"the {side} repeats a key of {key}")
    identity = [c for c in universe.columns if c != key]
    (here,) = spare(universe, "here")
    u, s = universe.withColumn(here, F.lit(1)).alias("u"), sheet.alias("s")
    joined = u.join(s, F.col(f"u.{key}") == F.col(f"s.{key}"), "full_outer")
    gone = F.col(f"u.{here}").isNull()
    return joined.select(
        F.coalesce(f"u.{key}", f"s.{key}").alias(key),
        *[F.when(gone, F.col(f"s.{c}")).otherwise(F.col(f"u.{c}")).alias(c) if c in sheet.columns else F.col(f"u.{c}").alias(c) for c in identity],
        *[F.col(f"s.{c}").alias(c) for c in manual],
        gone.cast("int").alias("stale"),
    )


def manual_cells(before: DataFrame, after: DataFrame, manual: list[str]) -> DataFrame:
    """(column, n_before, n_after, lost): the filled cells of each manual column before and after a refresh; lost must be 0."""
    n = lambda rows: rows.agg(*[F.count(c).alias(c) for c in manual]).unpivot([], manual, "column", "n")
    both = n(before).withColumnRenamed("n", "n_before").join(n(after).withColumnRenamed("n", "n_after"), "column")
    return both.withColumn("lost", F.col("n_before") - F.col("n_after"))


def _digests(batches):
    from pyarrow import fs

    for batch in batches:
        sums = []
        for path in batch["path"]:
            system, at = fs.FileSystem.from_uri(path)
            total = hashlib.sha256()
            with system.open_input_stream(at) as stream:
                while piece := stream.read(1 << 23):
                    total.update(piece)
            sums.append(total.hexdigest())
        yield batch[["path"]].assign(sha256=sums)


def verify_source_checksum(spark: SparkSession, paths: list[str], manifest: DataFrame) -> DataFrame:
    """file_name, sha256 and status (ok, mismatch, missing, unlisted) of files against (file_name, recorded).

    Files up to ``WHOLE_FILE`` bytes are one value each; larger ones are read in pieces by a task, from a file system that
    pyarrow knows. Spark lists no empty files, so those count as missing.
    """
    found = spark.read.format("binaryFile").load(paths)
    name = F.element_at(F.split("path", "/"), -1).alias("file_name")
    files = found.where(F.col("length") <= WHOLE_FILE).select(name, F.sha2("content", 256).alias("sha256"))
    large = found.where(F.col("length") > WHOLE_FILE).select("path").mapInPandas(_digests, "path string, sha256 string")
    files = files.unionByName(large.select(name, "sha256"))
    status = F.when(F.col("recorded").isNull(), "unlisted").when(F.col("sha256").isNull(), "missing").when(F.col("sha256") == F.col("recorded"), "ok").otherwise("mismatch")
    return files.join(manifest, "file_name", "full_outer").withColumn("status", status)
