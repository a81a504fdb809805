"""Sharding by sampled splitters: records in the order of a key, cut into shards of nearly equal bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm._common import cut
from panelkit.llm._ranges import running_totals

#: What every record costs besides its text.
RECORD_BYTES = 16


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc id, size (UTF-8 bytes of the text plus RECORD_BYTES) and text_crc32 of every row; null texts count as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col), (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))


def assign_shards(rows: DataFrame, key_cols: list[str], size_col: str, shards: int) -> DataFrame:
    """Adds shard (0 to shards - 1) and slot (gapless from 0 in each shard, in key order) to narrow records.

    A shard takes the records whose middle lies within its share of all bytes, so either end of a shard is
    off by half a record at most. Keys are numbers; nulls sort first. Equal records collapse to a count before
    they are dealt out and are numbered copies afterwards, so a hot record is split like any other. Fewer
    records than shards leave shards empty; an empty table gives an empty table.
    """
    names = rows.columns
    counted = rows.groupBy(*names).agg(F.count("*").alias("_n"))
    copies = counted.select(*names, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy"))
    keys = []
    for i, c in enumerate([*key_cols, size_col]):
        copies = copies.withColumn(f"_none{i}", F.col(c).isNotNull().cast("int")).withColumn(f"_key{i}", F.coalesce(F.col(c), F.lit(0).cast(rows.schema[c].dataType)))
        keys += [f"_none{i}", f"_key{i}"]
    placed = running_totals(cut(copies), [*keys, "_copy"], size_col)
    total = rows.agg(F.coalesce(F.sum(size_col), F.lit(0))).first()[0]
    shard = F.expr(f"CAST(LEAST((2 * _before + {size_col}) * {shards} DIV {max(2 * total, 1)}, {shards - 1}) AS INT)")
    placed = cut(placed.select(*names, shard.alias("shard"), "_row"))
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(*names, "shard", (F.col("_row") - F.col("_first")).alias("slot"))
