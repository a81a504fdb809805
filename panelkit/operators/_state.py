"""Cutting the lineage of loops."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def _shared(context, path: str | None) -> str:
    """The folder of ``spark.checkpoint.dir``; a folder of our own only where that is unset and the master local. A cluster without it raises."""
    if context.getCheckpointDir() is None:
        if not path and not re.fullmatch(r"local(\[[^-]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-"))
    return path or context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame, materialised in the shared checkpoint folder."""
    spark = df.sparkSession
    _shared(spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None))
    return df.checkpoint()


def scratch(spark, label: str) -> str:
    """A new folder name beside the checkpoints, which all executors see."""
    base = _shared(spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None))
    return f"{base.rstrip('/')}/panelkit-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame as a new table beside the checkpoints, for loops that join a state to itself.

    A checkpoint keeps the size that the optimizer guessed for its plan, a product over joins, whose digits such a loop
    multiplies in each round; a table has the size of its files.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark, path: str) -> None:
    """Deletes a folder that ``scratch`` has named."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
