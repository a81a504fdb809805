"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as ``bytes.split()`` takes it and as the contracts' word pattern states it.
SPACES = "[\\x20\\x09-\\x0D]+"
#: What ``written`` and bucketed tables have left in this session, as (kind, name); ``clean`` removes it.
made: list[tuple[str, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a folder of our own only where that is unset and the master local, as in tests. A cluster without it raises."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not path and not re.fullmatch(r"local(\[[^-]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-"))
    return path or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialises a narrow frame in the shared checkpoint folder and cuts its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Materialises a wide frame as Parquet in the shared checkpoint folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/panelkit-{label}-{uuid.uuid4().hex}"
    made.append(("folder", path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Removes the tables and folders of intermediate rows; to be called when results have been read."""
    while made:
        kind, name = made.pop()
        if kind == "table":
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        else:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_key(text) -> list:
    """Two 64-bit columns that together identify a text."""
    known = F.coalesce(text, F.lit(""))
    return [F.xxhash64(known).alias("k1"), F.xxhash64(F.lit(7), known, F.length(known)).alias("k2")]


#: Bytes of rows that one Python task takes, about.
TASK_BYTES = 64 << 20


def longer_tasks(df: DataFrame) -> DataFrame:
    """Neighbouring partitions together, so that short Python tasks don't each start a worker: about TASK_BYTES of rows a task, as the
    optimizer sizes them, and no fewer tasks than three for each core that is there."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.coalesce(max(3 * df.sparkSession.sparkContext.defaultParallelism, min(size // TASK_BYTES, 1 << 20)))


_state: dict = {}


def worker_state(key, make):
    """What a Python worker keeps between tasks, made once: one operator's at a time, so that a worker which serves several holds the last one's alone."""
    if key not in _state:
        _state.clear()
        give_back()
        _state[key] = make()
    return _state[key]


#: Of the C library that has it; without it, freed memory stays with the worker.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns freed memory to the system; workers live for many tasks and otherwise keep their largest task's."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def fresh(operator: str) -> None:
    """For the start of a Python task that keeps nothing: drops what another operator has left in this worker, and gives freed memory back."""
    worker_state((operator,), dict)
    give_back()


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
