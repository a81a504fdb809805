"""Connected components of an edge table, by alternating star contractions, until a task can hold the edges that are left."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.llm._common import cut, fresh

#: Edges that one task joins at most. Rounds of contraction are for more: each is nine exchanges, whose threads stay in the driver for a minute.
EDGES = 1 << 17
#: Types that Python orders as Spark does.
PLAIN = (T.LongType(), T.IntegerType(), T.StringType())


def _joined(pairs: DataFrame) -> DataFrame:
    """(node, root) of distinct pairs, ``EDGES`` at most, in one task."""
    kind = pairs.schema["a"].dataType

    def run(batches):
        fresh("components")
        up: dict = {}

        def top(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = top(a), top(b)
                up[max(a, b)] = min(a, b)
        nodes = list(up)
        for at in range(0, len(nodes), 1 << 14):
            part = nodes[at : at + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array(part, to), pa.array(list(map(top, part)), to)], names=["node", "root"])

    to = {"long": pa.int64(), "integer": pa.int32(), "string": pa.string()}[kind.typeName()]
    return pairs.coalesce(1).mapInArrow(run, T.StructType([T.StructField("node", kind), T.StructField("root", kind)]))


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(a, b) pairs of any orderable type -> (node, root), root being the smallest node that is reachable.

    Every round is joins and map-side combined minima, so a hub never meets in one task as a list. Self
    loops and repeated pairs are allowed; nodes without an edge do not appear. An empty table gives an
    empty table. Once ``EDGES`` pairs or fewer are left, one task joins them.
    """
    pairs = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            break
        if state[0] <= EDGES and pairs.schema["a"].dataType in PLAIN:
            return cut(_joined(pairs))
        before = state
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = cut(small.union(low.select("a", F.col("m").alias("b"))).distinct())
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
