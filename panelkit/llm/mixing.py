"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, twice over. A document's virtual finish time is
the cumulative tokens of its source divided by the source's target; all queues are merged by a global range
sort on that time and cut at the total budget, so every source reaches its target at the same time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.llm._common import cut, text_key, written
from panelkit.llm._ranges import running_totals

# Fixed values of the recipe: weights by place of the source, share of all words, passes over a source at most.
WEIGHTS, SHARE, PASSES = (5, 2, 1), 1.5, 2
WORD = "[^\\x20\\x09-\\x0D]+"


def fair_targets(sizes: list[int], weights: list[float], budget: float, passes: int = PASSES) -> list[float]:
    """Shares of the budget by weight; a share above ``passes`` times its size stops there and the excess is shared anew."""
    targets, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(budget)
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > passes * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / total
            break
        for i in over:
            targets[i] = float(passes * sizes[i])
        left -= sum(targets[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def source_targets(rows: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """_place, source, source_size, target, _start for each source, by code point, null last.

    One row per source reaches the driver; sources are the few named streams of a mixture.
    """
    found = sorted(((r[0], int(r[1])) for r in rows.groupBy("source").agg(F.sum("size")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [n for _, n in found]
    targets = fair_targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes))
    starts = [PASSES * sum(sizes[:i]) for i in range(len(sizes))]
    schema = T.StructType([T.StructField(n, t) for n, t in (("_place", T.LongType()), ("source", T.StringType()), ("source_size", T.LongType()), ("target", T.DoubleType()), ("_start", T.LongType()))])
    return rows.sparkSession.createDataFrame([(i, s, n, t, b) for i, ((s, n), t, b) in enumerate(zip(found, targets, starts, strict=True))], schema)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 9) -> DataFrame:
    """One row for each input row: ``id_col``, k1, k2 (the text's key), size, source, source_size, target, taken, passes array.

    size counts words; taken those that the mix takes, whole documents but for the last one, at most
    twice the size. Null texts have size 0 and are never taken; null sources are a source of their own;
    repeated rows collapse to a count and are numbered afterwards, so they shuffle like any others. The
    order comes from a hash of the row, so reruns agree. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), *text_key(text))
    names = ["id", "source", "size", "k1", "k2"]
    counted = cut(rows.groupBy(*names).agg(F.count("*").alias("n")))
    targets = source_targets(counted.select("source", (F.col("size") * F.col("n")).alias("size")))
    named = targets.withColumnRenamed("source", "_source")
    queued = counted.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    queued = queued.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("_pass", F.explode(F.array(*[F.lit(i) for i in range(PASSES)])))
    queued = cut(queued.drop("n").withColumn("_turn", F.xxhash64(F.lit(seed), "_pass", "_copy", *names)))
    keys = ["_place", "_pass", "_turn", "k1", "k2", "_copy"]
    line = running_totals(queued, keys, "size")
    finish = F.when(F.col("target") > 0, (F.col("_before") - F.col("_start") + F.col("size")) / F.col("target")).otherwise(0.0)
    line = cut(line.withColumn("_finish", finish).drop("_before", "_row"))
    budget = int(targets.agg(F.coalesce(F.round(F.sum("target")), F.lit(0.0))).first()[0])
    merged = running_totals(line, ["_finish", *keys], "size")
    merged = merged.withColumn("_got", F.greatest(F.lit(0), F.least(F.col("size"), F.lit(budget) - F.col("_before"))).cast("long"))
    out = merged.groupBy(*names, "_copy", "source_size", "target").agg(F.sum("_got").alias("taken"), F.array_sort(F.collect_list("_got")).alias("passes"))
    return out.select(F.col("id").alias(id_col), "k1", "k2", "size", F.col("source").alias(source_col), "source_size", "target", "taken", "passes")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = "n_chars") -> DataFrame:
    """The mix itself with the input's columns: a document once for each pass that takes it; the one that the budget cuts is shortened to the words taken.

    Rows with null or empty texts are never taken. Rows equal in id, text and source are copies of each other: they are
    taken as often as their copies are, with the other columns of one of them.
    """
    inner = [f"c{i}" for i in range(len(docs.columns))]
    at, text, source = (inner[docs.columns.index(c)] for c in (id_col, text_col, source_col))
    got = mix(docs, id_col, text_col, source_col)
    whole, part = F.filter("passes", lambda g: (g > 0) & (g == F.col("size"))), F.filter("passes", lambda g: (g > 0) & (g < F.col("size")))
    taken = got.groupBy(F.col(id_col).alias("t_id"), F.col("k1").alias("t_k1"), F.col("k2").alias("t_k2"), F.col(source_col).alias("t_source")).agg(
        F.sum(F.size(whole)).alias("whole"), F.max(F.array_max(part)).alias("part"), (F.count("*") > 1).alias("again")
    )
    taken = written(taken.where("whole > 0 OR part IS NOT NULL"), "taken")
    k1, k2 = text_key(F.col(text).cast("string"))
    keyed = docs.toDF(*inner).select(F.struct(*inner).alias("row"), F.col(at).alias("l_id"), k1.alias("l_k1"), k2.alias("l_k2"), F.col(source).cast("string").alias("l_source"))
    found = keyed.join(taken.hint("merge"), F.expr("l_id <=> t_id AND l_k1 = t_k1 AND l_k2 = t_k2 AND l_source <=> t_source"))
    once = found.where("again").groupBy("t_id", "t_k1", "t_k2", "t_source").agg(*[F.first(c).alias(c) for c in ("row", "whole", "part")])
    joined = found.where("NOT again").select("row", "whole", "part").union(once.select("row", "whole", "part"))
    times = F.array_repeat(F.lit(None).cast("long"), F.col("whole").cast("int"))
    rows = joined.withColumn("cut", F.explode(F.when(F.col("part").isNull(), times).otherwise(F.concat(times, F.array("part")))))
    short = F.array_join(F.slice(F.regexp_extract_all(F.col(f"row.{text}").cast("string"), F.lit(f"({WORD})")), F.lit(1), F.col("cut").cast("int")), " ")
    out = []
    for c, name in zip(inner, docs.columns, strict=True):
        value = F.col(f"row.{c}")
        if name == text_col:
            value = F.when(F.col("cut").isNotNull(), short).otherwise(value)
        elif name == chars_col:
            value = F.when(F.col("cut").isNotNull(), F.length(short)).otherwise(value).cast(docs.schema[name].dataType)
        out.append(value.alias(name))
    return rows.select(*out)
