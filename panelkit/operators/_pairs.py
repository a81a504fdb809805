"""Pairs of ids whose groups are linked, made where they are put out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ids of one list, about; a row of two lists makes all their pairs, in parts of so many, since Spark holds what one row is exploded to.
LIST, PART = 1024, 2048


def _lists(rows: DataFrame, id: str, tag: str) -> DataFrame:
    """Distinct rows (id, columns of its group) as lists of ids of equal group; ids of several groups, or null, stand in lists of their own (_m)."""
    group = [c for c in rows.columns if c != id]
    several = F.count("*").over(Window.partitionBy(id, *[F.when(F.col(id).isNull(), F.col(c)) for c in group])) > 1
    rows = rows.distinct().withColumn(f"_m{tag}", F.col(id).isNull() | several)
    keys = [*group, f"_m{tag}"]
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / LIST).alias("_n")).select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(keys)], "_n")
    rows = rows.join(sizes, _same([(F.col(c), F.col(f"_g{i}")) for i, c in enumerate(keys)]))
    return rows.groupBy(*keys, F.pmod(F.xxhash64(id), F.col("_n")).alias(f"_p{tag}")).agg(F.collect_list(F.struct(F.col(id).alias("id"))).alias(f"_l{tag}"))


def _same(columns: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda x, y: x & y, [a.eqNullSafe(b) for a, b in columns])


def linked_pairs(l: DataFrame, r: DataFrame, a: str, b: str, links: DataFrame, score: str) -> DataFrame:
    """(a, b, score): ids of two tables whose groups are linked, each pair once with its smallest score.

    ``l`` has a and the columns of its group, ``r`` has b and those of its own; ``links`` has the columns of both and the score,
    no pair of groups twice. Lists of ids meet, not ids, and pairs are made after the last exchange. Only pairs that can
    come twice, those of an id of several groups, are grouped.
    """
    of_l, of_r = [c for c in l.columns if c != a], [c for c in r.columns if c != b]
    left = _lists(l, a, "a").withColumnsRenamed({c: f"_a{i}" for i, c in enumerate(of_l)})
    right = _lists(r, b, "b").withColumnsRenamed({c: f"_b{i}" for i, c in enumerate(of_r)})
    met = links.join(left, _same([(links[c], F.col(f"_a{i}")) for i, c in enumerate(of_l)])).join(right, _same([(links[c], F.col(f"_b{i}")) for i, c in enumerate(of_r)]))
    # Few small rows make many pairs, so they are dealt by list, never by size.
    n = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"_a{i}" for i in range(len(of_l))] + [f"_b{i}" for i in range(len(of_r))]
    met = met.repartition(n, *names, "_pa", "_pb").select(F.col(score).alias("_score"), F.col("_la.id").alias("_la"), F.col("_lb.id").alias("_lb"), (F.col("_ma") | F.col("_mb")).alias("_again"))

    def pairs(rows: DataFrame) -> DataFrame:
        # A generator with a lambda is not compiled into one loop with those behind it: parts come one by one.
        step = F.greatest(F.lit(1), F.floor(F.lit(PART) / F.size("_lb")).cast("int"))
        part = F.transform(F.sequence(F.lit(1), F.size("_la"), step), lambda i: F.slice("_la", i, step))
        rows = rows.select(F.explode(part).alias("_la"), "_lb", "_score")
        return rows.select(F.explode("_la").alias(a), "_lb", "_score").select(a, F.explode("_lb").alias(b), "_score")

    again = pairs(met.where("_again")).groupBy(a, b).agg(F.min("_score").alias("_score"))
    return pairs(met.where("NOT _again")).unionByName(again).withColumnRenamed("_score", score)
