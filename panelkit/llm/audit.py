"""How five filters of a corpus act together: every order of them, and each one's Shapley share of what goes.

The removal game gives each coalition of filters the number of documents that fail one of its members. Its
Hart-Mas-Colell potential is P(none) = 0 and P(S) = (v(S) + sum of P(S without i) over i in S) / |S|; a filter's
Shapley value is P(all) - P(all without it). What a filter removes at its place of an order is v(S with i) - v(S),
S being the filters before it. So one count per failure pattern is all that is taken from the corpus; the 32
coalitions and 600 steps are derived from it.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.llm._common import SPACES

# Fixed values of the contract: the filters' letters (E: repeats an earlier text) and their bounds.
LETTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 200, 50, 2, "[#$%&*|]"
REPEAT, ALL, ORDERS = 1 << 4, (1 << 5) - 1, 120
#: Documents with a null id are spread over so many places of the join with the labels.
NULL_PLACES = 1024


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails A, B, C and D. A text without words fails A alone: 0 of 0 is no shortfall."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        F.size(words) < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words),
        100 * capitals > CAPITAL_PERCENT * F.length(text),
        text.rlike(MARKS),
    ]


def failure_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """part, mask (bit i: the document fails filter i), good, toxic, n: one row for each combination that occurs.

    Null texts are empty texts, a null source is the part '' (as an empty one is). A document fails E if its text is
    that of a smaller id; rows of the smallest id itself, repeated or not, and rows without an id don't. A document
    is good (toxic) if any row of ``labels`` says so; ids without a row are neither. Other columns are not read.
    An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # The parts of the mask are named first, so that the words are split once.
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("key"), *[f.alias(c) for f, c in zip(text_failures(text), LETTERS, strict=False)])
    mask = sum((F.when(F.col(c), 1 << i).otherwise(0) for i, c in enumerate(LETTERS[:4])), F.lit(0))
    counted = rows.groupBy("id", "part", "key", mask.alias("mask")).agg(F.count("*").alias("n"))
    place = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("key"), F.lit(NULL_PLACES))).otherwise(F.lit(0).cast("long"))
    said = labels.groupBy(F.col(id_col).alias("l_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    said = said.where("l_id IS NOT NULL").withColumn("l_place", F.lit(0).cast("long"))
    joined = counted.withColumn("place", place).join(said, F.expr("id = l_id AND place = l_place"), "left")
    # Copies meet only after they are summed: a text has one row for each part and label.
    texts = joined.groupBy("key", "mask", "part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(
        F.sum("n").alias("n"), F.min("id").alias("first"), F.min_by("n", "id").alias("n_first"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_null")
    )
    texts = texts.withColumn("first_of_all", F.min("first").over(Window.partitionBy("key")))
    kept = F.col("n_null") + F.when(F.col("first") == F.col("first_of_all"), F.col("n_first")).otherwise(0)
    both = F.array(F.struct(F.col("mask").alias("mask"), kept.alias("n")), F.struct((F.col("mask") + REPEAT).alias("mask"), (F.col("n") - kept).alias("n")))
    return texts.select("part", "good", "toxic", F.explode(both).alias("r")).groupBy("part", "r.mask", "good", "toxic").agg(F.sum("r.n").alias("n")).where("n > 0")


def removal_games(counts: DataFrame) -> DataFrame:
    """part, n, and the arrays v, v_good, v_toxic: for each of the 32 coalitions (at its bits) the documents that fail one of its filters."""

    def game(which: Column | None) -> Column:
        n = F.col("n") if which is None else F.when(which, F.col("n")).otherwise(0)
        return F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(s) != 0, n).otherwise(0)) for s in range(ALL + 1)])

    return counts.groupBy("part").agg(F.sum("n").alias("n"), game(None).alias("v"), game(F.col("good")).alias("v_good"), game(F.col("toxic")).alias("v_toxic"))


def at(array: str, place: Column | int) -> Column:
    return F.get(F.col(array), F.lit(place) if isinstance(place, int) else place)


def potential(v: Column) -> Column:
    """The potential of each coalition, times 120, which makes all of them whole numbers."""

    def grown(p: Column, s: Column) -> Column:
        members = [F.when(s.bitwiseAND(1 << i) != 0, F.get(p, s - (1 << i))).otherwise(0) for i in range(5)]
        return F.concat(p, F.array(F.expr("0L") + ((ORDERS * F.get(v, s) + sum(members[1:], members[0])) / F.bit_count(s)).cast("long")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ALL)), F.array(F.lit(0).cast("long")), grown)


def interactions(counts: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, from ``failure_counts``; columns as ``audit`` states."""
    games = removal_games(counts).withColumn("p", potential(F.col("v")))
    orders = F.array(*[F.lit("".join(o)) for o in permutations(LETTERS)])
    steps = games.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(5))))
    bits = F.transform(F.split("filter_order", ""), lambda c: F.call_function("shiftleft", F.lit(1), F.ascii(c) - ord(LETTERS[0])))
    steps = steps.withColumn("bits", bits).withColumn("own", F.get("bits", F.col("step") - 1))
    steps = steps.withColumn("before", F.aggregate(F.slice("bits", F.lit(1), F.col("step") - 1), F.lit(0), lambda a, b: a + b)).withColumn("after", F.col("before") + F.col("own"))
    gone = at("v", F.col("after")) - at("v", F.col("before"))
    out = {
        "kept": F.col("n") - at("v", F.col("after")),
        "removed": gone,
        "redundant": at("v", F.col("own")) - gone,
        "unique_fails": at("v", ALL) - at("v", F.lit(ALL) - F.col("own")),
        "good_lost": at("v_good", F.col("after")) - at("v_good", F.col("before")),
        "toxic_lost": at("v_toxic", F.col("after")) - at("v_toxic", F.col("before")),
        "shapley": at("p", ALL) - at("p", F.lit(ALL) - F.col("own")),
    }
    return steps.select("part", "filter_order", "step", *[c.cast("long").alias(k) for k, c in out.items()])


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows a part.

    Counts are documents of the part. kept: left after this step; removed: by it; redundant: fail its filter and went
    earlier; unique_fails: fail its filter alone; good_lost, toxic_lost: removed here and labelled so; shapley: 120 times
    the filter's Shapley value, that is what it removes summed over all orders. Nulls, repeats and empty tables as
    ``failure_counts`` states.
    """
    return interactions(failure_counts(docs, labels, id_col, text_col, source_col))
