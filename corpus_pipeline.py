"""A training corpus in five stages: quality, near-duplicates, repeated passages, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All take nulls in any column,
empty and very long texts, repeated rows, empty tables and extra columns; the last one alone changes the columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import bpe, mixing, quality, simhash, substring
from panelkit.llm._common import table, written
from panelkit.llm.queries import word_bpe


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents scored under 0.3; the model is fitted on the labelled rows among the documents given.

    Null and empty texts score 0 and go. Equal texts have equal scores, so copies stay or go together. No column is
    added or overwritten.
    """
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    score = "quality_score"
    while score in {c.lower() for c in docs.columns}:
        score = f"_{score}"
    return quality.with_score(docs, model, out_col=score).where(f"{score} >= 0.3").select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near-duplicates: shingles of five words, similarity 0.8 or more.

    Texts without words are one group; a null id is kept only where its group has no other; repeated rows stay once.
    """
    return simhash.keep_one(docs, similarity=0.8, shingle_words=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out the words of windows that repeat; texts that lose nothing stay as they are, null texts stay null, no row goes."""
    return substring.without_repeats(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents until each source has its target; texts without words are left out, a null source is one of its own."""
    return mixing.mixture(docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with the number of tokens and the text that they decode to; of the other columns only id and source stay.

    Null and empty texts have no ids and an empty decoded text.
    """
    coded = bpe.encode_decode(docs.select("doc_id", "source", "text"), word_bpe())
    return coded.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", mixing_sources),
    ("BPE encoding and decoding", bpe_tokens),
]

#: Models, fingerprints and tokens are beyond SQL; tests/llm compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; each result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage{i}")
    return docs
