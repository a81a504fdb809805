"""Queries of text evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.operators import evidence
from panelkit.plans import fixtures as fx
from panelkit.registry import query

t = fx.table
TERMS = {"the": "en", "and": "en", "der": "de", "les": "fr", "que": "es"}


@query("extract_candidate_sentences", r"""WITH s AS (SELECT doc_id, section, unnest(part) AS part FROM (SELECT doc_id, unnest(list_zip(range(len(p)), p)) AS z, z[1] AS section, [z[2]] AS part FROM (SELECT doc_id, regexp_split_to_array(text, '\n+') AS p FROM documents))),
a AS (SELECT doc_id, section, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(part, '(^|[^\p{L}\p{N}_])(mr|mrs|ms|dr|jr|sr|st|vs|no|inc|co|corp|prof|gen|sen|rep|gov|[a-z])\.(\s)', '\1\2' || chr(1) || '\3', 'gi'), '(^|[^\p{L}\p{N}_])(mr|mrs|ms|dr|jr|sr|st|vs|no|inc|co|corp|prof|gen|sen|rep|gov|[a-z])\.(\s)', '\1\2' || chr(1) || '\3', 'gi'), '([.!?])\s+', '\1' || chr(2), 'g'), chr(3), ''), chr(2)), lambda x: trim(replace(x, chr(1), '.'))), lambda x: x <> '') AS l FROM s),
n AS (SELECT doc_id, section, l, unnest(range(len(l))) AS number FROM a), h AS (SELECT *, l[number + 1] AS sentence, list_filter(['and', 'der', 'les', 'que', 'the'], lambda w: contains(' ' || regexp_replace(lower(l[number + 1]), '[^\p{L}\p{N}]+', ' ', 'g') || ' ', ' ' || w || ' ')) AS terms FROM n)
SELECT doc_id, section, number, sentence, CASE WHEN number > 0 THEN l[number] END AS previous, l[number + 2] AS next, array_to_string(terms, ',') AS terms, CAST(terms = ['the'] OR terms = ['and'] OR terms = ['and', 'the'] AS INT) AS noisy_only FROM h WHERE len(terms) > 0""")
def _(spark, d):
    out = evidence.extract_candidate_sentences(t(spark, d, "documents"), "doc_id", "text", TERMS, ["en"])
    return out.select("doc_id", "section", "number", "sentence", "previous", "next", F.array_join("terms", ",").alias("terms"), "noisy_only")


@query("extract_dated_statements", """SELECT o_orderkey, 0 AS number, c_mktsegment AS entity_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, 'order' AS kind, 'Mr. Smith of the ' || lower(c_mktsegment) || ' office placed it on ' || strftime(o_orderdate, '%B %-d, %Y') || '.' AS sentence
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 7 NOT IN (1, 2, 3)""")
def _(spark, d):
    """Dated order notices: one for each order, with the customer's segment as the entity, some with two dates, no verb or a denial."""
    o = t(spark, d, "orders").join(t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    day = F.date_format("o_orderdate", "MMMM d, yyyy")
    n = F.col("o_orderkey") % 7
    text = F.concat(F.lit("Mr. Smith of the "), F.lower("c_mktsegment"), F.when(n == 1, " office wrote on ").when(n == 2, " office never placed it on ").otherwise(" office placed it on "), day, F.when(n == 3, F.concat(F.lit(" or "), F.date_format(F.date_add("o_orderdate", 1), "MMMM d, yyyy"))).otherwise(""), F.lit(". It was paid. Nothing else."))
    names = t(spark, d, "customer").select(F.lower("c_mktsegment").alias("name"), F.col("c_mktsegment").alias("entity_id")).distinct()
    return evidence.extract_dated_statements(o.select("o_orderkey", text.alias("text")), "o_orderkey", "text", r"\bplaced\b", r"\bnever\b", names, {"order": r"\bit\b"}).withColumn("date", F.col("date").cast("string"))
