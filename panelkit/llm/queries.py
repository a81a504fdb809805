"""The numbered queries: each applies its operator to the whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import alignment, audit, bpe, embeddings, html, media, mixing, packing, quality, sharding, simhash, substring, toxicity
from panelkit.llm._common import table, text_key


def op7_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.with_toxicity(docs.select("doc_id", "text"), model)
    score = F.col("toxicity.score")
    offsets = F.transform("toxicity.spans", lambda s: F.struct(s["first"].alias("first"), s["end"].alias("end")))
    return scored.select("doc_id", (quality.remainder("doc_id", 3) == 1).alias("held_out"), score.alias("score"), (score >= 0.7).cast("int").alias("predicted"), F.to_json(offsets).alias("offending"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality.with_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (quality.remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op1_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.records(table(spark, sf_dir, "documents"))
    placed = sharding.assign_shards(rows, ["text_crc32", "doc_id"], "size", 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_fair_queueing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = substring.repeated_spans(docs).select("k1", "k2", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    return docs.select("doc_id", *text_key(F.col("text"))).join(found, ["k1", "k2"]).drop("k1", "k2")


def op4_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = media.with_payload(media.with_probe(media.with_media(docs)))
    ranges = F.transform("probe.key_ranges", lambda r: F.concat_ws("+", r["offset"], r["length"]))
    return rows.select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", "probe.codec", "probe.timescale", "probe.duration", "probe.n_samples", "probe.n_keys", F.array_join(ranges, ",")).alias("feature"),
    )


def op5_lattice_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.linked(table(spark, sf_dir, "embeddings"))


def op6_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.with_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def word_bpe() -> str:
    """The tokenizer file of the contract."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_bpe_forced_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), word_bpe())
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_spill_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    # The .tiktoken file holds the ranks of the contract's byte_bpe_50k.json.
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), word_bpe())


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op1_sampled_splitters": op1_sampled_splitters, "op3_fair_queueing": op3_fair_queueing, "op4_iso_media": op4_iso_media, "op5_lattice_hashing": op5_lattice_hashing, "op6_line_blocks": op6_line_blocks, "op2_substring_dedup": op2_substring_dedup, "op7_toxicity_crf": op7_toxicity_crf, "op8_quality_classifier": op8_quality_classifier, "op9_simhash_golay": op9_simhash_golay, "op10_bpe_forced_boundary": op10_bpe_forced_boundary, "op11_spill_alignment": op11_spill_alignment, "op12_best_fit_packing": op12_best_fit_packing, "op13_filter_audit": op13_filter_audit}

#: What SQL can state of the contracts in full. The others hold shards, models, fingerprints, media or ids that it can't make.
ORACLES = {
    "op2_substring_dedup": r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
p AS (SELECT doc_id, w, len(w) AS n, unnest(range(1, len(w) + 1)) AS i FROM d), k AS (SELECT doc_id, n, i, w[i] AS word, CASE WHEN i + 34 <= n THEN array_to_string(w[i : i + 34], ' ') END AS win FROM p),
r AS (SELECT *, CASE WHEN win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 THEN 1 ELSE 0 END AS again FROM k), c AS (SELECT *, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(x.gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(x.kept, '')) AS kept_sha256 FROM d LEFT JOIN (SELECT doc_id, sum(gone) AS gone, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM c GROUP BY 1) x USING (doc_id)""",
    "op5_lattice_hashing": """WITH RECURSIVE v AS (SELECT vec_id, CASE WHEN len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 THEN CAST(embedding AS DOUBLE[]) END AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS s FROM v WHERE e IS NOT NULL AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) >= 0.9 * a.s * b.s),
r(node, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node), m AS (SELECT node, min(root) AS root FROM r GROUP BY 1)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, root AS component_id, vec_id = root AS kept FROM embeddings JOIN m ON node = vec_id""",
    "op13_filter_audit": r"""WITH RECURSIVE w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * len(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM w),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY 1),
g AS (SELECT part, CAST(a AS INT) + 2 * CAST(b AS INT) + 4 * CAST(c AS INT) + 8 * CAST(d AS INT) + 16 * CAST(e AS INT) AS mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
p(o) AS (SELECT '' UNION ALL SELECT o || x FROM p, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(o, x)),
s AS (SELECT o AS filter_order, CAST(unnest(range(1, 6)) AS INT) AS step FROM p WHERE len(o) = 5),
b AS (SELECT filter_order, step, CAST(pow(2, ascii(filter_order[step]) - 65) AS INT) AS own, CAST(list_sum([0] || list_transform(range(1, step), lambda i: pow(2, ascii(filter_order[i]) - 65))) AS INT) AS early FROM s),
r AS (SELECT part, filter_order, step, own, CAST(sum(CASE WHEN mask & (early + own) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN mask & early = 0 AND mask & own <> 0 THEN n ELSE 0 END) AS BIGINT) AS removed, CAST(sum(CASE WHEN mask & early <> 0 AND mask & own <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN mask = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails, CAST(sum(CASE WHEN mask & early = 0 AND mask & own <> 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN mask & early = 0 AND mask & own <> 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost FROM g, b GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r""",
}
