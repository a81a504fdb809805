"""Every numbered query and the pipeline's stages on a small folder of tables, against plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from panelkit.llm import queries
from test_simhash import jaccard_roots
from tokenizers import Tokenizer

BAD = ["grumblex", "snarlish", "vexoid"]


def words(rng, n):
    return ["".join(rng.choice(["an", "th", "er", "on", "re", "ti", "so", "le"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(4)
    passage = " ".join(words(rng, 60))
    docs, labels = [], []
    for i in range(160):
        text = words(rng, rng.randint(20, 150))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                text[rng.randrange(len(text))] = rng.choice(BAD)
        junk = i % 7 == 3
        body = " ".join(text) if not junk else " ".join(["###!!", "0000"] * 40)
        docs.append((i, body + (f" {passage}" if i % 10 == 1 else ""), "en", f"src{i % 4}" if i % 9 else None, len(body)))
        labels.append((i, int(not junk), int(toxic)))
    near = docs[2][1].split() + words(rng, 200)
    docs += [(200, " ".join(near), "en", "src1", 1), (201, " ".join([*near[:-1], "changed"]), "en", "src1", 1), (202, " ".join(near), "en", "src2", 1), (203, None, None, None, None), (204, "", "en", "src0", 0), (205, docs[5][1], "en", "src3", 9)]
    vectors = np.random.default_rng(2).normal(size=(40, 16))
    vectors[7] = vectors[3] + 0.01
    page = "<html><nav>menu a b c</nav><article><p>" + "The story goes on for a while. " * 5 + "</p><p>" + "It ends well after all that. " * 5 + "</p></article><footer>foot</footer></html>"
    return docs, labels, vectors, page


@pytest.fixture(scope="module")
def folder(spark, tables, tmp_path_factory):
    docs, labels, vectors, page = tables
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([(0, "u", page), (1, "v", None), (2, "w", "<p>")], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


def split(text):
    return (text or "").encode().split()


def rows_of(spark, folder, name):
    return queries.QUERIES[name](spark, folder).collect()


def test_sharding(spark, folder, tables):
    rows = rows_of(spark, folder, "op1_sampled_splitters")
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in tables[0])
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert 0 <= shard < 40 and slots == list(range(len(slots)))
    sums = Counter()
    for r in rows:
        sums[r.shard] += r.size
    assert max(sums.values()) - sum(sums.values()) / 40 <= max(r.size for r in rows)


def test_substring(spark, folder, tables):
    seen = Counter(tuple(w[i : i + 35]) for w in map(split, (d[1] for d in tables[0])) for i in range(len(w) - 34))
    want = {}
    for i, t, *_ in tables[0]:
        w = split(t)
        gone = {j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        want[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest())
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows_of(spark, folder, "op2_substring_dedup")} == want


def test_mixing(spark, folder, tables):
    rows = rows_of(spark, folder, "op3_fair_queueing")
    source = {d[0]: d[3] for d in tables[0]}
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        sizes[source[r.doc_id]] += r["size"]
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(r.source_size == sizes[source[r.doc_id]] for r in rows) and len(rows) == len(tables[0])
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    left, open_, want = 1.5 * sum(sizes.values()), list(range(len(names))), {}
    weigh = [(5, 2, 1)[i % 3] for i in range(len(names))]
    while open_:
        share = {i: left * weigh[i] / sum(weigh[j] for j in open_) for i in open_}
        over = [i for i in open_ if share[i] > 2 * sizes[names[i]]]
        want |= {names[i]: share[i] for i in open_} | {names[i]: 2.0 * sizes[names[i]] for i in over}
        if not over:
            break
        left -= sum(2 * sizes[names[i]] for i in over)
        open_ = [i for i in open_ if i not in over]
    for s in names:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 500


def test_media(spark, folder, tables):
    for r in rows_of(spark, folder, "op4_iso_media"):
        raw = (next(t for i, t, *_ in tables[0] if i == r.doc_id) or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def test_embeddings_and_pages(spark, folder):
    rows = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows_of(spark, folder, "op5_lattice_hashing")}
    assert rows[3] == (1, 3, True) and rows[7] == (1, 3, False) and all(v == (0, k, True) for k, v in rows.items() if k not in (3, 7))
    pages = {r.page_id: (r.text, r.n_chars) for r in rows_of(spark, folder, "op6_line_blocks")}
    story = ("The story goes on for a while. " * 5).strip() + "\n" + ("It ends well after all that. " * 5).strip()
    assert pages == {0: (story, len(story)), 1: ("", 0), 2: ("", 0)}


@pytest.mark.parametrize(("name", "by", "out", "label", "cut"), [("op7_toxicity_crf", 3, 1, 2, 0.7), ("op8_quality_classifier", 5, 0, 1, 0.3)])
def test_scores(spark, folder, tables, name, by, out, label, cut):
    rows, truth = rows_of(spark, folder, name), {r[0]: r[label] for r in tables[1]}
    assert len(rows) == len(tables[0])
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % by == out) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
    held = [r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean(held) >= 0.9
    texts = {d[0]: d[1] for d in tables[0]}
    assert len({(texts[r.doc_id], r.score) for r in rows}) == len({texts[r.doc_id] for r in rows})


def test_simhash_query(spark, folder, tables):
    rows = {r.doc_id: r for r in rows_of(spark, folder, "op9_simhash_golay")}
    prints = {i: int(r.fingerprint, 16) for i, r in rows.items()}
    root = {i: i for i in prints}
    for _ in prints:
        new = {i: min(root[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 2) for i in prints}
        if new == root:
            break
        root = new
    assert {i: r.component_id for i, r in rows.items()} == root and prints[203] == prints[204] == 0


def test_bpe_query(spark, folder, tables):
    library = Tokenizer.from_file(queries.word_bpe())
    for r in rows_of(spark, folder, "op10_bpe_forced_boundary"):
        ids = library.encode(next(t for i, t, *_ in tables[0] if i == r.doc_id) or "", add_special_tokens=False).ids
        raw = np.array(ids, dtype="<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_stages(spark, folder, tables):
    """Each stage keeps the columns, and the whole chain ends in the tokens of what is left."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["quality classifier"](spark, docs.withColumn("quality_score", docs.doc_id), folder)
    assert kept.columns == [*docs.columns, "quality_score"] and all(r.quality_score == r.doc_id for r in kept.collect())
    junk = {r[0] for r in tables[1] if not r[1]}
    ids = {r.doc_id for r in kept.collect()}
    assert len(ids & junk) <= 2 and len(ids) >= 125 and 203 not in ids
    once = {r.doc_id for r in stage["SimHash near-dedup"](spark, docs, folder).collect()}
    assert once == jaccard_roots([(d[0], d[1]) for d in tables[0]])
    removed = stage["substring dedup"](spark, docs, folder)
    assert removed.columns == docs.columns and removed.count() == docs.count()
    mixed = stage["mixing sources to target weights"](spark, docs, folder)
    assert mixed.columns == docs.columns
    sizes = Counter({d[0]: len(split(d[1])) for d in tables[0]})
    got = Counter()
    for r in mixed.collect():
        got[r.doc_id] += len(split(r.text))
    assert all(got[i] <= 2 * sizes[i] for i in got) and abs(sum(got.values()) - 1.5 * sum(sizes.values())) <= 1
    none = docs.limit(0)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, none, folder).count() == 0, name
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "source", "n_tokens", "ids", "decoded"] and out.count() > 100
