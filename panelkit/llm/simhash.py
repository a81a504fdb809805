"""SimHash near-duplicates with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. If two fingerprints differ in at most
two bits, then for one of the ordered pairs (A, B), (B, C), (C, A) the first segment is equal and the
second differs in at most one bit. A segment is decoded to a codeword of the perfect (23, 12) Golay code.
Each fingerprint is stored under (equal segment, index of its own codeword) and looks up (equal segment,
index of every codeword that it or one of its one-bit neighbours decodes to), so no linked pair is missed;
pairs that meet are verified by their Hamming distance.

Texts that share four fifths of their shingles differ in ten bits on average, and keys that are complete for so many
would bring a fixed share of all pairs together. ``similar_texts`` therefore takes more keys from the same shingle
hashes, bands of minima, and verifies pairs that meet on the shingles themselves. A bucket of a key elects leaders and
compares its members with them: near copies of one text settle in the first round, and only members that are still
apart from the bucket's largest component lead in later ones, so no bucket's pairs are made at once; who has led goes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.llm._common import cut, fresh, longer_tasks, text_key, written
from panelkit.llm._graph import components

# Fixed value: the generator polynomial of the (23, 12) Golay code.
GENERATOR = 0b110001110101
SEGMENTS = ((0, 23), (23, 23), (46, 18))
_CHUNK = 1 << 16
#: Keys of a text from minima of its shingle hashes, and minima in each: a pair of similarity 0.8 meets in none with
#: probability (1 - 0.8 ** 4) ** 16 = 0.0002.
BANDS, BAND_ROWS = 16, 4
#: Leaders that a member meets as one list, and members that are verified together.
CHUNK = 256
#: Leaders that a bucket elects in its second round at most, and the factor from round to round. All members that stay apart lead in the end,
#: so fewer, larger rounds compare few pairs more, and a round is some twenty exchanges.
LEADERS = 64
#: Bytes of shingle hashes that a block's own texts have, about; and rows of a batch that are taken out of Arrow together.
BLOCK_BYTES, ROWS = 16 << 20, 64


def sliced(batches):
    """Short slices of Arrow batches, so that a worker holds few rows besides the batch itself."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _parity(info: np.ndarray) -> np.ndarray:
    """The 11 check bits of each 12-bit information word."""
    rest = info.astype(np.int64) << 11
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


class Golay:
    """Decoder to the nearest codeword, by syndrome; every 23-bit word lies within three bits of one codeword."""

    def __init__(self) -> None:
        self.parity = _parity(np.arange(4096))
        ones = [1 << i for i in range(23)]
        errors = [0, *ones]
        errors += [a | b for i, a in enumerate(ones) for b in ones[:i]]
        errors += [a | b | c for i, a in enumerate(ones) for j, b in enumerate(ones[:i]) for c in ones[:j]]
        errors = np.array(errors, dtype=np.int64)
        self.error = np.zeros(2048, dtype=np.int64)
        self.error[self.syndrome(errors)] = errors

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.parity[words >> 11] ^ (words & 2047)

    def index(self, words: np.ndarray) -> np.ndarray:
        return (words ^ self.error[self.syndrome(words)]) >> 11


_golay: list[Golay] = []


def golay() -> Golay:
    if not _golay:
        _golay.append(Golay())
    return _golay[0]


def fingerprint(text: str | None, shingle_words: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of a whole text; 0 for no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    k = min(shingle_words, len(words))
    total, counts = len(words) - k + 1, np.zeros(64, dtype=np.int64)
    digest, join = xxhash.xxh64_digest, b" ".join
    for at in range(0, total, _CHUNK):
        part = words[at : at + _CHUNK + k - 1]
        hashes = b"".join([digest(join(x), seed) for x in zip(*(part[i:] for i in range(k)), strict=False)])
        counts += np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text_col: str = "text", out_col: str = "fp", shingle_words: int = 3) -> DataFrame:
    """Adds the fingerprint as a signed 64-bit column."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle_words) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.withColumn(out_col, simhash(F.col(text_col)))


def shingle_hashes(text: str | None, shingle_words: int) -> np.ndarray:
    """The hashes of a text's shingles in order, repeats included; none for no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    k = min(shingle_words, len(words))
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.fromiter((digest(join(x), 42) for x in zip(*(words[i:] for i in range(k)), strict=False)), dtype=np.uint64)


def voted(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes, as ``fingerprint`` makes it."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def band_keys(hashes: np.ndarray) -> tuple[np.ndarray, int]:
    """One key for each band, and a sketch of one bit of each minimum; texts without shingles share all of them."""
    rng = np.random.default_rng(5)
    factors = rng.integers(0, 1 << 64, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)
    offsets = rng.integers(0, 1 << 64, BANDS * BAND_ROWS, dtype=np.uint64)
    minima = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    room = np.empty((1024, len(minima)), dtype=np.uint64)
    for at in range(0, len(hashes), len(room)):
        part = hashes[at : at + len(room), None]
        mixed = np.bitwise_xor(part, offsets, out=room[: len(part)])
        np.multiply(mixed, factors, out=mixed)
        np.minimum(minima, mixed.min(axis=0), out=minima)
    bits = int(np.packbits((minima >> np.uint64(20) & np.uint64(1)).astype(np.uint8)).view(np.int64)[0])
    rows = minima.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(rows)], dtype=np.uint64).view(np.int64), bits


def far_bits(similarity: float) -> int:
    """Sketches of texts of that similarity differ in (1 - similarity) / 2 of their bits on average; five deviations more."""
    p = (1 - similarity) / 2
    return min(64, int(64 * p + 5 * np.sqrt(64 * p * (1 - p))))


def similar(own: np.ndarray, others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Whether the Jaccard similarity of a sorted set and each of several others reaches ``similarity``; two empty sets are the same."""
    sizes = np.array([len(x) for x in others])
    if not len(own):
        return sizes == 0
    every = np.concatenate(others)
    at = np.minimum(np.searchsorted(own, every), len(own) - 1)
    shared = np.bincount(np.repeat(np.arange(len(others)), sizes), own[at] == every, len(others))
    return shared >= similarity * (len(own) + sizes - shared) - 1e-9


def _keys(values: np.ndarray, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the keys under which fingerprints are stored, or those that they look up."""
    code, words = golay(), values.view(np.uint64)
    parts = [(words >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    rows, keys = [], []
    for t in range(3):
        exact, near, width = parts[t], parts[(t + 1) % 3], SEGMENTS[(t + 1) % 3][1]
        near = near[:, None] ^ np.array([0, *(1 << i for i in range(width))] if probe else [0], dtype=np.int64)
        found = np.sort(code.index(near), axis=1)
        first = np.ones(found.shape, dtype=bool)
        first[:, 1:] = found[:, 1:] != found[:, :-1]
        row, col = np.nonzero(first)
        rows.append(row)
        keys.append((t << 35) | (exact[row] << 12) | found[row, col])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(fps: DataFrame, probe: bool) -> DataFrame:
    def run(batches):
        fresh("simhash")
        for pdf in batches:
            values = pdf["fp"].to_numpy(dtype=np.int64)
            for at in range(0, len(values), 4096):
                part = values[at : at + 4096]
                rows, keys = _keys(part, probe)
                yield pd.DataFrame({"key": keys, "fp": part[rows]})

    return longer_tasks(fps).mapInPandas(run, "key long, fp long")


def linked_fingerprints(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Distinct ``fp`` -> (a, b), a < b, of all pairs that differ in at most ``max_bits`` (two at most) bits."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the keys are complete for two differing bits at most")
    stored = _keyed(fps, False).withColumnRenamed("fp", "b")
    looked = _keyed(fps, True).withColumnRenamed("fp", "a")
    return looked.join(stored, "key").where(f"a < b AND bit_count(a ^ b) <= {max_bits}").select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 2, shingle_words: int = 3) -> DataFrame:
    """One row for each input row: ``id_col``, k1, k2 (the text's key), fp, component_id.

    Copies collapse to one fingerprint before anything is compared. component_id is the smallest id that is
    reachable over links; null where no id of the component is known. A null or empty text has fingerprint
    0 and is linked like any other; null ids and repeated rows are kept as they are; an empty table gives an
    empty table. Other columns are not read, so their names cannot clash.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = cut(with_fingerprint(rows, "text", "fp", shingle_words).select("id", *text_key(F.col("text")), "fp"))
    fps = cut(rows.groupBy("fp").agg(F.min("id").alias("id")))
    roots = components(linked_fingerprints(fps.select("fp"), max_bits))
    classes = fps.join(roots, fps.fp == roots.node, "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    least = classes.groupBy("root").agg(F.min("id").alias("component_id"))
    classes = cut(classes.join(least, "root").select("fp", "component_id"))
    return rows.join(classes, "fp").select(F.col("id").alias(id_col), "k1", "k2", "fp", "component_id")


def _asked(places: DataFrame, leaders: DataFrame, similarity: float) -> DataFrame:
    """(k, root, bucket, asks): for each text the leaders of its buckets that are in other components and not far, each once.

    ``places`` holds (bucket, k, bits, root), ``leaders`` (bucket, l, l_bits, l_root). Members meet lists of CHUNK leaders, so
    rows are not multiplied by leaders. ``bucket`` is the largest of the text's, so that texts which meet come together.
    """
    n = leaders.groupBy("bucket").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    lists = leaders.join(n, "bucket").groupBy("bucket", F.pmod(F.xxhash64("l"), "chunks").alias("chunk")).agg(F.collect_list(F.struct("l", "l_bits", "l_root")).alias("ls"))
    lists = lists.join(places.groupBy("bucket").agg(F.count("*").alias("n")), "bucket")
    near = F.filter("ls", lambda l: (l["l_root"] != F.col("root")) & (F.bit_count(F.col("bits").bitwiseXOR(l["l_bits"])) <= far_bits(similarity)))
    met = places.join(lists, "bucket").select("bucket", "n", "k", "root", F.transform(near, lambda l: l["l"]).alias("asks")).where(F.size("asks") > 0)
    return met.groupBy("k").agg(F.max(F.struct("n", "bucket"))["bucket"].alias("bucket"), F.min("root").alias("root"), F.array_distinct(F.flatten(F.collect_list("asks"))).alias("asks"))


def _verified(asked: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that connect texts with the leaders they ask for; ``sets`` holds (k, hashes).

    Texts of a bucket are dealt into blocks of about CHUNK; each of them, and each leader that one of them asks for, goes to
    the block once. All pairs asked for are verified; a leader gives one link for each component that it is similar to.
    """

    def run(batches):
        fresh("simhash")
        block, held, asks, roots = None, {}, {}, {}

        def close():
            out, by = [], {}
            for k, leaders in asks.items():
                for a in leaders:
                    by.setdefault(a, []).append(k)
            for a, members in by.items():
                found = similar(held[a], [held[k] for k in members], similarity)
                linked = {roots[k]: k for k, yes in zip(members, found, strict=True) if yes}
                out += [(a, k) for k in linked.values()]
            return out

        def linked(found):
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(2)], names=["a", "b"])

        for part in sliced(batches):
            done = []
            for to, k, root, leaders, data in zip(*(part.column(c).to_pylist() for c in ("block", "k", "root", "asks", "hashes")), strict=True):
                if to != block:
                    done += close()
                    block, held, asks, roots = to, {}, {}, {}
                held[k] = np.frombuffer(data, dtype=np.uint64)
                if leaders is not None:
                    asks[k], roots[k] = leaders, root
            if done:
                yield linked(done)
        yield linked(close())

    rows = written(asked.join(sets.select("k", "size"), "k"), "asked")
    # Texts of a block and their hashes are both bounded.
    most = F.greatest(F.count("*") / CHUNK, 8 * F.sum("size") / BLOCK_BYTES)
    sizes = rows.groupBy("bucket").agg(F.ceil(most).alias("chunks"))
    rows = rows.join(sizes, "bucket").select(F.xxhash64("bucket", F.pmod(F.xxhash64("k"), "chunks")).alias("block"), "k", "root", "asks")
    leaders = rows.groupBy("block").agg(F.array_distinct(F.flatten(F.collect_list("asks"))).alias("asks")).select("block", F.explode("asks").alias("k"))
    leaders = leaders.join(rows.select("block", "k"), ["block", "k"], "left_anti").select("block", "k", F.lit(None).cast("long").alias("root"), F.lit(None).cast("array<long>").alias("asks"))
    found = rows.unionByName(leaders).join(sets.select("k", "hashes"), "k").repartition("block").sortWithinPartitions("block")
    return longer_tasks(found).mapInArrow(run, "a long, b long")


def linked_texts(places: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(node, root) of the components of similar texts that share a bucket.

    ``places`` holds (bucket, k, bits), a row for every bucket of a text. Each round a bucket's leaders are compared with
    all its members of other components that have not led before; a member that has led is compared with all others and
    goes. A bucket goes when those that have not led are one component: then any two of its texts in different components
    have been compared. That stays true however components grow, so no bucket comes back.
    """
    places = places.withColumn("root", F.col("k"))
    leaders = places.groupBy("bucket").agg(F.min("k").alias("l"), F.min_by("bits", "k").alias("l_bits")).withColumn("l_root", F.col("l"))
    edges, width = cut(_verified(_asked(places, leaders, similarity), sets, similarity)), LEADERS
    while True:
        roots = components(edges)
        rest = places.drop("root").join(leaders.select("bucket", F.col("l").alias("k")), ["bucket", "k"], "left_anti")
        state = rest.join(roots, F.col("k") == F.col("node"), "left").select("bucket", "k", "bits", F.coalesce("root", "k").alias("root"))
        counts = state.groupBy("bucket", "root").agg(F.count("*").alias("n"))
        split = counts.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").drop("roots")
        apart = written(state.join(split, "bucket"), "apart")
        minor = apart.where("root <> main")
        leaders = minor.groupBy("bucket", F.pmod(F.xxhash64("k"), F.lit(width)).alias("way")).agg(F.min("k").alias("l"), F.min_by("bits", "k").alias("l_bits"), F.min_by("root", "k").alias("l_root"))
        leaders = written(leaders.drop("way"), "leaders")
        if leaders.isEmpty():
            return roots
        places = apart.drop("main")
        new = _verified(_asked(places, leaders, similarity), sets, similarity)
        edges = cut(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).union(new))
        width *= LEADERS


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, max_bits: int = 2, shingle_words: int = 5) -> DataFrame:
    """Like ``near_duplicates``, with links between texts whose sets of shingles have that Jaccard similarity or more.

    Texts meet under the keys of their bands or by fingerprints within ``max_bits``; pairs are verified. Texts without
    words share all keys and are linked; null counts as the empty text; null ids and repeated rows are kept.
    """

    def sketch(batches):
        fresh("simhash")
        for part in sliced(batches):
            fps, keys, bits = [], [], []
            for t in part.column(3).to_pylist():
                found = shingle_hashes(t, shingle_words)
                fps.append(voted(found))
                own, sketched = band_keys(np.unique(found))
                keys.append(own)
                bits.append(sketched)
            columns = [pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.int64())]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *columns], names=["id", "k1", "k2", "fp", "keys", "bits"])

    def hashes(batches):
        fresh("simhash")
        for part in sliced(batches):
            found = [np.unique(shingle_hashes(t, shingle_words)) for t in part.column(1).to_pylist()]
            columns = [pa.array([x.tobytes() for x in found], pa.binary()), pa.array(list(map(len, found)), pa.int64())]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["k", "hashes", "size"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), *text_key(text))
    kind = docs.select(F.col(id_col).alias("id")).schema.add("k1", "long").add("k2", "long").add("fp", "long").add("keys", T.ArrayType(T.LongType())).add("bits", "long")
    ids = cut(rows.select("id", "k1", "k2", "text").mapInArrow(sketch, kind))
    once = ids.groupBy("k1", "k2").agg(*[F.first(c).alias(c) for c in ("fp", "keys", "bits")])
    texts = written(once.withColumn("k", F.monotonically_increasing_id()), "sketches")
    classes = written(components(linked_fingerprints(texts.select("fp").distinct(), max_bits)).select(F.col("node").alias("fp"), "root"), "classes")
    all_ = texts.join(classes, "fp", "left").select("k", "bits", F.posexplode(F.array_append("keys", F.coalesce("root", "fp"))).alias("at", "key"))
    all_ = all_.select("k", "bits", F.xxhash64("at", "key").alias("bucket"))
    shared = all_.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    places = written(all_.join(shared, "bucket"), "places")
    meeting = written(texts.join(places.select("k").distinct(), "k", "left_semi").select("k", "k1", "k2"), "meeting")
    known = rows.select("k1", "k2", "text").join(meeting.hint("merge"), ["k1", "k2"]).groupBy("k").agg(F.first("text").alias("text"))
    sets = written(longer_tasks(known).select("k", "text").mapInArrow(hashes, "k long, hashes binary, size long"), "shingles")
    roots = linked_texts(places, sets, similarity)
    groups = texts.join(roots, F.col("k") == F.col("node"), "left").select("k1", "k2", F.coalesce("root", "k").alias("group"))
    members = ids.select("id", "k1", "k2").join(groups, ["k1", "k2"])
    least = members.groupBy("group").agg(F.min("id").alias("component_id"))
    return members.join(least, "group").select(F.col("id").alias(id_col), "k1", "k2", F.col("group").cast("string").alias("fp"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, **options) -> DataFrame:
    """The input's columns with one row of each component: the smallest id, repeated rows taken once.

    Links are those of ``near_duplicates``, or those of ``similar_texts`` where a similarity is given.
    """
    found = near_duplicates(docs, id_col, text_col, **options) if similarity is None else similar_texts(docs, id_col, text_col, similarity, **options)
    found = found.withColumn("group", F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp "), "fp")))
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "k1", "k2")
    same = found.groupBy("group", order.alias("w")).agg(F.count("*").alias("n"))
    won = same.groupBy("group").agg(F.min(F.struct("w", "n")).alias("b"))
    won = written(won.select(F.col("b.w.none").alias("g_none"), F.xxhash64("b.w.id").alias("g_id"), F.col("b.w.k1").alias("g_k1"), F.col("b.w.k2").alias("g_k2"), (F.col("b.n") > 1).alias("again")), "winners")
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    at, text = inner[names.index(id_col)], inner[names.index(text_col)]
    k1, k2 = text_key(F.col(text).cast("string"))
    place = ["g_none", "g_id", "g_k1", "g_k2"]
    rows = docs.toDF(*inner).select("*", F.col(at).isNull().alias("g_none"), F.xxhash64(at).alias("g_id"), k1.alias("g_k1"), k2.alias("g_k2")).join(won.hint("merge"), place)
    repeated = rows.where("again").groupBy(*place, at).agg(F.first(F.struct(*inner)).alias("row")).select("row.*")
    return rows.where("NOT again").select(*inner).union(repeated).toDF(*names)
