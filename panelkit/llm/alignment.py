"""Alignment of two tokenizers over a corpus: groups between common borders, and links of overlapping tokens.

A text is cut before each blank that follows other than white space. No token of either vocabulary stands across
such a cut, so the fragments are encoded and aligned once for each worker that meets them. The pairs that a document
links are counted by spilling: a task radix-partitions its (pair, document, uses) records by side A's id into
zstd-compressed sorted runs, kept in the shared folder. A k-way heap merge of a radix partition's runs counts the
documents of each pair; the counts lie side-major, so each A id's maximum is found in one pass. The runs are then
streamed once more against the counts, and every document gets its contributions back.

Nothing grows with the corpus in one place: a run has a bounded number of links, a merge a bounded number of runs,
and the counts of one radix partition at most (A ids / RADIX) x (B ids) pairs, whatever the corpus.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import operator
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.llm._common import shared_dir, worker_state, written

#: Radix partitions; links and documents of a run; runs of one merge and of one pass back; pairs of a block of counts.
RADIX, LINKS_PER_RUN, DOCS_PER_RUN, MERGED_RUNS, STREAMED_RUNS, PAIRS_PER_BLOCK = 256, 1 << 22, 1 << 16, 128, 1024, 1 << 16
#: Characters of text of a slice, and of fragments that a worker keeps.
SLICE_CHARS, KEPT_CHARS = 1 << 20, 3 << 20
BLANK = "▁"
#: Cuts of a text that has other white space than single blanks inside.
CUTS, UNEVEN = re.compile(r"(?<=\S)(?= )"), re.compile(r"\s\s|[^\S ]|\s\Z|\A\s")


class Vocabularies:
    """Both tokenizers, with the bytes of each of their tokens."""

    def __init__(self, ranks: bytes, pattern: str, model: bytes) -> None:
        import sentencepiece
        import tiktoken

        table = {base64.b64decode(t): int(i) for t, i in map(bytes.split, ranks.splitlines()) if t}
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.a_bytes = [b""] * (max(table.values()) + 1)
        for t, i in table.items():
            self.a_bytes[i] = t
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        #: Whether B may be cut before blanks: no piece goes on with a blank, and the text is taken as it is.
        probe = " a  b Ａ c  "
        self.cuttable = not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in pieces) and self.spelled(self.b.encode(probe)) == f" {probe}".encode()
        self.lone = self.b.piece_to_id(BLANK)

    def spelled(self, ids: list[int]) -> bytes:
        return b"".join(map(self.b_bytes.__getitem__, ids))

    def fragments(self, text: str) -> list[str]:
        """The text's fragments, each without the blank that it starts with."""
        if not self.cuttable:
            return [text]
        if UNEVEN.search(text) is None:
            return text.split(" ")
        return [f[1:] for f in CUTS.split(f" {text}")]

    def encode_b(self, fragments: list[str]) -> list[list[int]]:
        found = self.b.encode(fragments, num_threads=1)
        return [ids or [self.lone] for ids in found] if "" in fragments else found


class Aligner:
    """Fragments met lately, aligned: counts, the pairs that they link, and their groups as text."""

    def __init__(self, vocabularies: Vocabularies) -> None:
        self.v = v = vocabularies
        self.a_len, self.b_len = (np.array([len(t) for t in x], dtype=np.int64) for x in (v.a_bytes, v.b_bytes))
        self.b_bits = max(1, (len(v.b_bytes) - 1).bit_length())
        self.high_bits = max(1, ((len(v.a_bytes) - 1) // RADIX).bit_length())
        a, b = ([str(i) for i in range(len(x))] for x in (v.a_bytes, v.b_bytes))
        self.written = [mark + i for mark, ids in ((";", a), (",", a), ("|", b), (",", b)) for i in ids]
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.texts: list[str] = []
        self.numbers = np.zeros((0, 4), dtype=np.int64)  # A tokens, B tokens, groups, and whether bytes differ
        self.ends = np.zeros(1, dtype=np.int64)
        self.pairs = np.zeros(0, dtype=np.int64)
        self.chars = 0

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """One number for a pair, A's radix first, then the rest of A's id, then B's: a radix partition is side-major."""
        return ((a % RADIX) << self.high_bits | a // RADIX) << self.b_bits | b

    def add(self, fragments: list[str]) -> None:
        """Aligns new fragments, all in one go over their joined bytes."""
        v = self.v
        a_ids, b_ids = [v.a.encode_ordinary(f" {f}") for f in fragments], v.encode_b(fragments)
        bad = np.zeros(len(fragments), dtype=np.int64)
        for i, (f, x, y) in enumerate(zip(fragments, a_ids, b_ids, strict=True)):
            whole = f" {f}".encode()
            if v.spelled(y) != whole or b"".join(map(v.a_bytes.__getitem__, x)) != whole:
                bad[i], a_ids[i], b_ids[i] = 1, [], []
        n_a, n_b = (np.array([len(x) for x in ids], dtype=np.int64) for ids in (a_ids, b_ids))
        a, b = (np.fromiter(itertools.chain.from_iterable(ids), dtype=np.int64, count=int(n.sum())) for ids, n in ((a_ids, n_a), (b_ids, n_b)))
        a_at, b_at = (np.cumsum(length[ids]) - length[ids] for ids, length in ((a, self.a_len), (b, self.b_len)))
        total = int(self.a_len[a].sum())
        marks = np.zeros(total, dtype=np.int8)
        marks[a_at] = 1
        marks[b_at] += 2
        # A link is the bytes between one start, of either side, and the next.
        at = np.flatnonzero(marks)
        marks = marks[at]
        group = np.cumsum(marks == 3)
        starts_a, starts_b = np.flatnonzero(marks & 1), np.flatnonzero(marks & 2)
        pairs = self.pair(a[np.cumsum(marks & 1) - 1], b[np.cumsum(marks >> 1) - 1])
        of_a, of_b = group[starts_a], group[starts_b]
        codes = np.empty(len(a) + len(b), dtype=np.int64)
        size_a, size_b = len(v.a_bytes), len(v.b_bytes)
        codes[np.arange(len(a)) + np.searchsorted(of_b, of_a)] = a + np.where(marks[starts_a] == 3, 0, size_a)
        codes[np.arange(len(b)) + np.searchsorted(of_a, of_b, side="right")] = b + 2 * size_a + np.where(marks[starts_b] == 3, 0, size_b)
        said = list(map(self.written.__getitem__, codes.tolist()))
        cut = [0, *np.cumsum(n_a + n_b).tolist()]
        ends = np.searchsorted(at, np.cumsum([0, *(int(self.a_len[np.array(x, dtype=np.int64)].sum()) for x in a_ids)]))
        groups = np.diff(np.concatenate([[0], group])[ends])
        for i, f in enumerate(fragments):
            self.place[f] = len(self.texts)
            self.texts.append("".join(said[cut[i] : cut[i + 1]]))
        self.numbers = np.concatenate([self.numbers, np.stack([n_a, n_b, groups, bad], axis=1)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + ends[1:]])
        self.pairs = np.concatenate([self.pairs, pairs])
        self.chars += sum(map(len, fragments)) + 16 * len(fragments)

    def slice(self, texts: list[str | None]) -> tuple[np.ndarray, list[bytes | None], np.ndarray, np.ndarray]:
        """For each text: numbers of A tokens, B tokens, groups and links, and the digest of its groups; then all links' pairs, with the text of each."""
        if self.chars > KEPT_CHARS:
            self.clear()
        cut = [self.v.fragments(t) if t else [] for t in texts]
        if new := [f for f in dict.fromkeys(itertools.chain.from_iterable(cut)) if f not in self.place]:
            self.add(new)
        sizes = np.array([len(x) for x in cut], dtype=np.int64)
        places = np.fromiter(map(self.place.__getitem__, itertools.chain.from_iterable(cut)), dtype=np.int64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(texts)), sizes)
        sums = np.zeros((len(texts), 4), dtype=np.int64)
        np.add.at(sums, owner, self.numbers[places])
        bad = sums[:, 3] > 0
        sums[bad] = 0
        good = ~bad[owner]
        places_of_links, owner = places[good], owner[good]
        lengths = self.ends[places_of_links + 1] - self.ends[places_of_links]
        at = np.arange(int(lengths.sum())) + np.repeat(self.ends[places_of_links] - np.cumsum(lengths) + lengths, lengths)
        links, of = self.pairs[at], np.repeat(owner, lengths)
        sums[:, 3] = np.bincount(of, minlength=len(texts))
        digests: list[bytes | None] = []
        ends = np.cumsum(sizes).tolist()
        for i, (n, end) in enumerate(zip(sizes.tolist(), ends, strict=True)):
            said = "" if bad[i] else "".join(map(self.texts.__getitem__, places[end - n : end].tolist()))[1:]
            digests.append(hashlib.sha256(said.encode()).digest() if said else None)
        return sums, digests, links, of


def packed(*arrays: np.ndarray) -> bytes:
    """Unsigned 32-bit arrays of one length, zstd-compressed."""
    return zstandard.compress(b"".join(np.ascontiguousarray(x, dtype="<u4").tobytes() for x in arrays), 3)


def unpacked(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), dtype="<u4").reshape(n, -1).astype(np.int64)


def spilled(links: np.ndarray, docs: np.ndarray, bits: int) -> list[tuple[int, bytes, bytes]]:
    """A run: for each radix partition its pairs in order with their numbers of documents, and for each of these the document and its uses."""
    doc_bits = max(1, int(docs.max(initial=0)).bit_length())
    records, uses = np.unique(links << doc_bits | docs, return_counts=True)
    pairs, docs = records >> doc_bits, records & ((1 << doc_bits) - 1)
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    heads, counts = pairs[first], np.diff(first, append=len(pairs))
    out = []
    borders = np.searchsorted(heads, np.arange(RADIX + 1) << bits)
    for r in np.flatnonzero(np.diff(borders)).tolist():
        i, j = borders[r], borders[r + 1]
        x, y = first[i], first[j] if j < len(first) else len(pairs)
        steps = np.diff(docs[x:y], prepend=0)
        out.append((r, packed(np.diff(heads[i:j] - (r << bits), prepend=0), counts[i:j]), packed(steps.astype(np.int64) & 0xFFFFFFFF, uses[x:y])))
    return out


def heads_of(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, counts = unpacked(blob, 2)
    return np.cumsum(steps), counts


def merged(runs: list[bytes]):
    """Pairs in order with their numbers of documents, by a heap over all runs of a radix partition."""
    streams = [zip(*(x.tolist() for x in heads_of(r)), strict=True) for r in runs]
    for pair, same in itertools.groupby(heapq.merge(*streams), key=operator.itemgetter(0)):
        yield pair, sum(n for _, n in same)


def by_key(batches, keys: list[str]):
    """(key, rows) for each stretch of equal keys, rows coming one at a time as dicts; batches are sorted by the keys."""
    rows = (row for batch in batches for i in range(0, batch.num_rows, 64) for row in batch.slice(i, 64).to_pylist())
    return itertools.groupby(rows, key=operator.itemgetter(*keys))


def in_batches(rows, schema: pa.Schema, most: int):
    rows = iter(rows)
    while part := list(itertools.islice(rows, most)):
        yield pa.RecordBatch.from_pylist(part, schema=schema)


def _aligner(shared) -> Aligner:
    return Aligner(worker_state(("alignment", shared.value[0]), lambda: Vocabularies(*shared.value[1:])))


def runs_of(docs: DataFrame, shared, id_col: str, text_col: str, links_per_run: int) -> DataFrame:
    """Rows of two kinds: a document of a run (its number in it, counts, digest), or a radix partition of a run (its pairs and uses)."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField("run", T.LongType()), T.StructField("no", T.IntegerType()), T.StructField("id", kind)]
        + [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")]
        + [T.StructField("digest", T.BinaryType()), T.StructField("radix", T.IntegerType()), T.StructField("pairs", T.BinaryType()), T.StructField("uses", T.BinaryType())]
    )

    def spill(batches):
        aligner = _aligner(shared)
        task, number = TaskContext.get().partitionId(), 0
        ids, sums, digests, links, owners, held = [], [], [], [], [], 0

        def flush():
            nonlocal number, held
            n, run = len(digests), task << 24 | number
            if n:
                parts = np.concatenate(sums)
                columns = [pa.array([run] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.concat_arrays(ids), *(pa.array(parts[:, i]) for i in range(4)), pa.array(digests, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                for r, pairs, uses in spilled(np.concatenate(links), np.concatenate(owners), aligner.high_bits + aligner.b_bits):
                    row = [pa.array([run]), pa.nulls(1, pa.int32()), pa.nulls(1, ids[0].type), *(pa.nulls(1, pa.int64()) for _ in range(4)), pa.nulls(1, pa.binary()), pa.array([r], pa.int32()), pa.array([pairs], pa.binary()), pa.array([uses], pa.binary())]
                    yield pa.RecordBatch.from_arrays(row, names=schema.names)
            number, held = number + 1, 0
            for x in (ids, sums, digests, links, owners):
                x.clear()

        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, chars = at + 1, len(texts[at] or "")
                while end < len(texts) and (chars := chars + len(texts[end] or "")) <= SLICE_CHARS:
                    end += 1
                counts, found, pairs, of = aligner.slice(texts[at:end])
                if held and (held + len(pairs) > links_per_run or len(digests) + end - at > DOCS_PER_RUN):
                    yield from flush()
                of = of + len(digests)
                ids.append(batch.column(0).slice(at, end - at))
                sums.append(counts)
                digests.extend(found)
                links.append(pairs)
                owners.append(of)
                held += len(pairs)
                at = end
        yield from flush()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(spill, schema)


def pair_counts(runs: DataFrame, n_runs: int, merged_runs: int = MERGED_RUNS) -> DataFrame:
    """radix, pair (in it) and n, the number of documents that hold the pair linked."""
    groups = max(1, -(-n_runs // merged_runs))
    dealt = runs.select("radix", F.pmod(F.xxhash64("run"), F.lit(groups)).cast("int").alias("part"), "run", "pairs").repartition("radix", "part").sortWithinPartitions("radix", "part", "run")
    fields = pa.schema([("radix", pa.int32()), ("pair", pa.int64()), ("n", pa.int64())])

    def merge(batches):
        for (radix, _), rows in by_key(batches, ["radix", "part"]):
            yield from in_batches(({"radix": radix, "pair": p, "n": n} for p, n in merged([r["pairs"] for r in rows])), fields, 1 << 14)

    partial = dealt.mapInArrow(merge, "radix int, pair long, n long")
    return partial.repartition("radix").groupBy("radix", "pair").agg(F.sum("n").alias("n"))


def counted_blocks(counts: DataFrame, b_bits: int) -> DataFrame:
    """The counts in blocks, each with the first pair of it: pairs, n (two halves of 32 bits) and whether no pair of its A id has more."""
    side = F.call_function("shiftright", F.col("pair"), F.lit(b_bits))
    best = (F.col("n") == F.max("n").over(Window.partitionBy("radix", side))).cast("int").alias("best")
    ordered = counts.select("radix", "pair", "n", best).sortWithinPartitions("radix", "pair")
    fields = pa.schema([("radix", pa.int32()), ("start", pa.int64()), ("block", pa.binary())])

    def block(batches):
        held: list[pd.DataFrame] = []

        def flush():
            f = pd.concat(held)
            n = f["n"].to_numpy()
            yield pa.RecordBatch.from_pylist([{"radix": int(f["radix"].iloc[0]), "start": int(f["pair"].iloc[0]), "block": packed(f["pair"], n & 0xFFFFFFFF, n >> 32, f["best"])}], schema=fields)
            held.clear()

        for batch in batches:
            frame = batch.to_pandas()
            for radix, part in frame.groupby("radix", sort=True):
                if held and held[0]["radix"].iloc[0] != radix:
                    yield from flush()
                for i in range(0, len(part), PAIRS_PER_BLOCK):
                    held.append(part.iloc[i : i + PAIRS_PER_BLOCK])
                    if sum(map(len, held)) >= PAIRS_PER_BLOCK:
                        yield from flush()
        if held:
            yield from flush()

    return ordered.mapInArrow(block, "radix int, start long, block binary")


def contributions(runs: DataFrame, blocks: DataFrame, n_runs: int, streamed_runs: int = STREAMED_RUNS) -> DataFrame:
    """run and a block of (document, best links, sum of counts in two halves), for each run and radix partition."""
    groups = max(1, -(-n_runs // streamed_runs))
    tables = blocks.select("radix", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), F.lit(0).alias("kind"), F.col("start").alias("key"), F.col("block").alias("pairs"), F.lit(None).cast("binary").alias("uses"))
    streams = runs.select("radix", F.pmod(F.xxhash64("run"), F.lit(groups)).cast("int").alias("part"), F.lit(1).alias("kind"), F.col("run").alias("key"), "pairs", "uses")
    dealt = tables.unionByName(streams).repartition("radix", "part").sortWithinPartitions("radix", "part", "kind", "key")
    fields = pa.schema([("run", pa.int64()), ("found", pa.binary())])

    def back(batches):
        for _, rows in by_key(batches, ["radix", "part"]):
            tables, known = [], None
            for row in rows:
                if row["kind"] == 0:
                    tables.append(unpacked(row["pairs"], 4))
                    continue
                if known is None:
                    pairs, low, high, best = np.concatenate(tables, axis=1)
                    known, n, tables = pairs, high << 32 | low, []
                heads, counts = heads_of(row["pairs"])
                steps, uses = unpacked(row["uses"], 2)
                docs = np.cumsum(np.where(steps >= 1 << 31, steps - (1 << 32), steps))
                at = np.repeat(np.searchsorted(known, heads), counts)
                held, place = np.unique(docs, return_inverse=True)
                sums = np.zeros((2, len(held)), dtype=np.int64)
                np.add.at(sums[0], place, uses * best[at])
                np.add.at(sums[1], place, uses * n[at])
                yield pa.RecordBatch.from_pylist([{"run": row["key"], "found": packed(held, sums[0], sums[1] & 0xFFFFFFFF, sums[1] >> 32)}], schema=fields)

    return dealt.mapInArrow(back, "run long, found binary")


def align(docs: DataFrame, ranks_path: str, pattern: str, model_path: str, id_col: str = "doc_id", text_col: str = "text", links_per_run: int = LINKS_PER_RUN, merged_runs: int = MERGED_RUNS, streamed_runs: int = STREAMED_RUNS) -> DataFrame:
    """One row for each input row: ``id_col``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Tokenizer A is byte-level, given by its ranks and pattern, and takes the text after a blank; B is a piece model that
    puts the blank there itself. A null or empty text, and one whose tokens' bytes are not that blank and the text, has
    zeros and an empty digest. A pair counts once for each row that holds it linked, repeated rows and null ids
    included. Other columns are not read. An empty table gives no rows. The vocabularies, of fixed size, are
    broadcast; intermediate runs are written below ``spark.checkpoint.dir``.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    with open(ranks_path, "rb") as f, open(model_path, "rb") as g:
        files = (f.read(), pattern, g.read())
    shared = spark.sparkContext.broadcast((hash(files), *files))
    b_bits = Aligner(Vocabularies(*files)).b_bits
    rows = written(runs_of(docs, shared, id_col, text_col, links_per_run), "runs")
    runs, texts = rows.where("radix IS NOT NULL"), rows.where("radix IS NULL").drop("radix", "pairs", "uses")
    n_runs = texts.where("no = 0").count()
    blocks = counted_blocks(pair_counts(runs.select("radix", "run", "pairs"), n_runs, merged_runs), b_bits)
    found = contributions(runs, blocks, n_runs, streamed_runs)
    nothing = [F.lit(None).cast(texts.schema[c].dataType).alias(c) for c in texts.columns if c != "run"]
    both = texts.withColumn("found", F.lit(None).cast("binary")).unionByName(found.select("run", *nothing, "found"))
    dealt = both.select(*texts.columns, "found").repartition("run").sortWithinPartitions("run", F.col("no").asc_nulls_last())
    counts = ["n_a", "n_b", "n_groups", "n_links"]
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in (*counts, "n_best", "count_sum")), T.StructField("groups_sha256", T.StringType())])

    def sums(batches):
        ids, held, run, best, total = [], [], None, None, None

        def flush():
            if held:
                numbers = np.concatenate([x[0] for x in held])
                said = [d.hex() if d else "" for x in held for d in x[1]]
                columns = [pa.concat_arrays(ids), *(pa.array(numbers[:, i]) for i in range(4)), pa.array(best[: len(said)]), pa.array(total[: len(said)]), pa.array(said, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
            ids.clear()
            held.clear()

        for batch in batches:
            of = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if of[i] != run:
                    yield from flush()
                    run, best, total = of[i], np.zeros(DOCS_PER_RUN, dtype=np.int64), np.zeros(DOCS_PER_RUN, dtype=np.int64)
                part = batch.slice(i, j - i)
                n = len(part) - part.column(1).null_count
                if n:
                    ids.append(part.column(2).slice(0, n))
                    held.append((np.stack([part.column(3 + k).slice(0, n).to_numpy() for k in range(4)], axis=1), part.column(7).slice(0, n).to_pylist()))
                for blob in part.column(8).slice(n).to_pylist():
                    docs_, b, low, high = unpacked(blob, 4)
                    best[docs_] += b
                    total[docs_] += high << 32 | low
        yield from flush()

    return dealt.mapInArrow(sums, schema).select(F.col("id").alias(id_col), *counts, "n_best", "count_sum", "groups_sha256")
