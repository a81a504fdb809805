"""Packing documents into sequences of a fixed length by bounded-space online best fit.

A document is its ids and one end id; only documents longer than a sequence are cut. What is shorter than a sequence is
dealt over tasks, a fixed number of sequences each, and comes to a packer longest first. The packer holds a fixed
number of open bins. A bitset has the bit of every amount of free space that some open bin has, so the tightest bin
for a piece is the lowest bit at or above its length; when too many are open, the fullest closes. Only lengths and
checksums are shuffled: ids stay where they were made, unless the sequences themselves are asked for.
"""

from __future__ import annotations

import itertools
import struct
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.llm._common import cut, worker_state, written
from panelkit.llm.bpe import SLICE, WHITE, ForcedBoundaryBpe

#: Tokens of a sequence, the id at a document's end, open bins of a packer, and the sequences that a task is dealt.
LENGTH, END_ID, OPEN_BINS, SEQUENCES_PER_TASK = 2048, 0, 4096, 4096
#: The character that stands for a pre-token's end; words that have it themselves are merged by the other way.
END = "\x01"
END_BYTE = END.encode()
#: Characters of words whose ids a worker keeps.
KEPT_CHARS = 12 << 20


def rank_table(coder: ForcedBoundaryBpe) -> tuple[dict[bytes, int], list[int]]:
    """The vocabulary as ranks of byte strings, in which END_BYTE ends a pre-token, and the id of each rank (-1: none).

    Strings with that byte inside are left out: no text that is merged by ranks has it.

    Ranked merges join any two neighbours that make a known string, a merge list only the two that it names. They are
    the same where each string is made by one merge only and is what its own bytes are encoded as: before a string is
    made, its bytes then never stand as two other parts. Strings that aren't so are left out; no text makes them.
    """
    byte_of = {c: bytes([b]) for b, c in coder.letters.items()}
    ranks, ids = {bytes([b]): b for b in range(256)}, [-1] * 512
    for c, b in byte_of.items():
        ranks[b + END_BYTE] = 256 + b[0]
        ids[b[0]], ids[256 + b[0]] = (-1, -1) if b == END_BYTE else (coder.inside[c], coder.ending[c])
    spelled = {ids[r]: b for b, r in ranks.items() if ids[r] >= 0}
    single = dict(spelled)
    for pair, rank in sorted(coder.rank.items(), key=lambda x: x[1]):
        # A pre-token with END inside never comes here, so a string of which it is an inner part isn't needed.
        if pair >> coder.bits not in spelled or (pair & ((1 << coder.bits) - 1)) not in spelled:
            continue
        made = spelled[pair >> coder.bits] + spelled[pair & ((1 << coder.bits) - 1)]
        if made in ranks:
            raise ValueError(f"two merges make {made!r}")
        spelled[coder.made[rank]], ranks[made] = made, len(ids)
        ids.append(coder.made[rank])
    for i, made in spelled.items():
        if i not in single:
            start = [coder.inside[coder.letters[b]] for b in made.removesuffix(END_BYTE)]
            if made.endswith(END_BYTE):
                start[-1] = coder.ending[coder.letters[made[-2]]]
            between = [coder.rank.get(a << coder.bits | b, coder.none) for a, b in zip(start, start[1:], strict=False)]
            if coder._merge(start, between) != [i]:
                del ranks[made]
    return ranks, ids


class WordIds:
    """Ids of whole texts as the tokenizer library has them, by words; the new words of a slice of texts are merged in one call."""

    def __init__(self, spec: str, ranks: dict[bytes, int], ids: list[int]) -> None:
        import tiktoken

        self.coder = ForcedBoundaryBpe(spec)
        self.merge = tiktoken.Encoding("words", pat_str=f"[^{END}]*{END}", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.ids = np.array(ids, dtype=np.int64)
        self.ends = np.zeros(len(ids), dtype=bool)
        self.ends[[r for t, r in ranks.items() if t.endswith(END_BYTE) and r != END_BYTE[0]]] = True
        self.known: dict[str, bytes] = {}
        self.chars = 0

    def add(self, words: list[str]) -> None:
        """Ids of new words. Those with END in them, or with characters that only the library's tables know, go one by one."""
        coder = self.coder
        letters = [w for w in words if w.isalpha() and w.isascii()]
        plain, said, sizes = letters, [w.lower() for w in letters], [1] * len(letters)
        for w in words:
            if w.isalpha() and w.isascii():
                continue
            if END in w or not (w.isascii() or w.isprintable()) and coder.unknown.search(w):
                self.known[w] = coder.word(w)
            else:
                plain.append(w)
                said += (x := coder.parts(w))
                sizes.append(len(x))
        self.chars += sum(map(len, words)) + 16 * len(words)
        if not plain:
            return
        ranks = np.array(self.merge(END.join(said) + END), dtype=np.int64)
        ids = self.ids[ranks]
        real = np.concatenate([[0], np.cumsum(ids >= 0)])
        after = np.concatenate([[0], np.flatnonzero(self.ends[ranks]) + 1])[np.cumsum([0, *sizes])]
        at, whole = (4 * real[after]).tolist(), ids[ids >= 0].astype("<u4").tobytes()
        self.known.update(zip(plain, [whole[i:j] for i, j in zip(at, at[1:], strict=False)], strict=True))

    def split(self, text: str) -> list[str]:
        return text.split() if not regex.search("[\x1c-\x1f]", text) else [w for w in WHITE.split(text) if w]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; special tokens' strings in a text have their ids."""
        if self.chars > KEPT_CHARS:
            self.known.clear()
            self.chars = 0
        coder, marked = self.coder, {}
        words = []
        for i, text in enumerate(texts):
            if text and any(c in text for c in coder.heads) and len(found := coder.marks.split(text)) > 1:
                marked[i] = [(p, [] if p in coder.special else self.split(p)) for p in found]
                words.append([w for _, x in marked[i] for w in x])
            else:
                words.append(self.split(text or ""))
        known = self.known
        if new := [w for w in dict.fromkeys(itertools.chain.from_iterable(words)) if w not in known]:
            self.add(new)
        out = [b"".join(map(known.__getitem__, x)) for x in words]
        for i, parts in marked.items():
            out[i] = b"".join(struct.pack("<I", coder.special[p]) if p in coder.special else b"".join(map(known.__getitem__, x)) for p, x in parts)
        return out


def _coder(shared) -> WordIds:
    return worker_state(("packing", shared.value[0]), lambda: WordIds(*shared.value[1:]))


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 (and ids): one row for each piece of each document, in its order."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((hash(spec), spec, *rank_table(ForcedBoundaryBpe(spec))))
    fields = [T.StructField("id", docs.schema[id_col].dataType)]
    fields += [T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()))]
    schema = T.StructType([*fields, *([T.StructField("ids", T.BinaryType())] if keep_ids else [])])
    end, most = struct.pack("<I", end_id), 4 * length

    def run(batches):
        coder = _coder(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                of, numbers, found = [], [], []
                for i, whole in enumerate(coder.encode(part.column(1).to_pylist())):
                    whole += end
                    for n, start in enumerate(range(0, len(whole), most)):
                        ids = whole[start : start + most]
                        of.append(i)
                        numbers.append((n, start // 4, len(ids) // 4, zlib.crc32(ids)))
                        if keep_ids:
                            found.append(ids)
                columns = [part.column(0).take(pa.array(of, pa.int64())), *(pa.array(c, t) for c, t in zip(zip(*numbers, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(found, pa.binary())] if keep_ids else [])], names=schema.names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


class BestFit:
    """Bins of one size, a fixed number of them open. ``place`` gives a piece's bin and its place there."""

    def __init__(self, size: int = LENGTH, open_bins: int = OPEN_BINS) -> None:
        self.size, self.open_bins, self.held, self.made = size, open_bins, 0, 0
        self.free = 0  # bit f: some open bin has f free
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, free: int) -> int:
        bins = self.bins[free]
        number = bins.pop()
        if not bins:
            self.free ^= 1 << free
        self.held -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        wide = self.free >> length
        if wide:
            free = length + (wide & -wide).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.size, self.made
            self.made += 1
        left = free - length
        if left:
            if self.held == self.open_bins:  # the fullest closes, be it this one
                fullest = (self.free & -self.free).bit_length() - 1
                if left <= fullest:
                    return number, self.size - free
                self._take(fullest)
            self.bins[left].append(number)
            self.free |= 1 << left
            self.held += 1
        return number, self.size - free


def packed(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, open_bins: int = OPEN_BINS, keep_ids: bool = False) -> DataFrame:
    """``id_col``, piece, start, length, ids_crc32, sequence_id, offset (and ids): the place of every piece.

    Null and empty texts are documents of the end id alone; repeated rows and null ids are documents of their own;
    other columns are not read. An empty table gives no rows. Pieces are dealt evenly by their row number, whatever
    their ids and texts, and lie in a stated order in a task, so a task that runs again gives the same places.
    """
    rows = pieces(docs, tokenizer_path, id_col, text_col, length, end_id, keep_ids)
    rows = (written(rows, "pieces") if keep_ids else cut(rows)).withColumn("row", F.monotonically_increasing_id())
    total = rows.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(1, -(-total // (length * SEQUENCES_PER_TASK)))
    dealt = rows.repartition(tasks, F.xxhash64("row")).sortWithinPartitions(F.desc("length"), "row")
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != "row"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at = rows.columns.index("length")

    def pack(batches):
        bins, first = BestFit(length, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            places = [bins.place(n) for n in batch.column(at).to_pylist()]
            columns = [pa.array([first + b for b, _ in places], pa.int64()), pa.array([o for _, o in places], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=schema.names)

    return dealt.mapInArrow(pack, schema).withColumnRenamed("id", id_col)


def sequences(places: DataFrame) -> DataFrame:
    """sequence_id, n_pieces, n_tokens and ids of each sequence, from ``packed(..., keep_ids=True)``; no more than a sequence's tokens meet."""
    held = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate("held", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return places.groupBy("sequence_id").agg(held.alias("held"), F.sum("length").alias("n_tokens")).select("sequence_id", F.size("held").cast("long").alias("n_pieces"), "n_tokens", whole.alias("ids"))
