"""BPE encoding and decoding with forced-boundary splitting.

A pair of neighbouring bytes that stands inside no token of the vocabulary can be joined by no merge, so it
marks a certain cut. A pre-token is cut at all such pairs, the fragments are encoded independently, and
their ids are concatenated. Results equal those of the tokenizer library for vocabularies of this kind:
byte-level alphabet, NFC, lower case, white space dropped, an end-of-word suffix.

Words with characters that Python's Unicode tables do not know are put in normal form and split by the tokenizer
library's own normalizer and splitter, whose tables are newer; merges are ours there as well.
"""

from __future__ import annotations

import heapq
import json
import re
import string
import struct
import sys
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.llm._common import worker_state


#: Words and pre-tokens whose ids a Python worker keeps.
CACHED_WORDS, CACHED_PIECES = 160_000, 60_000
#: Rows whose ids and texts a Python worker holds at a time.
SLICE = 256
#: From this many symbols on, merges are taken from a heap.
LONG = 32

# The white space that the tokenizer's pattern engine knows.
WHITE = regex.compile("[\t-\r \x85\xa0  -     　]+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def unknown_characters() -> re.Pattern:
    """The code points without a category in Python's Unicode tables."""
    ranges, last = [], None
    for c in range(128, sys.maxunicode + 1):
        if unicodedata.category(chr(c)) == "Cn":
            if last is None or c != last + 1:
                ranges.append([c, c])
            ranges[-1][1] = last = c
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]")


class Recent:
    """The results of about ``size`` keys: two generations, so that filling up drops only what was not used lately."""

    def __init__(self, size: int) -> None:
        self.size, self.new, self.old = size // 2, {}, {}

    def find(self, key: str) -> bytes | None:
        """A result of the older generation, moved into the newer; callers look into ``new`` themselves."""
        known = self.old.get(key)
        if known is not None:
            self.keep(key, known)
        return known

    def keep(self, key: str, value: bytes) -> None:
        if len(self.new) >= self.size:
            self.old = dict(self.new)
            self.new.clear()
        self.new[key] = value


class Spelled(dict):
    """The letters of the byte alphabet that stand for a character, made when it is first met."""

    def __init__(self, letters: dict[int, str]) -> None:
        self.letters = letters

    def __missing__(self, char: str) -> str:
        self[char] = out = "".join(self.letters[b] for b in char.encode("utf-8", "surrogatepass"))
        return out


class ForcedBoundaryBpe:
    def __init__(self, tokenizer_json: str) -> None:
        spec = json.loads(tokenizer_json)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.letters = dict(enumerate(byte_alphabet()))
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.heads = {t[0] for t in self.special}
        #: Ids of a byte's letter inside a pre-token and at its end; -1 where the vocabulary has none.
        self.inside = {c: vocab.get(c, -1) for c in self.letters.values()}
        self.ending = {c: vocab.get(c + suffix, -1) for c in self.letters.values()}
        #: Ranks of pairs of ids, and the id that the merge of each rank makes.
        self.bits = max(self.token).bit_length()
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for i, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.rank[vocab[left] << self.bits | vocab[right]] = i
            self.made.append(vocab[left + right])
        self.none = len(self.made)
        #: The same ranks, by the id of the left side, then of the right side; the last entry stays empty, for ids that are missing (-1).
        self.after: list[dict[int, int]] = [{}] * (max(self.token) + 2)
        for pair, i in self.rank.items():
            left = pair >> self.bits
            self.after[left] = self.after[left] or {}
            self.after[left][pair & (1 << self.bits) - 1] = i
        #: Pairs of letters that occur inside a token, with their ranks; every other pair is a certain cut.
        self.inner: dict[tuple[str, str], int] = {}
        for t in vocab:
            t = t.removesuffix(suffix) if suffix else t
            for a, b in zip(t, t[1:], strict=False):
                if (a, b) not in self.inner:
                    self.inner[a, b] = self.rank.get(self.inside.get(a, -1) << self.bits | self.inside.get(b, -1), self.none)
        self.words, self.pieces = Recent(CACHED_WORDS), Recent(CACHED_PIECES)
        self.unknown, self.library, self.spec = unknown_characters(), None, tokenizer_json
        #: Characters met so far that Python's tables know, and the spelling of characters.
        self.met: set[str] = set()
        self.spelled = Spelled(self.letters)
        self.packs = [struct.Struct(f"<{n}I").pack for n in range(LONG)]

    def cut(self, piece: str) -> list[str]:
        """The fragments of a pre-token (in the byte alphabet) between its forced boundaries."""
        ranks = list(map(self.inner.get, zip(piece, piece[1:], strict=False)))
        at = [i for i, r in enumerate(ranks, 1) if r is None]
        return [piece[a:b] for a, b in zip([0, *at], [*at, len(piece)], strict=True)]

    def piece(self, text: str) -> bytes:
        """Ids of a pre-token: its fragments are encoded on their own and concatenated."""
        known = self.pieces.find(text)
        if known is not None:
            return known
        chars = text if text.isascii() and text.isprintable() else "".join(map(self.spelled.__getitem__, text))
        out = self.fragments(chars)
        if len(text) < LONG:
            self.pieces.keep(text, out)
        return out

    def fragments(self, chars: str) -> bytes:
        """Ids of a pre-token in the byte alphabet."""
        ids = list(map(self.inside.__getitem__, chars))
        ids[-1] = self.ending[chars[-1]]
        ranks = list(map(self.inner.get, zip(chars, chars[1:])))
        if len(ranks) and ranks[-1] is not None:
            ranks[-1] = self.rank.get(ids[-2] << self.bits | ids[-1], self.none)
        if None in ranks:
            whole, start = ids, 0
            ids = []
            for i in [i for i, r in enumerate(ranks) if r is None] + [len(ranks)]:
                ids += self._merge(whole[start : i + 1], ranks[start:i])
                start = i + 1
        else:
            ids = self._merge(ids, ranks)
        if -1 in ids:
            ids = [i for i in ids if i >= 0]
        return self.packs[len(ids)](*ids) if len(ids) < LONG else struct.pack(f"<{len(ids)}I", *ids)

    def _merge(self, ids: list[int], ranks: list[int]) -> list[int]:
        """Merges a fragment's ids, lowest rank first and leftmost of equals; ranks[i] is that of ids i and i + 1."""
        if len(ids) >= LONG:
            return self._merge_long(ids, ranks)
        after, none, made, left = self.after, self.none, self.made, len(ranks)
        while left:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i] = both = made[best]
            del ids[i + 1], ranks[i]
            left -= 1
            if i:
                ranks[i - 1] = after[ids[i - 1]].get(both, none)
            if i < left:
                ranks[i] = after[both].get(ids[i + 1], none)
        return ids

    def _merge_long(self, ids: list[int], ranks: list[int]) -> list[int]:
        """The same merges in n log n: a heap of (rank, place) over a linked list."""
        n, get, none, bits = len(ids), self.rank.get, self.none, self.bits
        following, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(r, i) for i, r in enumerate(ranks) if r != none]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = following[i] if alive[i] else -1
            if j < 0 or get(ids[i] << bits | ids[j]) != r:
                continue
            ids[i] = self.made[r]
            alive[j] = False
            following[i] = k = following[j]
            if k >= 0:
                before[k] = i
                if (r := get(ids[i] << bits | ids[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (k := before[i]) >= 0 and (r := get(ids[k] << bits | ids[i])) is not None:
                heapq.heappush(heap, (r, k))
        return [s for s, a in zip(ids, alive, strict=True) if a]

    def word(self, raw: str) -> bytes:
        """Ids, little-endian, of a run without white space."""
        known = self.words.find(raw)
        if known is not None:
            return known
        if not raw.isascii() and not self.met.issuperset(raw):
            if self.unknown.search(raw):
                return self.foreign(raw)
            self.met.update(raw)
        get, piece = self.pieces.new.get, self.piece
        out = b"".join([x if (x := get(p)) is not None else piece(p) for p in self.parts(raw)])
        if len(raw) < LONG:
            self.words.keep(raw, out)
        return out

    def parts(self, raw: str) -> list[str]:
        """The pre-tokens of a word, in normal form and lower case; for characters that Python's tables know."""
        text = raw if raw.isascii() else unicodedata.normalize("NFC", raw)
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        body = text.rstrip(string.punctuation)
        if body.isalpha():
            return [body, text[len(body) :]] if len(body) < len(text) else [text]
        return self.pattern.findall(text)

    def foreign_parts(self, raw: str) -> list[str]:
        """Pre-tokens, in the byte alphabet, of a word with characters that only the library's tables know."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.spec)
        text = self.library.normalizer.normalize_str(raw)
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def foreign(self, raw: str) -> bytes:
        """``word`` for characters that only the library's tables know."""
        return b"".join(map(self.fragments, self.foreign_parts(raw)))

    def _plain(self, text: str) -> list[bytes]:
        words = text.split() if not any(c in text for c in "\x1c\x1d\x1e\x1f") else [w for w in WHITE.split(text) if w]
        get, word = self.words.new.get, self.word
        return [x if (x := get(w)) is not None else word(w) for w in words]

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not any(c in text for c in self.heads):
            return b"".join(self._plain(text))
        out: list[bytes] = []
        for part in self.marks.split(text):
            if part in self.special:
                out.append(struct.pack("<I", self.special[part]))
            elif part:
                out += self._plain(part)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Tokens joined by one space, as a tokenizer without a decoder does; ids that are no token, and a broken last one, are passed over."""
        numbers = np.frombuffer(ids, dtype="<u4", count=len(ids) // 4).tolist()
        try:
            return " ".join(map(self.token.__getitem__, numbers))
        except KeyError:
            return " ".join(self.token[i] for i in numbers if i in self.token)


def _coder(shared) -> ForcedBoundaryBpe:
    return worker_state(("bpe", shared.value[0]), lambda: ForcedBoundaryBpe(shared.value[1]))


def _share(spark, tokenizer_path: str):
    """The tokenizer's file, a vocabulary of fixed size, sent to the executors once."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    return spark.sparkContext.broadcast((hash(spec), spec))


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Adds the ids of each whole text as binary, four little-endian bytes an id. A null or empty text has none.

    Row-wise: ids, ties, repeated rows and other columns are left alone; an existing ``out_col`` is replaced.
    """
    shared = _share(docs.sparkSession, tokenizer_path)

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        coder = _coder(shared)
        return pd.Series([coder.encode(t) for t in texts], dtype=object)

    return docs.withColumn(out_col, run(F.col(text_col).cast("string")))


def decode(rows: DataFrame, tokenizer_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the text that the ids stand for, special tokens kept; null ids give an empty text."""
    shared = _share(rows.sparkSession, tokenizer_path)

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        coder = _coder(shared)
        return pd.Series([coder.decode(x or b"") for x in ids], dtype=object)

    return rows.withColumn(out_col, run(F.col(ids_col)))


def encode_decode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` in one pass, in place of the text; all other columns are passed on as they are.

    One Python worker a task; it holds the results of ``SLICE`` rows at a time, whatever the batch. A null or
    empty text has no ids and an empty decoded text; existing ``ids_col`` and ``out_col`` are replaced.
    """
    shared = _share(docs.sparkSession, tokenizer_path)
    rest = docs.select(*[c for c in docs.columns if c not in (text_col, ids_col, out_col)])
    n = len(rest.columns)
    schema = T.StructType([*rest.schema.fields, T.StructField(ids_col, T.BinaryType()), T.StructField(out_col, T.StringType())])

    def run(batches):
        coder = _coder(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids = [coder.encode(t) for t in part.column(n).to_pylist()]
                decoded = [coder.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=schema.names)

    return docs.select(*rest.columns, F.col(text_col).cast("string").alias("_whole")).mapInArrow(run, schema)
