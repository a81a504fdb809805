"""Substring dedup by suffix automata over shards of reference passages.

Equal windows of words have the same minimal k-gram at the same place, so windows that repeat anywhere
share an *anchor*. Texts are first collapsed to distinct ones and bucketed by their key; anchors that occur
once are dropped; the passages around the others are the reference. A reference of a growing corpus has no
bounded size and is not broadcast: its shards are the different passages that share an anchor, and each
passage is streamed only through the automaton of its own shard, which holds everything that the passage
can repeat. The matching statistics then say, window by window, whether the longest match reaches the
threshold and how often that sequence of words occurs.

An anchor with very many different passages is dealt into several shards of a fixed size. Each shard's
automaton settles the windows that repeat inside it; of every window it passes on one place, and windows
passed on by two shards repeat as well. So no shard grows with the corpus, copies of a passage cost one row,
and every passage gets its bits back in one row before it meets its places.

Automata and the exchange between shards compare words. Texts and passages are told apart by 128-bit
digests, which also say where they meet.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm._common import cut, fresh, made, parallelism, text_key, written

#: Different passages in one automaton, about; an anchor with more is dealt into several shards.
SHARD = 2048
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(17).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = []


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    if not _powers:
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        for base in (_BASE, inverse):
            column = np.full(_CHUNK + 1, base, dtype=np.uint64)
            column[0] = 1
            _powers.append(np.cumprod(column, dtype=np.uint64))
    return _powers[0], _powers[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word; it steers where passages meet and decides nothing."""
    octets = np.frombuffer(data, dtype=np.uint8)
    edges = np.diff(_SPACE[octets].astype(np.int8), prepend=1, append=1)
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    power, inverse = _power_tables()
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + _CHUNK, side="right")))
        if ends[at] - base > _CHUNK:
            out[at] = xxhash.xxh64_intdigest(data[base : ends[at]])
        else:
            piece = octets[base : ends[to - 1]]
            sums = np.zeros(len(piece) + 1, dtype=np.uint64)
            np.cumsum(_BYTE[piece] * power[: len(piece)], out=sums[1:])
            a, b = starts[at:to] - base, ends[at:to] - base
            out[at:to] = (sums[b] - sums[a]) * inverse[a]
        at = to
    return _mix(out)


def gram_size(window: int) -> int:
    return max(1, min(8, window // 2), window - 62)


def anchors(data: bytes, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last): runs of window starts that share the leftmost minimal k-gram."""
    k, words = gram_size(window), word_hashes(data)
    total = len(words) - window + 1
    if total <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    grams = np.zeros(len(words) - k + 1, dtype=np.uint64)
    for j in range(k):
        grams = grams * _BASE + words[j : j + len(grams)]
    grams = _mix(grams)
    views = np.lib.stride_tricks.sliding_window_view(grams, window - k + 1)
    place = np.concatenate([views[i : i + 8192].argmin(axis=1) for i in range(0, total, 8192)]) + np.arange(total)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    last = np.append(first[1:], total) - 1
    return grams[place[first]].view(np.int64), first, last


class SuffixAutomaton:
    """Suffix automaton of several passages of words, with the weighted number of places of every state."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.count.append(0)
        return len(self.next) - 1

    def _split(self, at: int, word, to: int) -> int:
        clone = self._state(self.length[at] + 1, dict(self.next[to]), self.link[to])
        self.link[to] = clone
        while at >= 0 and self.next[at].get(word) == to:
            self.next[at][word] = clone
            at = self.link[at]
        return clone

    def add(self, words: list, weight: int) -> None:
        last, nexts, links, lengths = 0, self.next, self.link, self.length
        for word in words:
            to = nexts[last].get(word)
            if to is not None:
                last = to if lengths[to] == lengths[last] + 1 else self._split(last, word, to)
            else:
                new, at = self._state(lengths[last] + 1, {}, 0), last
                while at >= 0 and word not in nexts[at]:
                    nexts[at][word] = new
                    at = links[at]
                if at >= 0:
                    to = nexts[at][word]
                    links[new] = to if lengths[to] == lengths[at] + 1 else self._split(at, word, to)
                last = new
            self.count[last] += weight

    def finish(self) -> None:
        """Adds up the places along the suffix links."""
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[state] >= 0:
                self.count[self.link[state]] += self.count[state]

    def windows(self, words: list, window: int) -> list[tuple[int, int, int]]:
        """(start, state, places) of the windows whose match is long enough; equal windows have the same state."""
        state, matched, out = 0, 0, []
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                matched += 1
            while state and self.length[self.link[state]] >= window:
                state = self.link[state]
                matched = self.length[state]
            if matched >= window:
                out.append((i - window + 1, state, self.count[state]))
        return out


def shard_masks(passages: list[str], counts: list[int], window: int, open_ended: bool = False) -> tuple[list[int], list[tuple[int, int, str, bool]]]:
    """For each different passage of a shard, the bits of the window starts that repeat in it.

    For an open-ended shard also (passage, start, window, single) of one place of every different window; it is
    single where the shard has no other place.
    """
    split = [p.encode("utf-8", "surrogatepass").split() for p in passages]
    automaton = SuffixAutomaton()
    for words, n in zip(split, counts, strict=True):
        automaton.add(words, n)
    automaton.finish()
    masks, passed, seen = [], [], set()
    for at, words in enumerate(split):
        found = automaton.windows(words, window)
        masks.append(sum(1 << s for s, _, places in found if places >= 2))
        for s, state, places in found if open_ended else ():
            if state not in seen:
                seen.add(state)
                passed.append((at, s, b" ".join(words[s : s + window]).decode("utf-8", "surrogatepass"), places < 2))
    return masks, passed


def _distinct_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """Different texts with their number of copies, as a table bucketed by the text's key."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    rows = docs.select(text).select(*text_key(F.col("text")), "text")
    once = rows.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    name = f"panelkit_texts_{uuid.uuid4().hex}"
    made.append(("table", name))
    once.write.format("parquet").option("compression", "zstd").bucketBy(parallelism(spark), "k1", "k2").saveAsTable(name)
    return spark.table(name)


def _anchor_rows(texts: DataFrame, window: int) -> DataFrame:
    def run(batches):
        fresh("substring")
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                found = [anchors(t.encode("utf-8", "surrogatepass"), window) for t in part["text"]]
                times = [len(f[0]) for f in found]
                if sum(times):
                    h, first, last = (np.concatenate([f[i] for f in found]) for i in range(3))
                    yield pd.DataFrame({"h": h, "k1": np.repeat(part["k1"].to_numpy(), times), "k2": np.repeat(part["k2"].to_numpy(), times), "s1": first.astype(np.int32), "s2": last.astype(np.int32)})

    return texts.select("k1", "k2", "text").mapInPandas(run, "h long, k1 long, k2 long, s1 int, s2 int")


def _passages(texts: DataFrame, window: int) -> DataFrame:
    """One row for every run of window starts with a shared anchor: the words that these windows cover."""

    def run(batches):
        fresh("substring")
        for pdf in batches:
            out: list[tuple] = []
            for k1, k2, copies, text, runs in zip(pdf["k1"], pdf["k2"], pdf["copies"], pdf["text"], pdf["runs"], strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                for r in runs:
                    passage = b" ".join(words[r["s1"] : r["s2"] + window])
                    digest = xxhash.xxh3_128_intdigest(passage)
                    out.append((r["h"], (digest >> 64) - 2**63, (digest & (2**64 - 1)) - 2**63, k1, k2, r["s1"], copies, passage.decode("utf-8", "surrogatepass")))
                    if len(out) >= 8192:
                        yield pd.DataFrame(out, columns=names)
                        out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    names = ["h", "p1", "p2", "k1", "k2", "s1", "copies", "passage"]
    return texts.mapInPandas(run, "h long, p1 long, p2 long, k1 long, k2 long, s1 int, copies long, passage string")


def _shard_results(different: DataFrame, window: int) -> DataFrame:
    """(h, p1, p2, mask, passed, single) from (h, p1, p2, passage, n, shard, shards), one automaton at a time.

    Rows with ``passed`` null hold the repeated starts of a passage; the others one start and its window.
    """

    def run(batches):
        fresh("substring")
        key, keys, texts, counts = None, [], [], []

        def close():
            masks, passed = shard_masks(texts, counts, window, key[2] > 1)
            found = [(*k, m, None, False) for k, m in zip(keys, masks, strict=True) if m]
            return found + [(*keys[at], 1 << s, words, single) for at, s, words, single in passed]

        for pdf in batches:
            done: list[tuple] = []
            for h, shard, shards, p1, p2, text, n in zip(pdf["h"], pdf["shard"], pdf["shards"], pdf["p1"], pdf["p2"], pdf["passage"], pdf["n"], strict=True):
                if (h, shard, shards) != key:
                    if keys:
                        done += close()
                    key, keys, texts, counts = (h, shard, shards), [], [], []
                keys.append((h, p1, p2))
                texts.append(text)
                counts.append(n)
            yield pd.DataFrame(done, columns=names)
        if keys:
            yield pd.DataFrame(close(), columns=names)

    names = ["h", "p1", "p2", "mask", "passed", "single"]
    dealt = different.repartition("h", "shard").sortWithinPartitions("h", "shard", "p1", "p2")
    return dealt.mapInPandas(run, "h long, p1 long, p2 long, mask long, passed string, single boolean")


def _masks(different: DataFrame, window: int, shard: int) -> DataFrame:
    """(h, p1, p2, mask): the repeated starts of every different passage, in one row."""
    sizes = different.groupBy("h").agg(F.ceil(F.count("*") / shard).alias("shards"))
    dealt = different.join(sizes, "h").withColumn("shard", F.pmod("p1", "shards"))
    results = written(_shard_results(dealt, window), "masks")
    passed = results.where("passed IS NOT NULL")
    again = passed.groupBy("passed").agg(F.count("*").alias("n")).where("n >= 2").select("passed")
    across = passed.where("single").join(again, "passed").select("h", "p1", "p2", "mask")
    inside = results.where("passed IS NULL").select("h", "p1", "p2", "mask")
    return inside.union(across).groupBy("h", "p1", "p2").agg(F.bit_or("mask").alias("mask"))


def _kept(texts: DataFrame, window: int) -> DataFrame:
    def run(batches):
        fresh("substring")
        for pdf in batches:
            out = []
            for k1, k2, copies, text, found in zip(pdf["k1"], pdf["k2"], pdf["copies"], pdf["text"], pdf["found"], strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                n = len(words)
                starts: list[int] = []
                if copies >= 2 and n >= window:
                    covered = np.ones(n, dtype=bool)
                else:
                    for row in found if found is not None else ():
                        starts += [row["s1"] + b for b in range(row["mask"].bit_length()) if row["mask"] >> b & 1]
                    edge = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, [s + window for s in starts], -1)
                    covered = np.cumsum(edge[:n]) > 0
                change = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                kept = words if not len(change) else [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                spans = [{"first": int(a), "end": int(b)} for a, b in change]
                out.append((k1, k2, n, int(covered.sum()), b" ".join(kept).decode("utf-8", "surrogatepass"), spans))
                if len(out) >= 1024:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    names = ["k1", "k2", "n_words", "n_removed", "kept", "spans"]
    return texts.mapInPandas(run, "k1 long, k2 long, n_words long, n_removed long, kept string, spans array<struct<first:int,end:int>>")


def repeated_spans(docs: DataFrame, text_col: str = "text", window: int = 35, shard: int = SHARD) -> DataFrame:
    """One row per different text: k1, k2 (its key), n_words, n_removed, kept (the other words joined by one space), spans of words.

    A word goes when a window of ``window`` words that covers it starts anywhere else, in another row or in
    the same one; rows with equal texts repeat each other. Null counts as the empty text; texts shorter
    than a window keep all words; an empty table gives an empty table. Ids and other columns are not read.
    """
    texts = _distinct_texts(docs, text_col)
    places = written(_anchor_rows(texts, window), "anchors")
    often = cut(places.groupBy("h").agg(F.count("*").alias("n")).where("n >= 2"))
    runs = places.join(often.select("h"), "h").groupBy("k1", "k2").agg(F.collect_list(F.struct("s1", "s2", "h")).alias("runs"))
    pieces = written(_passages(texts.join(runs, ["k1", "k2"]), window), "passages")
    different = written(pieces.groupBy("h", "p1", "p2").agg(F.first("passage").alias("passage"), F.sum("copies").alias("n")), "different")
    found = pieces.select("h", "p1", "p2", "k1", "k2", "s1").join(_masks(different, window, shard), ["h", "p1", "p2"])
    found = found.groupBy("k1", "k2").agg(F.collect_list(F.struct("s1", "mask")).alias("found"))
    return _kept(texts.join(found, ["k1", "k2"], "left"), window)


def without_repeats(docs: DataFrame, text_col: str = "text", window: int = 35, chars_col: str | None = "n_chars") -> DataFrame:
    """The input's rows and columns with the repeated words taken out of the text; rows that lose nothing keep their text as it is.

    Null texts stay null; ``chars_col``, where it is there, is counted anew for changed texts.
    """
    inner = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    rows = docs.toDF(*inner).select(*inner, *text_key(F.col(inner[at]).cast("string")))
    changed = repeated_spans(docs, text_col, window).where("n_removed > 0").select("k1", "k2", "kept")
    joined = rows.join(changed, ["k1", "k2"], "left")
    text = F.coalesce("kept", inner[at])
    out = []
    for c, name in zip(inner, docs.columns, strict=True):
        if name == text_col:
            out.append(text.alias(name))
        elif name == chars_col:
            kind = docs.schema[name].dataType
            out.append(F.when(F.col("kept").isNotNull(), F.length("kept")).otherwise(F.col(c)).cast(kind).alias(name))
        else:
            out.append(F.col(c).alias(name))
    return joined.select(*out)
