"""ISO media containers: write payloads as sampled tracks, walk nested boxes, read sample tables.

``store`` wraps a payload as 8-bit samples of one audio track; ``probe`` works on any file of this family:
it walks the boxes, decodes the sample tables and gives codec, duration and the byte range of every
keyframe, without touching the payload.
"""

from __future__ import annotations

import struct
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a sample, samples of a chunk, samples between keyframes, and samples a second of the stored form.
UNIT, PER_CHUNK, KEY_EVERY, RATE = 192, 8, 16, 8000

# Boxes that hold boxes; the head of a sample description and of the meta box before its own boxes.
NESTING = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex"}
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    size = len(body) + 8
    return struct.pack(">I4s", size, kind) + body if size < 2**32 else struct.pack(">I4sQ", 1, kind, size + 8) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def pad(payload: bytes) -> bytes:
    """Bytes 32 appended up to a positive multiple of UNIT."""
    return payload + b" " * (-len(payload) % UNIT if payload else UNIT)


def store(payload: bytes) -> bytes:
    """A file whose one track holds the payload, which must be a positive multiple of UNIT bytes."""
    n = len(payload) // UNIT
    chunks, rest = divmod(n, PER_CHUNK)
    keys = range(1, n + 1, KEY_EVERY)
    entry = box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, RATE << 16))
    runs = [(1, PER_CHUNK, 1)] * (chunks > 0) + [(chunks + 1, rest, 1)] * (rest > 0)
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp42")
    start = len(head) + 8 if len(payload) + 8 < 2**32 else len(head) + 16
    offsets = range(start, start + len(payload), UNIT * PER_CHUNK)
    wide = start + len(payload) >= 2**32
    table = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, n, UNIT)),
        full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
        full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
        full(b"stsz", struct.pack(">II", UNIT, n)),
        full(b"co64" if wide else b"stco", struct.pack(f">I{len(offsets)}{'Q' if wide else 'I'}", len(offsets), *offsets)),
    )
    length = len(payload)
    long = length >= 2**32
    times = (struct.pack(">QQIQ", 0, 0, RATE, length), 1 << 24) if long else (struct.pack(">IIII", 0, 0, RATE, length), 0)
    header = full(b"mvhd", times[0], struct.pack(">IH10x", 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2), flags=times[1])
    track = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, length) if long else struct.pack(">IIIII", 0, 0, 1, 0, length), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _MATRIX, bytes(8), flags=times[1] | 7)
    media = box(
        b"mdia",
        full(b"mdhd", times[0], struct.pack(">HH", 0x55C4, 0), flags=times[1]),
        full(b"hdlr", bytes(4), b"soun", bytes(12), b"samples\0"),
        box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table),
    )
    return head + box(b"mdat", payload) + box(b"moov", header, box(b"trak", track, media))


def walk(data: memoryview, start: int = 0, end: int | None = None):
    """(kind, from, to) of the boxes between two offsets, in order; sizes that overrun or undercut their box end the walk."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and start + 16 <= end:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            return
        yield kind, start + head, start + size
        start += size


def boxes(data: memoryview, start: int = 0, end: int | None = None, path: tuple = ()):
    """(path, from, to) of all boxes, containers opened to any depth that fits in the file."""
    todo = [(path, start, len(data) if end is None else end)]
    while todo:
        path, a, b = todo.pop()
        for kind, x, y in walk(data, a, b):
            yield (*path, kind), x, y
            if kind in NESTING and len(path) < 16:
                todo.append(((*path, kind), x, y))


def _numbers(data: memoryview, at: int, end: int, width: int, kind: str = "I") -> list[tuple]:
    """Rows of a full box: count, then rows of ``width`` numbers; never more than the box holds."""
    if at + 8 > end:
        return []
    each = struct.calcsize(f">{width}{kind}")
    n = min(struct.unpack_from(">I", data, at + 4)[0], (end - at - 8) // each)
    return list(struct.iter_unpack(f">{width}{kind}", data[at + 8 : at + 8 + n * each]))


def tracks(data: bytes) -> list[dict]:
    """codec, timescale, duration, samples (offset, size) and sync sample numbers of each track."""
    view, out = memoryview(data), []
    for kind, a, b in walk(view):
        if kind != b"moov":
            continue
        for inner, x, y in walk(view, a, b):
            if inner == b"trak":
                out.append(_track(view, x, y))
    return out


def _track(view: memoryview, start: int, end: int) -> dict:
    at = {path[-1]: (a, b) for path, a, b in boxes(view, start, end)}
    rows = lambda kind, width, code="I": _numbers(view, *at[kind], width, code) if kind in at else []
    codec = bytes(view[at[b"stsd"][0] + 12 : at[b"stsd"][0] + 16]).decode("latin-1") if b"stsd" in at and at[b"stsd"][1] - at[b"stsd"][0] >= 16 else ""
    scale = duration = 0
    if b"mdhd" in at and at[b"mdhd"][1] - at[b"mdhd"][0] >= 24:
        a = at[b"mdhd"][0]
        scale, duration = struct.unpack_from(">IQ", view, a + 20) if view[a] == 1 and at[b"mdhd"][1] - a >= 32 else struct.unpack_from(">II", view, a + 12)
    a, b = at.get(b"stsz", (0, 0))
    each, n = struct.unpack_from(">II", view, a + 4) if b - a >= 12 else (0, 0)
    n = min(n, len(view) // each) if each else n
    sizes = [each] * n if each else [r[0] for r in struct.iter_unpack(">I", view[a + 12 : a + 12 + 4 * min(n, max(0, b - a - 12) // 4)])]
    chunks = [r[0] for r in rows(b"stco", 1) or rows(b"co64", 1, "Q")]
    runs = rows(b"stsc", 3)
    offsets: list[int] = []
    for i, (first, per, _) in enumerate(runs):
        last = runs[i + 1][0] if i + 1 < len(runs) else len(chunks) + 1
        for c in range(first, min(last, len(chunks) + 1)):
            part = sizes[len(offsets) : len(offsets) + per]
            offsets += list(accumulate(part[:-1], initial=chunks[c - 1]))[: len(part)]
            if len(offsets) >= len(sizes):
                break
    keys = [r[0] for r in rows(b"stss", 1)] if b"stss" in at else range(1, len(offsets) + 1)
    return {"codec": codec, "timescale": scale, "duration": duration, "samples": list(zip(offsets, sizes, strict=False)), "keys": [k for k in keys if 1 <= k <= len(offsets)]}


def read_back(data: bytes) -> bytes:
    """The payload of the first track, sample by sample by its tables."""
    found = tracks(data)
    return b"".join([data[a : a + n] for a, n in found[0]["samples"]]) if found else b""


MEDIA = "codec string, timescale long, duration long, n_samples long, n_keys long, key_bytes long, key_ranges array<struct<offset:long,length:long>>"


def with_media(docs: DataFrame, text_col: str = "text", out_col: str = "media") -> DataFrame:
    """Adds the container of each whole text, padded; null counts as empty. Row-wise; other columns are left alone."""

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([store(pad((t or "").encode("utf-8", "surrogatepass"))) for t in texts], dtype=object)

    return docs.withColumn(out_col, run(F.col(text_col).cast("string")))


def with_probe(rows: DataFrame, media_col: str = "media", out_col: str = "probe") -> DataFrame:
    """Adds what the first track's tables say, as a struct of MEDIA; null, broken and trackless files give zeros and no ranges."""

    @F.pandas_udf(MEDIA)
    def run(files: pd.Series) -> pd.DataFrame:
        out = []
        for data in files:
            found = tracks(data or b"")
            t = found[0] if found else {"codec": "", "timescale": 0, "duration": 0, "samples": [], "keys": []}
            ranges = [{"offset": t["samples"][k - 1][0], "length": t["samples"][k - 1][1]} for k in t["keys"]]
            out.append((t["codec"], t["timescale"], t["duration"], len(t["samples"]), len(ranges), sum(r["length"] for r in ranges), ranges))
        return pd.DataFrame(out, columns=["codec", "timescale", "duration", "n_samples", "n_keys", "key_bytes", "key_ranges"])

    return rows.withColumn(out_col, run(F.col(media_col)))


def with_payload(rows: DataFrame, media_col: str = "media", out_col: str = "payload") -> DataFrame:
    """Adds the payload read back from the stored bytes by the sample tables; empty for files without a track."""

    @F.pandas_udf("binary")
    def run(files: pd.Series) -> pd.Series:
        return pd.Series([read_back(data or b"") for data in files], dtype=object)

    return rows.withColumn(out_col, run(F.col(media_col)))
