import random
import struct

from panelkit.llm import media


def test_round_trip():
    rng = random.Random(1)
    for n in (0, 1, 191, 192, 193, 5000, 192 * 17, 192 * 8 * 3):
        payload = media.pad(rng.randbytes(n))
        assert len(payload) % 192 == 0 and payload
        data = media.store(payload)
        assert media.read_back(data) == payload
        (t,) = media.tracks(data)
        assert t["codec"] == "raw " and t["timescale"] == 8000 and t["duration"] == len(payload)
        assert len(t["samples"]) == len(payload) // 192
        assert t["keys"] == list(range(1, len(payload) // 192 + 1, 16))
        for k in t["keys"]:
            a, size = t["samples"][k - 1]
            assert data[a : a + size] == payload[(k - 1) * 192 : k * 192]


def test_other_layouts():
    """Samples of different sizes, chunk runs, 64-bit offsets and sizes, all samples sync, version 1 times."""
    samples = [b"a" * 5, b"b" * 7, b"c", b"d" * 11, b"e" * 2]
    body = b"".join(samples)
    head = media.box(b"ftyp", b"isom")
    mdat = struct.pack(">I4sQ", 1, b"mdat", len(body) + 16) + body
    start = len(head) + 16
    table = media.box(
        b"stbl",
        media.full(b"stsd", struct.pack(">I", 1), media.box(b"avc1", bytes(78))),
        media.full(b"stsc", struct.pack(">I6I", 2, 1, 2, 1, 3, 1, 1)),
        media.full(b"stsz", struct.pack(">II5I", 0, 5, *map(len, samples))),
        media.full(b"co64", struct.pack(">I3Q", 3, start, start + 12, start + 24)),
    )
    times = media.full(b"mdhd", struct.pack(">QQIQ", 0, 0, 90000, 123), struct.pack(">HH", 0, 0), flags=1 << 24)
    data = head + mdat + media.box(b"moov", media.box(b"trak", media.box(b"mdia", times, media.box(b"minf", table))))
    (t,) = media.tracks(data)
    assert (t["codec"], t["timescale"], t["duration"], t["keys"]) == ("avc1", 90000, 123, [1, 2, 3, 4, 5])
    assert media.read_back(data) == body


def test_broken_files_do_not_crash():
    data = media.store(media.pad(b"x" * 900))
    rng = random.Random(2)
    for i in range(0, len(data), 7):
        media.tracks(data[:i])
        bad = bytearray(data)
        for _ in range(3):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        media.tracks(bytes(bad))


def test_columns(spark):
    df = spark.createDataFrame([(1, None, 3), (1, "é" * 500, 4), (1, "é" * 500, 4), (None, "x" * 300_000, 5)], "doc_id long, text string, probe int")
    out = media.with_payload(media.with_probe(media.with_media(df))).collect()
    assert len(out) == 4
    for r in out:
        assert bytes(r.payload) == media.pad((r.text or "").encode())
        assert r.probe.n_keys == len(r.probe.key_ranges)
    assert media.with_probe(media.with_media(df.limit(0))).count() == 0
    empty = media.with_probe(spark.createDataFrame([(None,), (b"",)], "media binary")).collect()
    assert all(r.probe.n_samples == 0 for r in empty)
