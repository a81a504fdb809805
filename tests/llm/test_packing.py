"""Packing: exact ids, a plain best fit, whole sequences and how many there are."""

import random
import zlib

import numpy as np
from panelkit.llm import packing
from panelkit.llm.bpe import ForcedBoundaryBpe
from panelkit.llm.queries import word_bpe
from tokenizers import Tokenizer

KIND = "doc_id long, text string, piece string, length string"


def texts():
    rng = random.Random(3)
    odd = [None, "", " ", "\x01 a\x01b \x01", "<|endoftext|>x <|startoftext|>", "x" * 9000, "İΣ ΑΣ straße ǅ", "a\x1cb c", "\U0001f600 é é �", "\U0001e030x y\U0001e030"]
    return odd + [" ".join(rng.choice(["alpha", "beta's", "12", "Γάμμα", "x-y", "don't"]) for _ in range(rng.randint(0, 3000))) for _ in range(60)] + ["same words"] * 40


def rows(spark):
    found = [(i if i % 11 else None, t, "p", "q") for i, t in enumerate(texts())]
    return [*found, found[-1]]


def library_ids(text):
    tokenizer = Tokenizer.from_file(word_bpe())
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes()


def test_pieces_and_sequences(spark):
    given = rows(spark)
    places = packing.packed(spark.createDataFrame(given, KIND).repartition(3), word_bpe(), keep_ids=True)
    got = places.collect()
    want = []
    for i, t, *_ in given:
        ids = library_ids(t)
        want += [(i, n, s // 4, len(ids[s : s + 8192]) // 4, zlib.crc32(ids[s : s + 8192])) for n, s in enumerate(range(0, len(ids), 8192))]
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for members in by.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by) <= -(-sum(r.length for r in got) // 2048) + 1
    whole = {r.sequence_id: r for r in packing.sequences(places).collect()}
    for k, members in by.items():
        assert whole[k].ids == b"".join(r.ids for r in sorted(members, key=lambda r: r.offset)) and whole[k].n_pieces == len(members) and whole[k].n_tokens * 4 == len(whole[k].ids)


def test_empty_table(spark):
    assert packing.packed(spark.createDataFrame([], KIND), word_bpe()).count() == 0


def test_best_fit_equals_a_plain_search():
    rng = random.Random(8)
    for open_bins in (1, 3, 50):
        bins, plain, made = packing.BestFit(100, open_bins), [], 0
        for _ in range(2000):
            n = rng.choice([1, 5, 17, 50, 60, 100, rng.randint(1, 100)])
            number, offset = bins.place(n)
            fits = [f for f, _ in plain if f >= n]
            if fits:
                assert 100 - offset == min(fits) and (min(fits), number) in plain
                plain.remove((min(fits), number))
            else:
                assert offset == 0 and number == made
                made += 1
            left = 100 - offset - n
            if left:
                plain.append((left, number))
                if len(plain) > open_bins:
                    fullest = min(f for f, _ in plain)
                    gone = [x for x in plain if x[0] == fullest]
                    # Of several equally full ones, the packer's own stack says which is closed.
                    held = {b for s in bins.bins for b in s}
                    plain.remove(next(x for x in gone if x[1] not in held))
            assert bins.held == len(plain) <= open_bins


def test_ranks_are_the_merge_list():
    """Each string is made by one merge and is its own encoding, so ranks merge as the list does; and on odd words they do."""
    with open(word_bpe(), encoding="utf-8") as f:
        spec = f.read()
    coder = ForcedBoundaryBpe(spec)
    ranks, ids = packing.rank_table(coder)
    fast = packing.WordIds(spec, ranks, ids)
    given = [t or "" for t in texts()] + [f"a{chr(c)}b {chr(c)}1" for c in range(1, 0x3000)]
    assert fast.encode(given) == [coder.encode(t) for t in given]
