"""Alignment of two tokenizers against both libraries on whole texts, in plain loops."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from panelkit.llm import alignment
from tokenizers import Tokenizer

KIND = "doc_id long, text string, run string, radix int"
ODD = [None, "", " ", "   ", "\n", "  a  b ", "a\n\nb\t c", "▁x", "a ▁ b", "<s> <|endoftext|> x", " x 　 y", "\x1c x \x1fy", "日本語 テスト  x", "\x00 a\x00", "x" * 3000, " x", "x ", "it's don't’s 12345 ½   q", "\U0001f600\U0001f468‍\U0001f469 �", "ａ ﬁ", "a b", "a b"]


def byte_letters():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


def brute(rows):
    a_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = byte_letters()
    per, counts = [], Counter()
    for _, text, *_ in rows:
        a, b, groups, links = [], [], [], []
        if text:
            a, b = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
            ab = [bytes(letters[c] for c in a_side.id_to_token(i)) for i in a]
            bb = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(ab) != f" {text}".encode() or b"".join(bb) != f" {text}".encode():
                a = b = []
        i = j = 0
        while i < len(a):
            ga, gb, ea, eb = [a[i]], [b[j]], len(ab[i]), len(bb[j])
            links.append((a[i], b[j]))
            while ea != eb:
                if ea < eb:
                    i += 1
                    ea += len(ab[i])
                    ga.append(a[i])
                else:
                    j += 1
                    eb += len(bb[j])
                    gb.append(b[j])
                links.append((a[i], b[j]))
            groups.append((ga, gb))
            i, j = i + 1, j + 1
        per.append((len(a), len(b), groups, links))
        counts.update(set(links))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for row, (n_a, n_b, groups, links) in zip(rows, per, strict=True):
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((row[0], n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return out


def aligned(df, **more):
    P = public_tokenizers
    return [tuple(r) for r in alignment.align(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, P.path("piece_bpe_32k.model"), **more).collect()]


def key(row):
    return tuple(map(str, row))


def test_equals_libraries(spark):
    rng = random.Random(5)
    common = ["the", "of", "and", "value", "Zürich", "naïve", "x1", "(see)", "don't", "antidisestablishmentarianism"]
    texts = [*ODD, *[" ".join(rng.choice(common) for _ in range(rng.randint(1, 60))) for _ in range(40)], *["the same text"] * 30]
    rows = [(i if i % 9 else None, t, "run", 1) for i, t in enumerate(texts)]
    rows.append(rows[-1])  # a repeated row
    want = sorted(brute(rows), key=key)
    df = spark.createDataFrame(rows, KIND).repartition(4)
    assert sorted(aligned(df), key=key) == want
    # Many small runs, merged and streamed in several groups, change nothing.
    assert sorted(aligned(df, links_per_run=50, merged_runs=3, streamed_runs=2), key=key) == want


def test_empty_table(spark):
    assert aligned(spark.createDataFrame([], KIND)) == []


def test_heap_merge_counts_each_pair_once():
    import numpy as np

    links, docs = np.array([5, 5, 9, 9, 9, 700], dtype=np.int64), np.array([0, 0, 0, 1, 1, 2])
    runs = alignment.spilled(links, docs, 8)
    assert [r for r, *_ in runs] == [0, 2]
    assert list(alignment.merged([runs[0][1], runs[0][1]])) == [(5, 2), (9, 4)]
    steps, uses = alignment.unpacked(runs[0][2], 2)
    assert uses.tolist() == [2, 1, 2]


def test_vocabulary_that_cannot_be_cut(spark):
    """Without certain cuts whole texts are aligned, with the same result."""
    P = public_tokenizers
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f, open(P.path("piece_bpe_32k.model"), "rb") as g:
        v = alignment.Vocabularies(f.read(), P.PATTERN, g.read())
    assert v.cuttable
    texts = [t for t in ODD if t]
    cut = alignment.Aligner(v).slice(texts)
    v.cuttable = False
    whole = alignment.Aligner(v).slice(texts)
    assert cut[0].tolist() == whole[0].tolist() and cut[1] == whole[1]
    assert sorted(zip(cut[3].tolist(), cut[2].tolist(), strict=True)) == sorted(zip(whole[3].tolist(), whole[2].tolist(), strict=True))
