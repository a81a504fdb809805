import json
import random

import numpy as np
import public_tokenizers
from panelkit.llm import bpe
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts():
    rng = random.Random(5)
    odd = ["", " ", "Hello WORLD's it'll 12 3rd", "a\x1cb \x85 c", "Σίσυφος ΟΔΟΣ", "İstanbul", "é café", "<|endoftext|>x<|startoftext|> <|ENDOFTEXT|>",
           "a" * 5000, "!?" * 3000 + "x", "日本語 テキスト", "😀😀 naïve", "it's they're I'd", "xyzq" * 400, " a　b", "ʼn ﬁ ǆ"]
    alphabet = "abcdeéßñ '!,.0123456789\n\tΣσ漢€"
    return odd + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 300))) for _ in range(200)]


def test_equals_library():
    lib = Tokenizer.from_file(PATH)
    coder = bpe.ForcedBoundaryBpe(open(PATH, encoding="utf-8").read())
    for t in texts():
        want = lib.encode(t, add_special_tokens=False).ids
        got = coder.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == want, t[:60]
        assert coder.decode(got) == lib.decode(want, skip_special_tokens=False)


def test_cuts_lie_outside_every_token():
    coder = bpe.ForcedBoundaryBpe(open(PATH, encoding="utf-8").read())
    assert coder.cut("abc") == ["abc"]
    piece = "qxzjvq"
    assert "".join(coder.cut(piece)) == piece and len(coder.cut(piece)) > 1


def test_columns(spark):
    df = spark.createDataFrame([(1, None, b"x"), (1, None, b"x"), (None, "a b", None)], "doc_id long, text string, ids binary")
    out = bpe.decode(bpe.encode(df, PATH), PATH)
    rows = out.collect()
    assert len(rows) == 3 and {r.decoded for r in rows} == {"", "a</w> b</w>"}
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_one_pass_equals_two(spark):
    rows = spark.createDataFrame([(1, "Plain words, plain words"), (2, None), (3, ""), (4, "Größe <b>x</b> 漢字")], "doc_id long, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    two = bpe.decode(bpe.encode(rows, path), path).drop("text").orderBy("doc_id").collect()
    assert bpe.encode_decode(rows, path).orderBy("doc_id").collect() == two
    assert bpe.encode_decode(rows.limit(0), path).columns == ["doc_id", "ids", "decoded"]


def test_characters_newer_than_pythons_tables_and_bad_ids():
    with open(PATH, encoding="utf-8") as f:
        spec = f.read()
    coder, library = bpe.ForcedBoundaryBpe(spec), Tokenizer.from_str(spec)
    texts = [f"a{chr(c)}b {chr(c)}1" for c in (0x558, 0x58B, 0x1C89, 0x10EC0, 0x2FFE0, 0xFFFF, 0xE0080, 0x378)]
    for text in texts:
        assert coder.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert coder.decode(np.array([1, 2**32 - 1, 2], dtype="<u4").tobytes() + b"\x01") == coder.decode(np.array([1, 2], dtype="<u4").tobytes())


def test_characters_are_looked_up_once():
    coder = bpe.ForcedBoundaryBpe(open(PATH, encoding="utf-8").read())
    pattern, asked = coder.unknown, []

    class Counted:
        def search(self, text):
            asked.append(text)
            return pattern.search(text)

    coder.unknown = Counted()
    library = Tokenizer.from_file(PATH)
    text = " ".join(f"é{a}è{b}" for a in "abcdefgh" for b in "abcdefgh") + " éa͸è éa͸e aé"
    assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(asked) <= 20 and len(coder.met) < 30


def test_letters_that_the_vocabulary_lacks():
    letters = {c: i for i, c in enumerate("abcd")} | {"b</w>": 4, "ab</w>": 5, "cab</w>": 6, "dd": 7}
    split = {"type": "Split", "pattern": {"Regex": r"\S+"}, "behavior": "Removed", "invert": True}
    model = {"vocab": letters, "merges": ["a b</w>", "c ab</w>", "d d"], "end_of_word_suffix": "</w>"}
    coder = bpe.ForcedBoundaryBpe(json.dumps({"model": model, "added_tokens": [], "pre_tokenizer": {"pretokenizers": [split]}}))
    for text, want in [("cab", [6]), ("xab", [5]), ("cxab", [2, 5]), ("axb", [0, 4]), ("ddx", [7]), ("xdd", [3]), ("dddb", [7, 3, 4])]:
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == want, text
