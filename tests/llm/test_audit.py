"""The audit of filters against a plain walk through all orders, and its potential against Shapley's formula."""

import re
from itertools import permutations

from panelkit.llm import audit
from pyspark.sql import functions as F

KIND = "doc_id long, text string, source string, part string, mask int, n long"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def failing(text, rows, i):
    w = WORD.findall(text)
    out = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
    return out + "E" * (i is not None and any(j is not None and j < i and (t or "") == text for j, t, *_ in rows))


def brute(docs, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    failed = [(s or "", failing(t or "", docs, i), i in good, i in toxic) for i, t, s, *_ in docs]
    out, shares = [], {}
    for part in {f[0] for f in failed}:
        own = [f for f in failed if f[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [f for f in left if x in f[1]]
                left = [f for f in left if x not in f[1]]
                shares[part, x] = shares.get((part, x), 0) + len(gone)
                out.append([part, order, step, len(left), len(gone), sum(x in f[1] for f in own) - len(gone), sum(f[1] == x for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone)])
    return sorted((*r, shares[r[0], r[1][r[2] - 1]]) for r in out)


def test_equals_a_plain_walk(spark):
    long = " ".join(f"w{i}" for i in range(230))
    texts = [None, "", long, long, f"{long} #", " ".join(["a"] * 210), "A" * 40 + " x", f"{long} AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA", "É Σ", long, "\x1f \x85", f"{long}\tX"]
    docs = [(i, t, ["s", "", None, "t"][i % 4], "p", 1, 2) for i, t in enumerate(texts)]
    docs += [(2, long, "s", "p", 1, 2), (2, long, "s", "p", 1, 2), (None, long, "t", "p", 1, 2), (None, "#", None, "p", 1, 2), (None, "#", None, "p", 1, 2), (40, "#", "s", "p", 1, 2)]
    labels = [(0, 1, 0), (2, 1, 1), (3, 1, None), (3, 0, 1), (5, None, 1), (9, 1, 1), (None, 1, 1), (77, 1, 1)]
    got = audit.audit(spark.createDataFrame(docs, KIND).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, got.collect())) == brute(docs, labels)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], KIND), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs, labels).count() == 0
    assert audit.audit(spark.createDataFrame([(1, "x", "s", "p", 1, 2)], KIND), labels).where("good_lost + toxic_lost > 0").count() == 0


def test_potential(spark):
    """P(all) - P(all but i) is 120 times the Shapley value of any game on five players."""
    v = [0] + [(7 * s * s) % 31 + 3 * bin(s).count("1") for s in range(1, 32)]
    p = spark.createDataFrame([(v,)], "v array<long>").select(audit.potential(F.col("v"))).first()[0]
    shares = dict.fromkeys(range(5), 0)
    for order in permutations(range(5)):
        held = 0
        for i in order:
            shares[i] += v[held | 1 << i] - v[held]
            held |= 1 << i
    assert [p[31] - p[31 - (1 << i)] for i in range(5)] == [shares[i] for i in range(5)] and len(p) == 32
