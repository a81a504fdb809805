"""Toxic spans by a linear-chain conditional random field.

Documents carry labels, words do not, so words are labelled first: in toxic training documents a word is
toxic if its form, or a prefix of it, is frequent in toxic documents and next to absent from the others.
The field has two states, clean and toxic, with a weight for each such form or prefix, a bias and
transitions; it is fitted by gradient steps on the forward-backward expectations of short windows. A
document's score comes from the forward-backward marginals of its words; words with high marginals are the
offending offsets. The chain starts with the first word's emission, in fitting as in inference. Words without any feature share one emission, so runs of them are one matrix power
and a document costs no more than its few telling words.
"""

from __future__ import annotations

import string
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.quality import remainder, training_rows

#: Labelled rows of each class that the model is fitted on at most, and features that it keeps at most.
MAX_TOXIC, MAX_CLEAN, MAX_FEATURES = 2000, 3000, 4000
PREFIXES = (3, 4, 5, 6)
#: Where a word's score, and a document's summed evidence, no longer say more.
EMISSION, SATURATED = 50.0, 20.0
CACHED_WORDS = 200_000
_TRIM = string.punctuation + "«»„“”‚‘’¿¡…–—"


def form(word: str) -> str:
    return word.lower().strip(_TRIM)


def features(word: str) -> list[str]:
    """A word's form and its prefixes, told apart by a mark."""
    f = form(word)
    return [f, *(f"{f[:n]}*" for n in PREFIXES if len(f) > n)] if f else []


def different(texts: list[str]) -> list[int]:
    """Places of the texts that are no near copy of an earlier one, by shared minima of the hashes of word pairs."""
    seen: set[tuple[int, int]] = set()
    out = []
    for i, t in enumerate(texts):
        words = t.encode("utf-8", "surrogatepass").split()
        pairs = {a + b" " + b for a, b in zip(words, words[1:], strict=False)} or {t.encode("utf-8", "surrogatepass")}
        hashes = np.array([xxhash.xxh32_intdigest(w) for w in pairs], dtype=np.uint64)
        low = [(k, int((hashes * np.uint64(2 * k + 0x9E3779B1) % np.uint64(4294967291)).min())) for k in range(8)]
        if sum(x in seen for x in low) < 3:
            out.append(i)
        seen.update(low)
    return out


def telling(toxic: list[str], clean: list[str]) -> list[str]:
    """Features frequent in toxic texts and next to absent from clean ones."""
    counts = [Counter(), Counter()]
    known: dict[str, list[str]] = {}
    for side, texts in enumerate((toxic, clean)):
        for t in texts:
            counts[side].update({f for w in set(t.split()) for f in (known[w] if w in known else known.setdefault(w, features(w)))})
    least = max(3, len(toxic) // 60)
    ratio = len(clean) / max(1, len(toxic))
    good = [(n, f) for f, n in counts[0].items() if n >= least and counts[1][f] <= 0.02 * n * ratio]
    return [f for _, f in sorted(good, key=lambda x: (-x[0], x[1]))[:MAX_FEATURES]]


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float
    transitions: np.ndarray
    calibration: tuple[float, float, float] = (-4.0, 1.0, 0.0)
    cache: dict[str, float | None] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def emission(self, word: str) -> float | None:
        """A word's score for the toxic state, None for words without a feature."""
        found = [self.weights[f] for f in features(word) if f in self.weights]
        out = self.bias + sum(found) if found else None
        if len(self.cache) >= CACHED_WORDS:
            self.cache.clear()
        if len(word) < 64:
            self.cache[word] = out
        return out

    def marginals(self, text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, P(toxic)) of the words that have a feature, and the number of all words."""
        words = (text or "").split()
        cache, emission = self.cache, self.emission
        scores = [cache[w] if w in cache else emission(w) for w in words]
        at = [i for i, s in enumerate(scores) if s is not None]
        if not at:
            return np.zeros(0, dtype=np.int64), np.zeros(0), len(words)
        step = np.exp(self.transitions)
        plain = step * np.array([1.0, np.exp(self.bias)])
        values, left = np.linalg.eig(plain)
        right = np.linalg.inv(left)

        def over(gap: int) -> np.ndarray:
            """Transitions across so many words without a feature."""
            return np.real(left * (values / values.max()) ** gap @ right)

        emit = [np.array([1.0, np.exp(min(scores[i], EMISSION))]) for i in at]
        forward, backward = [], [None] * len(at)
        for k, e in enumerate(emit):
            if k:
                start = start @ over(at[k] - at[k - 1] - 1) @ step * e
            elif at[0]:
                start = np.array([1.0, np.exp(self.bias)]) @ over(at[0] - 1) @ step * e
            else:
                start = e
            start = start / start.sum()
            forward.append(start)
        end = over(len(words) - at[-1] - 1) @ np.ones(2)
        for k in range(len(at) - 1, -1, -1):
            end = end / end.sum()
            backward[k] = end
            end = (over(at[k] - at[k - 1] - 1) if k else np.eye(2)) @ (step @ (emit[k] * end))
        both = np.array(forward) * np.array(backward)
        return np.array(at), both[:, 1] / both.sum(axis=1), len(words)

    def score(self, texts) -> np.ndarray:
        return self.calibrated([self.marginals(t)[1] for t in texts])

    def calibrated(self, marginals: list[np.ndarray]) -> np.ndarray:
        a, b, c = self.calibration
        x = np.array([evidence(p) for p in marginals]).reshape(-1, 2)
        return 1 / (1 + np.exp(-(a + b * x[:, 0] + c * x[:, 1])))

    def tagged(self, text: str | None, at: np.ndarray, p: np.ndarray, threshold: float = 0.5) -> list[tuple[int, int, float]]:
        """(first character, end, marginal) of the words tagged toxic, from the text's marginals."""
        tagged = {int(i): float(x) for i, x in zip(at, p, strict=True) if x >= threshold}
        out, place = [], 0
        for i, word in enumerate((text or "").split() if tagged else ()):
            place = text.index(word, place)
            if i in tagged:
                out.append((place, place + len(word), tagged[i]))
            place += len(word)
        return out


def evidence(p: np.ndarray) -> tuple[float, float]:
    """What a document's marginals say: -log of the probability that no word is toxic, up to SATURATED, and the highest."""
    return (min(SATURATED, float(-np.log1p(-np.minimum(p, 1 - 1e-4)).sum())), float(p.max())) if len(p) else (0.0, 0.0)


def _windows(texts: list[str], toxic: list[bool], index: dict[str, int], reach: int = 6):
    """Windows of words around telling words, and one of every text without any: feature places, labels, lengths.

    Words without a feature are alike, so one window stands for such a text.
    """
    rows, labels = [], []
    for t, bad in zip(texts, toxic, strict=True):
        words = t.split()
        ids = [[index[f] for f in features(w) if f in index] for w in words]
        hits = [i for i, x in enumerate(ids) if x]
        done = -1
        for i in hits or [0] * bool(words):
            if i > done:
                a, b = max(0, i - reach), min(len(words), i + reach + 1)
                rows.append(ids[a:b])
                labels.append([int(bad and bool(x)) for x in ids[a:b]])
                done = b - 1
    return rows, labels


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit_field(texts: list[str], toxic: list[bool], chosen: list[str], rounds: int = 80) -> ToxicityModel:
    """Weights of the field by Adam steps on the windows' log-likelihood with a small ridge."""
    index = {f: i for i, f in enumerate(chosen)}
    rows, labels = _windows(texts, toxic, index)
    if not rows or not chosen:
        return ToxicityModel({}, -6.0, np.zeros((2, 2)))
    n, width = len(rows), max(map(len, rows))
    there = np.zeros((n, width), dtype=bool)
    truth = np.zeros((n, width), dtype=np.int64)
    r, c, f = [], [], []
    for i, (ids, ys) in enumerate(zip(rows, labels, strict=True)):
        there[i, : len(ids)] = True
        truth[i, : len(ys)] = ys
        for j, x in enumerate(ids):
            r += [i] * len(x)
            c += [j] * len(x)
            f += x
    r, c, f = np.array(r), np.array(c), np.array(f)
    p = {"w": np.zeros(len(chosen)), "b": np.array(-2.0), "t": np.zeros((2, 2))}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    pairs = there[:, 1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (truth[:, :-1][pairs], truth[:, 1:][pairs]), 1)
    for step in range(1, rounds + 1):
        emit = np.full((n, width), float(p["b"]))
        np.add.at(emit, (r, c), p["w"][f])
        node = np.stack([np.zeros_like(emit), emit], axis=2)
        node[~there] = 0
        forward = np.zeros((n, width, 2))
        backward = np.zeros((n, width, 2))
        forward[:, 0] = node[:, 0]
        for j in range(1, width):
            new = _logsum(forward[:, j - 1, :, None] + p["t"], 1) + node[:, j]
            forward[:, j] = np.where(there[:, j, None], new, forward[:, j - 1])
        for j in range(width - 2, -1, -1):
            new = _logsum(p["t"][None] + (node[:, j + 1] + backward[:, j + 1])[:, None, :], 2)
            backward[:, j] = np.where(there[:, j + 1, None], new, 0.0)
        z = _logsum(forward[:, -1], 1)
        q = np.exp(forward + backward - z[:, None, None])[:, :, 1]
        err = np.where(there, q - truth, 0.0)
        both = forward[:, :-1, :, None] + p["t"] + (node[:, 1:] + backward[:, 1:])[:, :, None, :] - z[:, None, None, None]
        grad = {"w": np.bincount(f, weights=err[r, c], minlength=len(chosen)) / n + 1e-5 * p["w"], "b": err.sum() / n, "t": (np.exp(both[pairs]).sum(axis=0) - seen) / n + 1e-3 * p["t"]}
        for k, g in grad.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            p[k] = p[k] - 0.1 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return ToxicityModel(dict(zip(chosen, p["w"].tolist(), strict=True)), float(p["b"]), p["t"])


def fit(texts: list[str], labels, shift: float = 0.0) -> ToxicityModel:
    """The whole model from labelled texts; near copies count once for the choice of features.

    ``shift`` is added to the log odds, where the texts are a sample with another mix of classes.
    """
    toxic = [bool(y) for y in labels]
    once = set(different(texts))
    sides = [[t for i, (t, y) in enumerate(zip(texts, toxic, strict=True)) if y == side and i in once] for side in (True, False)]
    model = fit_field(texts, toxic, telling(*sides))
    x = np.array([evidence(model.marginals(t)[1]) for t in texts]).reshape(-1, 2)
    y = np.array(toxic, dtype=float)
    if not len(y) or y.min() == y.max():
        return model
    w = np.array([-3.0, 0.5, 0.5])
    design = np.column_stack([np.ones(len(y)), x])
    for _ in range(60):
        s = 1 / (1 + np.exp(-design @ w))
        ridge = np.diag([1e-2, 5e-2, 5e-2])
        hessian = design.T @ (design * (s * (1 - s))[:, None]) + ridge
        w = w - np.clip(np.linalg.solve(hessian, design.T @ (s - y) + ridge @ w), -1, 1)
    model.calibration = (float(w[0]) + shift, float(w[1]), float(w[2]))
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held: int = 1) -> ToxicityModel:
    """A model of the labels whose id does not fall into fold ``held``, on a bounded number of rows of each class."""
    rows, shift = training_rows(docs, labels, label_col, remainder(id_col, folds) != held, id_col, text_col, {1: MAX_TOXIC, 0: MAX_CLEAN})
    return fit(rows["t_text"].fillna("").tolist(), rows["t_label"].tolist(), shift)


def with_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """Adds a struct of the score of each whole text and the offsets (characters) of its toxic words; an existing ``out_col`` is replaced.

    Null and empty texts have the score of a text without any telling word. Row-wise: ids, ties, repeated rows
    and other columns do not matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, spans array<struct<first:int,end:int,marginal:double>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        found = [model.marginals(t) for t in texts]
        spans = [[{"first": a, "end": b, "marginal": x} for a, b, x in model.tagged(t, at, p)] for t, (at, p, _) in zip(texts, found, strict=True)]
        return pd.DataFrame({"score": model.calibrated([p for _, p, _ in found]), "spans": spans})

    return docs.withColumn(out_col, run(F.col(text_col).cast("string")))
