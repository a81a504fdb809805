"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

A word stands for two units: its lower-case letters and its shape (case and kinds of characters, runs
collapsed); a third unit marks that a word repeats the one before. Every unit has a sparse ternary index
vector derived from its hash. Its word vector is that index vector plus the scaled sum of the index vectors
around it in the training texts, kept in a table of fixed size. A document is the mean of its words'
vectors; a two-layer numpy network turns that into a logit, which a temperature, fitted on rows set aside,
calibrates.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm._common import worker_state

#: Labelled rows that the model is fitted on at most, taken in order of a hash of the id.
MAX_TRAINING_ROWS = 4000
DIMENSIONS, BUCKETS, HIDDEN = 48, 1 << 14, 16
CACHED_WORDS = 100_000
_REPEAT = b"\x00again"
_SHAPE = [(re.compile("[a-zß-öø-ÿ]+"), "a"), (re.compile("[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile("[0-9]+"), "0"), (re.compile(r"([^aA0])\1+"), r"\1\1")]


def shape(word: str) -> str:
    if word.isalpha() and word.islower():
        return "a"
    for pattern, by in _SHAPE:
        word = pattern.sub(by, word)
    return word


def units(word: str) -> tuple[int, int]:
    """Buckets of a word's letters and of its shape."""
    letters = word.strip(".,;:!?").lower()
    if not letters.isalnum():
        letters = "".join(filter(str.isalnum, letters))
    return bucket(b"w" + letters.encode("utf-8", "surrogatepass")), bucket(b"s" + shape(word).encode("utf-8", "surrogatepass"))


def bucket(unit: bytes) -> int:
    return xxhash.xxh64_intdigest(unit, 11) % BUCKETS


def index_vectors(dimensions: int = DIMENSIONS) -> np.ndarray:
    """Sparse ternary vectors, four entries of +1 or -1 for each bucket."""
    rng = np.random.default_rng(20)
    out = np.zeros((BUCKETS, dimensions), dtype=np.float32)
    rows = np.arange(BUCKETS)
    for _ in range(4):
        out[rows, rng.integers(0, dimensions, BUCKETS)] += rng.choice(np.array([-1.0, 1.0], dtype=np.float32), BUCKETS)
    return out


def unit_rows(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the letters, of the shapes, and whether each word repeats the one before."""
    words = (text or "").split()
    cache: dict[str, tuple[int, int]] = {}
    pairs = [cache[w] if w in cache else cache.setdefault(w, units(w)) for w in words]
    both = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    same = np.array([False, *(a == b for a, b in zip(words, words[1:], strict=False))][: len(words)], dtype=bool)
    return both[:, 0], both[:, 1], same


@dataclass
class QualityModel:
    """vectors: BUCKETS x DIMENSIONS; the rest is the network. Its size is fixed, whatever it is fitted on."""

    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    #: Added to the calibrated log odds, where the training rows were a sample with another mix of classes.
    shift: float = 0.0

    def __post_init__(self) -> None:
        self.again = self.vectors[bucket(_REPEAT)]
        self.cache: dict[str, int] = {}
        self.pairs = np.zeros((CACHED_WORDS, 2), dtype=np.int32)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def _row(self, word: str) -> int:
        n = len(self.cache)
        self.pairs[n] = units(word)
        self.cache[word] = n
        return n

    def pooled(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        total = np.zeros(2 * self.vectors.shape[1], dtype=np.float64)
        for at in range(0, len(words), 8192):
            part = words[at : at + 8192]
            if len(self.cache) + len(part) > CACHED_WORDS:
                self.cache.clear()
            get, row = self.cache.get, self._row
            ids = [i if (i := get(w)) is not None else row(w) for w in part]
            total += self.vectors[self.pairs[ids]].sum(axis=0).ravel()
        n = max(1, len(words))
        same = sum(a == b for a, b in zip(words, words[1:], strict=False))
        return np.concatenate([total / n, self.again * (same / n)])

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Row by row: a product of several rows may round a row by what stands beside it, and a score must not."""
        return np.array([np.tanh(z @ self.w1 + self.b1) @ self.w2 for z in (x - self.mean) / self.scale]) + self.b2

    def score(self, texts) -> np.ndarray:
        """Probability of label 1; 0 for a text without words."""
        texts = list(texts)
        if not texts:
            return np.zeros(0)
        x = np.stack([self.pooled(t) for t in texts])
        p = 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature + self.shift, -500, 500)))
        return np.where([bool((t or "").split()) for t in texts], p, 0.0)


def word_vectors(texts: list[str], window: int = 2) -> np.ndarray:
    index = index_vectors()
    context = np.zeros_like(index)
    for t in texts:
        letters, shapes, same = unit_rows(t)
        if not len(letters):
            continue
        own = index[letters] + index[shapes]
        around = np.zeros_like(own)
        for k in range(1, window + 1):
            around[k:] += own[:-k]
            around[:-k] += own[k:]
        for ids in (letters, shapes):
            order = np.argsort(ids, kind="stable")
            first = np.flatnonzero(np.diff(ids[order], prepend=-1))
            context[ids[order[first]]] += np.add.reduceat(around[order], first, axis=0)
    length = np.linalg.norm(context, axis=1, keepdims=True)
    return (index + np.divide(context, length, out=np.zeros_like(context), where=length > 0)).astype(np.float32)


def fit(texts: list[str], labels, rounds: int = 400, seed: int = 5) -> QualityModel:
    """Fits vectors, network and temperature on the rows given; with no rows or one class the prior is returned."""
    y = np.asarray(labels, dtype=float)
    width = 3 * DIMENSIONS
    rng = np.random.default_rng(seed)
    prior = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    model = QualityModel(word_vectors(texts), np.zeros(width), np.ones(width), rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(prior / (1 - prior))), 1.0)
    if len(set(y.tolist())) < 2:
        return model
    x = np.stack([model.pooled(t) for t in texts])
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    held = np.arange(len(y)) % 5 == 0 if len(y) >= 50 else np.ones(len(y), dtype=bool)
    fitted = ~held if len(y) >= 50 else held
    z, t = (x[fitted] - model.mean) / model.scale, y[fitted]
    p = {"w1": model.w1, "b1": model.b1, "w2": rng.normal(0, HIDDEN**-0.5, HIDDEN), "b2": np.array(model.b2)}
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for i in range(1, rounds + 1):
        h = np.tanh(z @ p["w1"] + p["b1"])
        err = (1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"], -500, 500))) - t) / len(t)
        back = np.outer(err, p["w2"]) * (1 - h * h)
        grad = {"w1": z.T @ back + 1e-4 * p["w1"], "b1": back.sum(axis=0), "w2": h.T @ err + 1e-4 * p["w2"], "b2": np.array(err.sum())}
        for k, g in grad.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p[k] = p[k] - 0.02 * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.999**i)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = p["w1"], p["b1"], p["w2"], float(p["b2"])
    logits, t = model.logits(x[held]), y[held]

    def loss(temperature: float) -> float:
        s = np.where(t == 1, 1, -1) * logits / temperature
        return float(np.logaddexp(0, -s).mean())

    model.temperature = min(np.geomspace(0.5, 5, 60).tolist(), key=loss)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, usable, id_col: str = "doc_id", text_col: str = "text", limits: dict | None = None) -> tuple[pd.DataFrame, float]:
    """At most so many labelled rows (text, label) as ``limits`` has for each label, by a hash of the id; and the shift of their log odds.

    The shift is what the log odds of the sample's classes lack against those of all usable labels, so that scores mean the
    same however many rows there are. The ids are chosen from the labels alone; their number bounds what is broadcast and
    collected. Null labels are left out; of repeated labels the largest counts; of repeated documents one text is taken.
    """
    chosen, limits = None, limits or {0: MAX_TRAINING_ROWS // 2, 1: MAX_TRAINING_ROWS // 2}
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & usable).groupBy(F.col(id_col).alias("t_id")).agg(F.max(label_col).cast("int").alias("t_label"))
    for label, most in limits.items():
        part = known.where(F.col("t_label") == label).orderBy(F.xxhash64("t_id"), "t_id").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select(F.col(id_col).alias("t_id"), F.col(text_col).cast("string").alias("t_text"))
    pairs = texts.join(F.broadcast(chosen), "t_id").groupBy("t_id", "t_label").agg(F.max("t_text").alias("t_text"))
    counts = {r["t_label"]: r["n"] for r in known.groupBy("t_label").agg(F.count("*").alias("n")).where(F.col("t_label").isin(0, 1)).collect()}
    all_ = [counts.get(k, 0) for k in (0, 1)]
    taken = [min(n, limits[k]) for k, n in enumerate(all_)]
    shift = float(np.log(all_[1] / all_[0]) - np.log(taken[1] / taken[0])) if min(all_) else 0.0
    return pairs.select("t_id", "t_text", "t_label").toPandas().sort_values("t_id", ignore_index=True), shift


def remainder(id_col: str, by: int):
    """crc32(id as text) mod ``by``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % by


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5) -> QualityModel:
    """A model of the labels whose id does not fall into fold 0; rows of a rare class are all taken up to half the bound."""
    rows, shift = training_rows(docs, labels, label_col, remainder(id_col, folds) != 0, id_col, text_col)
    model = fit(rows["t_text"].fillna("").tolist(), rows["t_label"].tolist())
    model.shift = shift
    return model


def with_score(docs: DataFrame, model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """Adds the score of each whole text, row by row, in place of an existing ``out_col``; null and empty texts have a score too. ids, ties, repeated rows and other columns do not matter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        worker_state(("quality",), dict)
        return pd.Series(shared.value.score(texts), dtype="float64")

    return docs.withColumn(out_col, run(F.col(text_col).cast("string")))
