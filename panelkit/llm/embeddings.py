"""Embedding near-duplicates by lattice hashing.

Random projections to eight dimensions are decoded to the nearest point of the E8 lattice, in several
tables. A vector is stored in its own cell and looks into the nearest neighbouring cells. Rows of a cell
are kept where some other row there has a close sign sketch, cells are cut into blocks of bounded size, and
cosines are verified block by block in double precision; a block returns a forest of its links, not its
pairs. All links of a component lie inside it, so the links of each vector are counted by one more pass
over blocks of components.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm._common import cut
from panelkit.llm._graph import components

#: Tables, neighbouring cells looked into, scale of the projections in lattice units, rows of a block.
TABLES, PROBES, SCALE, BLOCK = 16, 5, 1.0, 512
#: Bits of the sign sketch; at the threshold's angle more than SLACK standard deviations too many are no match.
SKETCH, SLACK = 128, 6.0


def lattice_points(x: np.ndarray, most: int) -> np.ndarray:
    """The nearest E8 points of each row and some of the next ones by distance: (rows, most, 8), doubled to integers."""
    points, far = [], []
    rows = np.arange(len(x))
    for shift in (0.0, 0.5):
        near = np.rint(x - shift)
        off = x - shift - near
        worst = np.argsort(-np.abs(off), axis=1, kind="stable")
        step = np.where(off >= 0, 1.0, -1.0)
        odd = near.sum(axis=1) % 2 != 0
        for one, two in (((0,), ()), ((1,), (0, 1)), ((2,), (0, 2)), ((3,), (1, 2))):
            moved = near.copy()
            for use, places in ((odd, one), (~odd, two)):
                for p in places:
                    moved[rows[use], worst[use, p]] += step[rows[use], worst[use, p]]
            points.append(moved + shift)
            far.append(((x - moved - shift) ** 2).sum(axis=1))
    order = np.argsort(np.stack(far, axis=1), axis=1, kind="stable")[:, :most]
    return np.rint(2 * np.take_along_axis(np.stack(points, axis=1), order[:, :, None], axis=1)).astype(np.int64)


class Hasher:
    """Projections for one dimension of vectors; the same on every worker."""

    def __init__(self, width: int, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = 3) -> None:
        rng = np.random.default_rng([seed, width])
        self.planes = rng.normal(size=(width, 8 * tables)) * scale
        self.offset = rng.uniform(0, 2, 8 * tables)
        self.signs = rng.normal(size=(width, SKETCH))
        self.mixer = rng.integers(1, 2**63, 8, dtype=np.int64) | 1
        self.base = rng.integers(-(2**62), 2**62, tables, dtype=np.int64) ^ xxhash.xxh64_intdigest(str(width)) >> 1
        self.tables, self.probes = tables, probes

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables, 1 + probes): cell keys, the own cell first."""
        x = unit @ self.planes + self.offset
        out = np.empty((len(unit), self.tables, 1 + self.probes), dtype=np.int64)
        for t in range(self.tables):
            cells = lattice_points(x[:, 8 * t : 8 * t + 8], 1 + self.probes)
            mixed = (cells * self.mixer).sum(axis=2).view(np.uint64)
            mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            out[:, t] = (mixed ^ mixed >> np.uint64(32)).view(np.int64) ^ self.base[t]
        return out

    def sketches(self, unit: np.ndarray) -> np.ndarray:
        return np.packbits(unit @ self.signs > 0, axis=1).view(">i8").astype(np.int64)


_hashers: dict[int, Hasher] = {}


def hasher(width: int) -> Hasher:
    if width not in _hashers:
        _hashers[width] = Hasher(width)
    return _hashers[width]


def units(vectors) -> np.ndarray:
    """Vectors of one width at length 1, in double precision."""
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cells(reps: DataFrame) -> DataFrame:
    def run(batches):
        for pdf in batches:
            for width, part in pdf.groupby(pdf["embedding"].map(len), sort=False):
                for at in range(0, len(part), 512):
                    rows = part.iloc[at : at + 512]
                    unit, h = units(rows["embedding"]), hasher(int(width))
                    keys = h.keys(unit)
                    sketch = np.repeat(h.sketches(unit), keys[0].size, axis=0)
                    own = np.zeros(keys.shape, dtype=bool)
                    own[:, :, 0] = True
                    out = pd.DataFrame({"key": keys.ravel(), "node": np.repeat(rows["node"].to_numpy(), keys[0].size), "own": own.ravel(), "x": sketch[:, 0], "y": sketch[:, 1]})
                    yield out.drop_duplicates(["key", "node"])

    return reps.select("node", "embedding").mapInPandas(run, "key long, node long, own boolean, x long, y long")


def _in_blocks(members: DataFrame) -> DataFrame:
    """(key, node) -> (key, i, j, side, node): every two rows of a key meet in one block pair of bounded size."""
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = members.join(sizes, "key").withColumn("parts", parts).withColumn("b", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.select("key", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), F.col("b").alias("side"), "node")


def _by_block(blocks: DataFrame, vectors: DataFrame, each, schema: str) -> DataFrame:
    """Runs each(nodes, copies, units, side, i, j) over the block pairs, streamed in order of their key."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        held: list[pd.DataFrame] = []

        def close(pdf: pd.DataFrame) -> list[tuple]:
            i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
            return each(pdf["node"].to_numpy(), pdf["copies"].to_numpy(), units(pdf["embedding"]), pdf["side"].to_numpy(), i, j)

        last = None
        for pdf in batches:
            marks = pdf[["key", "i", "j"]].to_numpy()
            edges = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(pdf)]
            out: list[tuple] = []
            for a, b in zip(edges, edges[1:], strict=False):
                part, mark = pdf.iloc[a:b], tuple(marks[a])
                if mark != last and held:
                    out += close(pd.concat(held) if len(held) > 1 else held[0])
                    held = []
                last = mark
                held.append(part)
            if out:
                yield pd.DataFrame(out, columns=names)
        if held and (out := close(pd.concat(held))):
            yield pd.DataFrame(out, columns=names)

    rows = blocks.join(vectors, "node").select("key", "i", "j", "side", "node", "copies", "embedding")
    count = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(count, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInPandas(run, schema)


def _forest(threshold: float):
    def each(nodes, copies, unit, side, i, j):
        if len(nodes) < 2:
            return []
        root = np.arange(len(nodes))
        for a in range(0, len(nodes), 1024):
            close = unit[a : a + 1024] @ unit.T >= threshold
            for k in range(len(close)):
                linked = np.flatnonzero(close[k])
                roots = np.unique(root[np.append(linked, a + k)])
                if len(roots) > 1:
                    root[np.isin(root, roots)] = roots[0]
        return [(int(nodes[k]), int(nodes[r])) for k, r in enumerate(root) if k != r]

    return each


def _counts(threshold: float):
    def each(nodes, copies, unit, side, i, j):
        left, right = (np.flatnonzero(side == s) for s in (i, j))
        if i == j:
            left = right = np.arange(len(nodes))
        out: list[tuple] = []
        close = unit[left] @ unit[right].T >= threshold
        if i == j:
            np.fill_diagonal(close, False)
            return list(zip(nodes.tolist(), (close @ copies).tolist(), strict=True))
        out += zip(nodes[left].tolist(), (close @ copies[right]).tolist(), strict=True)
        out += zip(nodes[right].tolist(), (close.T @ copies[left]).tolist(), strict=True)
        return out

    return each


def linked(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """One row for each input row: ``id_col``, n_links, component_id, kept.

    Rows with equal vectors collapse to one before anything is compared and count as links of each other.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are
    components of their own; vectors of different widths never link. A null id is never a smallest id. An
    empty table gives an empty table; other columns are not read.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    fine = F.expr("embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)")
    good = rows.where(fine)
    reps = good.groupBy("embedding").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    reps = cut(reps.withColumn("node", F.monotonically_increasing_id()))
    angle = float(np.arccos(min(1.0, threshold)) / np.pi)
    most = int(SKETCH * angle + SLACK * np.sqrt(SKETCH * angle * (1 - angle)) + 1)
    cells = cut(_cells(reps))
    other = cells.select(F.col("key").alias("k"), F.col("node").alias("n"), F.col("own").alias("o"), F.col("x").alias("u"), F.col("y").alias("v"))
    near = (F.col("key") == F.col("k")) & (F.col("node") != F.col("n")) & (F.col("own") | F.col("o")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("u"))) + F.bit_count(F.col("y").bitwiseXOR(F.col("v"))) <= most)
    members = cut(cells.join(other, near, "left_semi").select("key", "node"))
    codes = reps.select("node", "copies", "embedding")
    edges = _by_block(_in_blocks(members), codes, _forest(threshold), "a long, b long")
    roots = cut(components(edges).select("node", F.col("root").alias("key")))
    links = _by_block(_in_blocks(roots), codes, _counts(threshold), "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    classes = reps.join(roots, "node", "left").join(links, "node", "left").select("node", "embedding", "copies", "least", F.coalesce("key", "node").alias("root"), F.coalesce("n", F.lit(0)).alias("n"))
    smallest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    known = classes.join(smallest, "root").select("embedding", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id")
    out = good.join(known, "embedding").select("id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(fine, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
