"""Linear models, fixed effects, clustered and resampled inference.

Rows are only summed on executors: cross products, scores per cluster, replicate totals. What reaches the driver is
k x k for k regressors, and solved there.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.operators._names import spare
from panelkit.operators._state import checkpointed, removed, scratch, written
from panelkit.operators.ranges import dense_ranks, in_ranges, running

#: Rows of a stratum that lie in one block of a permutation test.
STRATUM_BLOCK = 1 << 17
#: Levels of effects across clusters that a wild bootstrap takes as regressors.
MAX_DUMMIES = 100
#: Scores that one batch of bootstrap draws of a ranking takes.
SCORES_PER_BATCH = 256


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    out = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_p_value(t: float, df: float) -> float:
    """Two-sided."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if df > 0 and np.isfinite(t) else float("nan")


def f_p_value(f: float, d1: float, d2: float) -> float:
    return 1 - incomplete_beta(d1 / 2, d2 / 2, d1 * f / (d1 * f + d2)) if d2 > 0 and np.isfinite(f) else float("nan")


def gram(df: DataFrame, columns: list[str], weight: str | None = None) -> tuple[np.ndarray, int]:
    """Cross products of the columns over all rows, and the number of rows; one aggregate of k (k + 1) / 2 sums."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    x = [F.col(c).cast("double") for c in columns]
    cells = [F.sum(w * x[i] * x[j]).alias(f"g{i}_{j}") for i in range(len(x)) for j in range(i + 1)]
    row = df.agg(F.count("*").alias("n"), *cells).first()
    out = np.zeros((len(x), len(x)))
    for i in range(len(x)):
        for j in range(i + 1):
            out[i, j] = out[j, i] = row[f"g{i}_{j}"] or 0.0
    return out, row["n"]


def summed(df: DataFrame, f, size: int) -> np.ndarray:
    """Sums over all rows of f(matrix of a batch), a vector of that size; a partition sends one vector."""

    def run(batches):
        out = np.zeros(size)
        for pdf in batches:
            if len(pdf):
                out += f(pdf.to_numpy(dtype=np.float64))
        yield pd.DataFrame({"i": range(size), "v": out})

    out = np.zeros(size)
    for r in df.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


def independent_columns(g: np.ndarray, tolerance: float = 1e-9) -> list[int]:
    """Columns of a cross product that don't follow from the ones before them (Cholesky on the scaled matrix, in order)."""
    scale = np.sqrt(np.where(np.diag(g) > 0, np.diag(g), 1.0))
    a = g / scale / scale[:, None]
    kept: list[int] = []
    for j in range(len(a)):
        if g[j, j] <= 0:
            continue
        rest = a[j, j] - (a[j, kept] @ np.linalg.solve(a[np.ix_(kept, kept)], a[kept, j]) if kept else 0.0)
        if rest > tolerance:
            kept.append(j)
    return kept


def solve(g: np.ndarray, b: np.ndarray) -> np.ndarray:
    scale = np.sqrt(np.diag(g))
    return np.linalg.solve(g / scale / scale[:, None], b / scale) / scale


@dataclass
class Fit:
    """A linear fit: ``rows`` hold the variables net of fixed effects (_y, _x0, ...), residual _e and the clusters."""

    rows: DataFrame
    terms: list[str]
    beta: np.ndarray
    inverse: np.ndarray
    n: int
    absorbed: int
    dropped: list[str] = field(default_factory=list)
    #: Absorbed when levels inside one cluster are left out: an effect nested in the clusters counts as one level.
    apart: int = 0

    def x(self) -> list[str]:
        return [f"_x{i}" for i in range(len(self.terms))]


def gram_ols(df: DataFrame, y: str, x: list[str], keep: list[str] | None = None) -> dict[str, float]:
    """Coefficients (with an intercept, "(Intercept)") from one cross product; dropped columns get 0, a dropped column of ``keep`` raises.

    Columns go in order: one that follows from those before it is dropped. Rows with a null are left out.
    """
    (one,) = spare(df, "one")
    names = ["(Intercept)", *x]
    g, _ = gram(df.dropna(subset=[y, *x]).withColumn(one, F.lit(1.0)), [one, *x, y])
    kept = independent_columns(g[:-1, :-1])
    lost = [n for i, n in enumerate(names) if i not in kept]
    if set(lost) & set(keep or []):
        raise ValueError(f"{sorted(set(lost) & set(keep))} can't be estimated")
    beta = solve(g[np.ix_(kept, kept)], g[kept, -1])
    return dict.fromkeys(names, 0.0) | {names[i]: float(b) for i, b in zip(kept, beta, strict=True)}


def demean(df: DataFrame, columns: list[str], effects: list[str], tolerance: float = 1e-13, rounds: int = 2000) -> DataFrame:
    """The columns (without nulls) net of the effects: of the means of one effect, of the least squares fit on the levels of several.

    Rows are read for the grand means, for sums per level or cell of levels, and for the join of what each level takes out,
    however many rounds several effects need: those run on the table of cells (``level_effects``). Frequent levels combine
    on the map side. Null levels count as a level.
    """
    grand = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    out = df.withColumns({c: F.col(c).cast("double") - F.lit(float(grand[c] or 0.0)) for c in columns})
    if len(effects) == 1:
        takes = [out.groupBy(F.col(effects[0]).alias("level")).agg(*[F.avg(c).alias(f"a{j}") for j, c in enumerate(columns)])]
    else:
        takes = level_effects(out, columns, effects, tolerance, rounds) if effects else []
    for e, take in zip(effects, takes, strict=True):
        level, *own = spare(out, "level", *[f"a{j}" for j in range(len(columns))])
        take = take.select(F.col("level").alias(level), *[F.col(f"a{j}").alias(a) for j, a in enumerate(own)])
        out = out.join(take, F.col(e).eqNullSafe(F.col(level))).withColumns({c: F.col(c) - F.col(a) for c, a in zip(columns, own, strict=True)}).drop(level, *own)
    return out


def level_graph(df: DataFrame, columns: list[str], effects: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Levels and cells of effects, as checkpointed tables from one aggregate of the rows.

    Levels, one table for each effect: level, id, d (rows), r0, r1, ... (sums of the columns), q0, q1, ... (of their squares).
    Cells: n (rows), i0, i1, ... (ids of the levels that meet there).
    """
    k, m = range(len(columns)), range(len(effects))
    sums = [F.sum(c).alias(f"r{j}") for j, c in enumerate(columns)] + [F.sum(F.col(c) * F.col(c)).alias(f"q{j}") for j, c in enumerate(columns)]
    cells = checkpointed(df.groupBy(*[F.col(e).alias(f"l{i}") for i, e in enumerate(effects)]).agg(F.count("*").alias("n"), *sums))
    carried = [F.sum(f"{v}{j}").alias(f"{v}{j}") for v in "rq" for j in k]
    levels = [checkpointed(cells.groupBy(F.col(f"l{i}").alias("level")).agg(F.sum("n").alias("d"), *carried).withColumn("id", F.monotonically_increasing_id())) for i in m]
    graph = cells.select("n", *[f"l{i}" for i in m])
    for i in m:
        ids = levels[i].select(F.col("level").alias("other"), F.col("id").alias(f"i{i}"))
        graph = graph.join(ids, F.col(f"l{i}").eqNullSafe(F.col("other"))).drop("other", f"l{i}")
    return levels, checkpointed(graph)


def level_effects(df: DataFrame, columns: list[str], effects: list[str], tolerance: float = 1e-13, rounds: int = 2000) -> list[DataFrame]:
    """Least squares of each column on the levels of all effects: for each effect (level, a0, a1, ...), whose sums are the fit.

    Conjugate gradients with the levels' sizes as weights, all columns at once. A round sends each level's direction to its
    cells and sums it back per level; k numbers reach the driver. A column ends where the levels' means of its residual have
    ``tolerance`` of its spread; a graph whose parts hang on few cells takes more rounds. Raises where the rounds are used up.
    """
    k, m = range(len(columns)), range(len(effects))
    levels, graph = level_graph(df, columns, effects)

    def numbers(frame: DataFrame, cells: list[Column]) -> np.ndarray:
        return np.array([v or 0.0 for v in frame.agg(*[F.sum(c).alias(f"v{j}") for j, c in enumerate(cells)]).first()])

    spread = numbers(levels[0], [F.col(f"q{j}") for j in k])
    start = [F.col("d").cast("double").alias("d"), *[F.lit(0.0).alias(f"x{j}") for j in k], *[F.col(f"r{j}") for j in k], *[(F.col(f"r{j}") / F.col("d")).alias(f"p{j}") for j in k]]
    state = levels[0].select(F.lit(0).alias("e"), "id", *start)
    for i in m[1:]:
        state = state.unionByName(levels[i].select(F.lit(i).alias("e"), "id", *start))
    state = checkpointed(state)
    left = numbers(state, [F.col(f"r{j}") * F.col(f"r{j}") / F.col("d") for j in k])
    live, used = left > tolerance**2 * spread, 0
    while live.any():
        if used == rounds:
            raise ArithmeticError(f"effects {effects} are not absorbed after {rounds} rounds")
        used += 1
        met = graph
        for i in m:
            met = met.join(state.where(F.col("e") == i).select(F.col("id").alias(f"i{i}"), *[F.col(f"p{j}").alias(f"p{i}_{j}") for j in k]), f"i{i}")
        ends = F.inline(F.array(*[F.struct(F.lit(i).alias("e"), F.col(f"i{i}").alias("id")) for i in m]))
        back = met.select(ends, *[(F.col("n") * sum((F.col(f"p{i}_{j}") for i in m[1:]), F.col(f"p0_{j}"))).alias(f"t{j}") for j in k])
        step = written(state.join(back.groupBy("e", "id").agg(*[F.sum(f"t{j}").alias(f"t{j}") for j in k]), ["e", "id"]), "effects")
        curve = numbers(step, [F.col(f"p{j}") * F.col(f"t{j}") for j in k])
        along = np.where(live & (curve > 0), left / np.where(curve > 0, curve, 1.0), 0.0)
        rest = [F.col(f"r{j}") - F.lit(float(along[j])) * F.col(f"t{j}") for j in k]
        now = numbers(step, [c * c / F.col("d") for c in rest])
        turn = np.where(live & (left > 0), now / np.where(left > 0, left, 1.0), 0.0)
        left, live = now, live & (curve > 0) & (now > tolerance**2 * spread)
        state = step.select("e", "id", "d", *[(F.col(f"x{j}") + F.lit(float(along[j])) * F.col(f"p{j}")).alias(f"x{j}") for j in k], *[rest[j].alias(f"r{j}") for j in k], *[(rest[j] / F.col("d") + F.lit(float(turn[j])) * F.col(f"p{j}")).alias(f"p{j}") for j in k])
    return [levels[i].select("level", "id").join(state.where(F.col("e") == i).select("id", *[F.col(f"x{j}").alias(f"a{j}") for j in k]), "id").drop("id") for i in m]


def level_components(df: DataFrame, one: str, two: str) -> int:
    """Connected parts of the graph whose points are the levels of two effects and whose links are the cells with rows.

    Labels go down to the smallest in reach: over the cells, then to the label of the label, until none changes.
    """
    levels, graph = level_graph(df, [], [one, two])
    links = graph.select(F.col("i0").alias("a"), (-1 - F.col("i1")).alias("b"))
    links = checkpointed(links.union(links.select("b", "a")))
    labels = checkpointed(levels[0].select(F.col("id").alias("a"), F.col("id").alias("c")).union(levels[1].select((-1 - F.col("id")).alias("a"), (-1 - F.col("id")).alias("c"))))
    while True:
        near = links.join(labels.select(F.col("a").alias("b"), F.col("c").alias("o")), "b").groupBy("a").agg(F.min("o").alias("o"))
        low = written(labels.join(near, "a").select("a", F.least("c", "o").alias("n"), "c"), "parts")
        over = low.select(F.col("a").alias("n"), F.col("n").alias("nn"))
        low = written(low.join(over, "n").select("a", F.least("n", "nn").alias("n"), "c"), "parts")
        changed = low.where("n <> c").count()
        labels = low.select("a", F.col("n").alias("c"))
        if not changed:
            return labels.where("a = c").count()


def fit(df: DataFrame, y: str, x: list[str], effects: list[str] | None = None, clusters: list[str] | None = None, exact: bool = False) -> Fit:
    """Least squares with absorbed effects (or an intercept); rows with a null in any variable are left out.

    A regressor that follows from those before it is dropped. Absorbed counts the intercept, or the levels of the effects
    less one for each after the first; apart does the same with effects nested in a cluster counted as one level each.
    ``exact`` takes one off for each further part into which the levels of the first two effects fall; effects after these
    still lose one each.
    """
    effects, clusters = effects or [], clusters or []
    rows = df.dropna(subset=[y, *x, *effects, *clusters])
    inner = ["_y", *[f"_x{i}" for i in range(len(x))]]
    rows = rows.select(F.col(y).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(x)], *[F.col(e).alias(f"_f{i}") for i, e in enumerate(effects)], *[F.col(c).alias(f"_c{i}") for i, c in enumerate(clusters)])
    names = [f"_f{i}" for i in range(len(effects))]
    absorbed = apart = 1
    if names:
        counts = [_levels(rows, n, [f"_c{i}" for i in range(len(clusters))]) for n in names]
        absorbed, apart = (sum(c) - (len(names) - 1) for c in zip(*counts, strict=True))
        if exact and len(names) > 1:
            more = max(level_components(rows, *names[:2]) - 1, 0)
            absorbed, apart = absorbed - more, apart - (more if counts[0][0] == counts[0][1] and counts[1][0] == counts[1][1] else 0)
    net = demean(rows, inner, names)
    g, n = gram(net, [*inner[1:], "_y"])
    raw = np.array([v or 0.0 for v in rows.agg(*[F.var_pop(c) for c in inner[1:]]).first()]) * n if x else np.zeros(0)
    kept = [i for i in independent_columns(g[:-1, :-1]) if g[i, i] > 1e-10 * max(raw[i], 1e-300)]
    a = g[np.ix_(kept, kept)]
    beta = solve(a, g[kept, -1]) if kept else np.zeros(0)
    inverse = np.column_stack([solve(a, e) for e in np.eye(len(kept))]) if kept else np.zeros((0, 0))
    e = F.col("_y")
    for i, b in zip(kept, beta, strict=True):
        e = e - F.lit(float(b)) * F.col(f"_x{i}")
    out = net.select(*[F.col(f"_x{i}").alias(f"_x{j}") for j, i in enumerate(kept)], "_y", e.alias("_e"), *[f"_f{i}" for i in range(len(effects))], *[f"_c{i}" for i in range(len(clusters))])
    return Fit(out, [x[i] for i in kept], beta, inverse, n, absorbed, [c for i, c in enumerate(x) if i not in kept], apart)


def _levels(rows: DataFrame, effect: str, clusters: list[str]) -> tuple[int, int]:
    """Levels of an effect; and the number that counts in clustered errors, 1 where each level lies in one cluster of any of the clusterings."""
    ends = [f(c).alias(f"{c}{i}") for c in clusters for i, f in enumerate((F.min, F.max))]
    levels = rows.groupBy(effect).agg(F.count("*").alias("n"), *ends)
    row = levels.agg(F.count("*").alias("n"), *[F.count(F.when(F.col(f"{c}0") != F.col(f"{c}1"), 1)).alias(c) for c in clusters]).first()
    return row["n"], 1 if any(row[c] == 0 for c in clusters) else row["n"]


def cluster_meat(f: Fit, by: list[str]) -> tuple[np.ndarray, int]:
    """Sum over clusters of the outer product of their scores, and the number of clusters; two aggregates."""
    scores = f.rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(F.col(c) * F.col("_e")).alias(f"s{i}") for i, c in enumerate(f.x())])
    return gram(scores, [f"s{i}" for i in range(len(f.terms))])


def cluster_variance(f: Fit, by: list[str], least: int | None = None) -> tuple[np.ndarray, int]:
    """CR1: (G / (G - 1)) ((N - 1) / (N - k - apart)) A^-1 M A^-1; ``least`` stands for G where it is given."""
    meat, own = cluster_meat(f, by)
    g = own if least is None else least
    scale = g / (g - 1) * (f.n - 1) / (f.n - len(f.terms) - f.apart) if g > 1 else float("nan")
    return scale * f.inverse @ meat @ f.inverse, own


def iid_variance(f: Fit) -> np.ndarray:
    total = f.rows.agg(F.sum(F.col("_e") * F.col("_e"))).first()[0] or 0.0
    return f.inverse * total / (f.n - len(f.terms) - f.absorbed)


def twoway_variance(f: Fit, one: str, two: str) -> tuple[np.ndarray, int]:
    """V1 + V2 - V12, all with the smallest number of clusters in their correction, and that number; not forced to be positive."""
    least = min(f.rows.agg(F.countDistinct(one), F.countDistinct(two)).first())
    v1, v2, v12 = (cluster_variance(f, by, least)[0] for by in ([one], [two], [one, two]))
    return v1 + v2 - v12, least


SCHEMA = "term string, estimate double, std_error double, t_value double, p_value double, n long, n_clusters long, dropped int"


def coefficient_rows(spark, f: Fit, v: np.ndarray, g: int) -> DataFrame:
    rows = []
    for i, term in enumerate(f.terms):
        se = float(np.sqrt(v[i, i])) if v[i, i] >= 0 else float("nan")
        t = float(f.beta[i]) / se if se else float("nan")
        rows.append((term, float(f.beta[i]), se, t, t_p_value(t, g - 1), f.n, g, 0))
    rows += [(term, None, None, None, None, f.n, g, 1) for term in f.dropped]
    return spark.createDataFrame(rows, SCHEMA)


def ols_fe(df: DataFrame, y: str, x: list[str], fe: list[str] | None = None, cluster: list[str] | str | None = None, count_nested: bool = False, exact_levels: bool = False) -> DataFrame:
    """One row per regressor: estimate, standard error, t, p (t with G - 1 degrees), n, clusters; collinear ones are reported as dropped.

    ``fe`` are absorbed; a name "a^b" means the cells of a and b. One cluster gives CR1 errors, two give two-way errors, none
    the homoskedastic ones. Effects nested in a cluster don't count in the correction of clustered errors unless
    ``count_nested`` says so, and two-way errors take the smaller number of clusters in all parts. ``exact_levels`` counts
    the levels of effects that fall into unconnected parts exactly, which takes further rounds over the table of cells.
    """
    fe = fe or []
    cells = {e: F.concat_ws("^", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in e.split("^")]) for e in fe if "^" in e}
    names = {e: f"_cell{i}" for i, e in enumerate(cells)}
    rows = df.withColumns({names[e]: c for e, c in cells.items()}) if cells else df
    by = [cluster] if isinstance(cluster, str) else list(cluster or [])
    f = fit(rows, y, x, [names.get(e, e) for e in fe], by, exact_levels)
    if count_nested:
        f.apart = f.absorbed
    if len(by) == 2:
        v, g = twoway_variance(f, "_c0", "_c1")
    elif by:
        v, g = cluster_variance(f, ["_c0"])
    else:
        v, g = iid_variance(f), f.n - len(f.terms) - f.absorbed + 1
    return coefficient_rows(df.sparkSession, f, v, g)


def ols_joint_test(df: DataFrame, y: str, x: list[str], restrictions: dict[str, tuple[dict[str, float], float]], fe: list[str] | None = None, cluster: str | None = None) -> DataFrame:
    """Wald tests with the clustered variance: one row for each linear restriction (name: weights of terms, value) and one, "joint", for all.

    A restriction on a term that can't be estimated has nulls and is no part of the joint test, whose df1 counts those that are.
    """
    f = fit(df, y, x, fe, [cluster] if cluster else [])
    v, g = cluster_variance(f, ["_c0"]) if cluster else (iid_variance(f), f.n - len(f.terms) - f.absorbed + 1)
    at = {t: i for i, t in enumerate(f.terms)}
    told = {name: r for name, r in restrictions.items() if set(r[0]) <= set(at)}
    r = np.zeros((len(told), len(f.terms)))
    q = np.array([value for _, value in told.values()])
    for k, (weights, _) in enumerate(told.values()):
        for term, w in weights.items():
            r[k, at[term]] = w
    gap = r @ f.beta - q
    rows = [(name, None, None, 1, None) for name in restrictions if name not in told]
    for k, name in enumerate(told):
        stat = float(gap[k] ** 2 / (r[k] @ v @ r[k]))
        rows.append((name, float(gap[k]), stat, 1, f_p_value(stat, 1, g - 1)))
    if len(restrictions) > 1 and not told:
        rows.append(("joint", None, None, 0, None))
    elif len(restrictions) > 1:
        stat = float(gap @ np.linalg.solve(r @ v @ r.T, gap) / len(q))
        rows.append(("joint", None, stat, len(q), f_p_value(stat, len(q), g - 1)))
    return df.sparkSession.createDataFrame(rows, "restriction string, gap double, f_value double, df1 int, p_value double")


def export_estimates(models: dict[str, tuple[DataFrame, str, str]], confidence_t: float = 1.959963984540054) -> DataFrame:
    """A tidy manifest of results of ``ols_fe`` (model: result, outcome, measure): model, term, estimate, std_error, p_value, ci_low, ci_high, nobs, dep_var, measure."""
    out = None
    for model, (result, outcome, measure) in models.items():
        rows = result.where("dropped = 0").select(
            F.lit(model).alias("model"), "term", "estimate", "std_error", "p_value", (F.col("estimate") - confidence_t * F.col("std_error")).alias("ci_low"), (F.col("estimate") + confidence_t * F.col("std_error")).alias("ci_high"),
            F.col("n").alias("nobs"), F.lit(outcome).alias("dep_var"), F.lit(measure).alias("measure"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def _coded(df: DataFrame, effects: list[str]) -> tuple[DataFrame, list[str]]:
    """The rows with a whole number for each effect's level, null for none, and the names of these columns.

    Whole numbers stand for themselves and a number beyond them for null; other levels are numbered in a table.
    """
    whole = [e for e, (_, kind) in zip(effects, df.select(*effects).dtypes, strict=True) if kind in ("tinyint", "smallint", "int", "bigint")]
    ends = df.agg(F.lit(0), *[f(F.col(e).cast("long")) for e in whole for f in (F.min, F.max)]).first()
    codes, low, high = spare(df, *[f"e{i}" for i in range(len(effects))]), dict(zip(whole, ends[1::2], strict=True)), dict(zip(whole, ends[2::2], strict=True))
    rows = df
    for e, c in zip(effects, codes, strict=True):
        none = 0 if low.get(e) is None else high[e] + 1 if high[e] < 2**63 - 1 else low[e] - 1
        if e in low and none >= -(2**63):
            rows = rows.withColumn(c, F.coalesce(F.col(e).cast("long"), F.lit(none).cast("long")))
        else:
            (v,) = spare(rows, "v")
            levels = written(df.select(F.col(e).alias(v)).distinct().withColumn(c, F.monotonically_increasing_id()), "levels")
            rows = rows.join(levels, F.col(e).eqNullSafe(F.col(v))).drop(v)
    return rows, codes


#: Dropped rows that are sent to every task, at most.
SENT = 100_000


def drop_singletons(df: DataFrame, effects: list[str]) -> DataFrame:
    """Rows left when rows that are alone in a level of any effect are dropped again and again; null levels count as a level.

    Rows are read to count the levels, and at the end. For each level is written how many rows it has and the exclusive or of
    these rows' levels of the other effects: what is left of it when all rows but one are taken out names the last row. So a
    round takes the dropped rows out of their levels only, and what is written besides are dropped rows.
    """
    if not effects:
        return df
    spark = df.sparkSession
    rows, codes = _coded(df, effects)
    state, dropped = scratch(spark, "levels"), scratch(spark, "dropped")

    def others(i: int) -> list[str]:
        return [c for c in codes if c != codes[i]]

    for i, c in enumerate(codes):
        rows.groupBy(c).agg(F.count("*").alias("n"), *[F.bit_xor(o).alias(o) for o in others(i)]).write.parquet(f"{state}/{i}")
    levels = [spark.read.parquet(f"{state}/{i}") for i in range(len(codes))]
    kind, last = ", ".join(f"{c} long" for c in codes), [x.where("n = 1").select(*codes) for x in levels]
    turn = total = 0
    while True:
        reduce(DataFrame.union, last).distinct().write.parquet(f"{dropped}/turn={turn}")
        new = spark.read.schema(kind).parquet(f"{dropped}/turn={turn}").count()
        gone = spark.read.schema(f"{kind}, turn int").parquet(dropped)
        if not new:
            removed(spark, state)
            gone = gone.select(*codes)
            return rows.join(F.broadcast(gone) if total <= SENT else gone, codes, "left_anti").select(*df.columns)
        last, total = [], total + new
        for i, c in enumerate(codes):
            taken = gone.groupBy(c).agg(F.count("*").alias("_n"), F.max("turn").alias("_t"), *[F.bit_xor(o).alias(f"_{o}") for o in others(i)]).where(F.col("_t") == turn)
            left = levels[i].join(F.broadcast(taken) if new <= SENT else taken, c).where("n - _n = 1")
            last.append(left.select(*[F.col(o) if o == c else F.col(o).bitwiseXOR(F.col(f"_{o}")).alias(o) for o in codes]))
        turn += 1


def common_sample(df: DataFrame, specs: list[list[str]], limit: float = 0.1) -> DataFrame:
    """Complete cases over the variables of all specifications; raises where more than ``limit`` of the rows are lost."""
    used = sorted({c for s in specs for c in s})
    kept = df.dropna(subset=used)
    counts = df.agg(F.count("*").alias("n"), F.count(F.when(sum((F.col(c).isNull().cast("int") for c in used), F.lit(0)) == 0, 1)).alias("k")).first()
    if counts["n"] and counts["n"] - counts["k"] > limit * counts["n"]:
        raise ValueError(f"{counts['n'] - counts['k']} of {counts['n']} rows are incomplete")
    return kept


def residual_sd(df: DataFrame, x: str, effects: list[str], controls: list[str] | None = None) -> float:
    """Standard deviation (n - 1) of a regressor net of effects and controls."""
    f = fit(df, x, controls or [], effects)
    row = f.rows.agg(F.sum(F.col("_e") * F.col("_e")).alias("s")).first()
    return math.sqrt((row["s"] or 0.0) / (f.n - 1)) if f.n > 1 else float("nan")


def variance_shares(df: DataFrame, score: str, covariates: list[str]) -> DataFrame:
    """How much of a score's variance covariates explain: r2_main (their levels side by side), r2_cells (means of their cells),
    r2_first (the first alone), within_cells = 1 - r2_cells, n.

    Null levels count as a level, null scores are left out; shares are null where the score doesn't vary.
    """
    (v,) = spare(df, "v")
    rows = df.where(F.col(score).isNotNull()).select(*covariates, F.col(score).cast("double").alias(v))
    total = rows.agg(F.count("*"), F.var_pop(v)).first()
    n, spread = total[0], (total[1] or 0.0) * total[0]

    def explained(by: list[str]) -> float | None:
        within = rows.groupBy(*by).agg((F.var_pop(v) * F.count("*")).alias(v)).agg(F.sum(v)).first()[0]
        return 1 - within / spread if spread > 0 else None

    cells = explained(covariates)
    left = demean(rows, [v], covariates).agg(F.sum(F.col(v) * F.col(v))).first()[0] if spread > 0 and len(covariates) > 1 else None
    main = cells if left is None else 1 - left / spread
    row = (main, cells, explained(covariates[:1]), None if cells is None else 1 - cells, n)
    return df.sparkSession.createDataFrame([row], "r2_main double, r2_cells double, r2_first double, within_cells double, n long")


def gelbach_decompose(df: DataFrame, y: str, focal: str, blocks: dict[str, list[str]]) -> DataFrame:
    """How much of the focal coefficient's change each block of controls accounts for: rows base, full, every block; they add up.

    From one cross product: the block's part is its coefficients in the full fit times the focal slopes of its columns.
    Values are null where there are no complete rows or the focal regressor doesn't vary.
    """
    x = [focal, *[c for b in blocks.values() for c in b]]
    g, n = gram(df.dropna(subset=[y, *x]).withColumn("_one", F.lit(1.0)), ["_one", *x, y])
    if not n or not {0, 1} <= set(independent_columns(g[:-1, :-1])):
        return df.sparkSession.createDataFrame([(part, None) for part in ("base", "full", *blocks)], "part string, value double")
    kept = independent_columns(g[:-1, :-1])
    beta = np.zeros(len(x) + 1)
    beta[kept] = solve(g[np.ix_(kept, kept)], g[kept, -1])
    short = solve(g[:2, :2], g[:2, -1])
    slopes = np.column_stack([solve(g[:2, :2], g[:2, j]) for j in range(len(x) + 1)])[1]
    at, rows = 2, [("base", float(short[1])), ("full", float(beta[1]))]
    for name, columns in blocks.items():
        rows.append((name, float(sum(beta[j] * slopes[j] for j in range(at, at + len(columns))))))
        at += len(columns)
    return df.sparkSession.createDataFrame(rows, "part string, value double")


def _mixed(key: np.ndarray, replicate: int, seed: int) -> np.ndarray:
    """64 mixed bits of a key and a replicate."""
    with np.errstate(over="ignore"):
        x = key.astype(np.int64).view(np.uint64) ^ np.uint64((replicate * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _poisson(key: np.ndarray, replicate: int, seed: int) -> np.ndarray:
    """Poisson(1) weights from a mixed hash of the key, the same in every run and task."""
    x = _mixed(key, replicate, seed)
    cuts = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
    return np.searchsorted(cuts, (x >> np.uint64(11)).astype(np.float64) / 2**53, side="right").astype(np.float64)


def bootstrap_cluster(df: DataFrame, y: str, x: list[str], cluster: str, replicates: int = 199, seed: int = 1) -> DataFrame:
    """Standard errors from resampled clusters: term, estimate, boot_se, n_draws, n_failed; raises where half of the draws fail.

    Clusters draw Poisson(1) weights from a hash of their id. Their cross products are summed once; a task adds up its
    clusters for all replicates in matrices, so no row is copied, and k x k sums per replicate are all that is shuffled.
    """
    names = [f"_v{i}" for i in range(len(x) + 2)]
    rows = df.dropna(subset=[y, *x, cluster]).select(F.lit(1.0).alias("_v0"), *[F.col(c).cast("double").alias(f"_v{i + 1}") for i, c in enumerate(x)], F.col(y).cast("double").alias(names[-1]), F.xxhash64(cluster).alias("_c"))
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    per = rows.groupBy("_c").agg(F.array(*[F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs]).alias("g"))

    def totals(batches):
        out = np.zeros((replicates + 1, len(pairs)))
        for pdf in batches:
            if len(pdf):
                g, keys = np.stack(pdf["g"].to_numpy()), pdf["_c"].to_numpy()
                out[0] += g.sum(axis=0)
                for r in range(1, replicates + 1):
                    out[r] += _poisson(keys, r, seed) @ g
        yield pd.DataFrame({"r": range(replicates + 1), "g": list(out)})

    sums = per.mapInPandas(totals, "r int, g array<double>").groupBy("r").agg(F.array(*[F.sum(F.col("g")[p]) for p in range(len(pairs))]).alias("g"))

    def draws(batches):
        for pdf in batches:
            out = []
            for r, flat in zip(pdf["r"], pdf["g"], strict=True):
                g = np.zeros((k, k))
                for (i, j), v in zip(pairs, flat, strict=True):
                    g[i, j] = g[j, i] = v
                kept = independent_columns(g[:-1, :-1])
                beta = solve(g[:-1, :-1], g[:-1, -1]) if len(kept) == k - 1 else np.full(k - 1, np.nan)
                out += [(r, i, float(b)) for i, b in enumerate(beta)]
            yield pd.DataFrame(out, columns=["r", "i", "b"])

    found = sums.mapInPandas(draws, "r int, i int, b double")
    ok = (F.col("r") > 0) & ~F.isnan("b")
    term = F.array(*[F.lit(t) for t in ["(Intercept)", *x]])
    out = found.groupBy("i").agg(F.max(F.when(F.col("r") == 0, F.col("b"))).alias("estimate"), F.stddev_samp(F.when(ok, F.col("b"))).alias("boot_se"), F.count(F.when(ok, 1)).alias("n_draws"), F.count(F.when((F.col("r") > 0) & F.isnan("b"), 1)).alias("n_failed"))
    abort = F.when(F.col("n_draws") * 2 < replicates, F.raise_error(F.lit("over half of the draws failed")).cast("double")).otherwise(F.col("boot_se"))
    return out.select(F.element_at(term, F.col("i") + 1).alias("term"), "estimate", abort.alias("boot_se"), "n_draws", "n_failed")


# Webb's six-point weights.
WEBB = [-math.sqrt(1.5), -1.0, -math.sqrt(0.5), math.sqrt(0.5), 1.0, math.sqrt(1.5)]


def _webb(key: np.ndarray, replicate: int, seed: int) -> np.ndarray:
    """Webb weights from a mixed hash of the cluster, the same in every run and task."""
    return np.array(WEBB)[(_mixed(key, replicate, seed) >> np.uint64(11)).astype(np.int64) % 6]


class WildDraws:
    """Test statistics of a restricted wild cluster bootstrap under any hypothesis focal = r, from sums over clusters.

    Restricted scores are linear in r: s_g(r) = s0_g - r s1_g. With q = a's (a: the focal row of the inverse) and z = H_g a, a
    draw's statistic needs the sums of w s0, w s1, w q0 z, w q1 z, w w q0 q0, w w q0 q1, w w q1 q1 and, for all draws, z z'. All are
    2 k numbers or fewer a draw, so one pass over the clusters serves every hypothesis.
    """

    def __init__(self, inverse: np.ndarray, at: int, sums: np.ndarray, cross: np.ndarray) -> None:
        k = len(inverse)
        self.inverse, self.at, self.cross = inverse, at, cross
        self.s0, self.s1, self.c0, self.c1 = (sums[:, i * k : (i + 1) * k] for i in range(4))
        self.squares = sums[:, 4 * k :]

    def t(self, r: float) -> np.ndarray:
        """|t| of all draws, the first being the data's own; up to the correction, which is the same for all."""
        shift = (self.s0 - r * self.s1) @ self.inverse
        with np.errstate(divide="ignore", invalid="ignore"):
            square = self.squares @ np.array([1.0, -2.0 * r, r * r]) - 2 * np.einsum("ri,ri->r", self.c0 - r * self.c1, shift) + np.einsum("ri,ij,rj->r", shift, self.cross, shift)
            return np.abs(shift[:, self.at]) / np.sqrt(np.maximum(square, 0.0))

    def p(self, r: float) -> float:
        t = self.t(r)
        return float(np.mean(t[1:] >= t[0] * (1 - 1e-12))) if len(t) > 1 and np.isfinite(t[0]) else float("nan")

    def end(self, start: float, step: float, level: float, reach: int = 60) -> float | None:
        """Where p falls below ``level`` on the way from ``start``: bracketed by doubled steps, then halved; None if it never does."""
        inside, width = start, step
        for _ in range(reach):
            outside = inside + width
            if not self.p(outside) >= level:
                break
            inside, width = outside, 2 * width
        else:
            return None
        for _ in range(60):
            middle = (inside + outside) / 2
            if self.p(middle) >= level:
                inside = middle
            else:
                outside = middle
        return (inside + outside) / 2


def _outer_effects(df: DataFrame, effects: list[str], cluster: str) -> tuple[DataFrame, list[str], list[str]]:
    """The effects nested in the clusters, and for the others 0/1 columns of all levels but the first."""
    inside, dummies = [], {}
    for i, e in enumerate(effects):
        levels, apart = _levels(df.withColumn("_c", F.col(cluster)), e, ["_c"])
        if apart == 1 and levels:
            inside.append(e)
            continue
        if levels > MAX_DUMMIES:
            raise ValueError(f"{e} has over {MAX_DUMMIES} levels and isn't nested in {cluster}")
        for j, r in enumerate(df.select(e).distinct().orderBy(e).collect()[1:]):
            dummies[f"_d{i}_{j}"] = (F.col(e) == F.lit(r[0])).cast("double")
    return df.withColumns(dummies) if dummies else df, inside, list(dummies)


def bootstrap_wild_cluster(df: DataFrame, y: str, x: list[str], focal: str, cluster: str, fe: list[str] | None = None, null: float = 0.0, replicates: int = 9999, seed: int = 1, level: float = 0.95) -> DataFrame:
    """Restricted wild cluster bootstrap-t of focal = null with Webb weights: term, estimate, t_value, boot_p, ci_low, ci_high, n_draws, n_clusters.

    The interval holds the hypotheses that the test, with the same draws, doesn't reject; an end is null where none is rejected on
    that side. Clusters are summed once, weigh in by a hash of their id, and a task adds up its own for all replicates, so
    their number has no bound; the driver gets 4 k + 3 sums a draw. Effects nested in the clusters are absorbed, which changes no draw;
    others, and the intercept, are regressors (over MAX_DUMMIES levels raise). Fewer than two clusters give nulls.
    """
    schema = "term string, estimate double, t_value double, boot_p double, ci_low double, ci_high double, n_draws long, n_clusters long"
    others = [c for c in x if c != focal]
    df, inside, dummies = _outer_effects(df.dropna(subset=[y, *x, *(fe or []), cluster]), fe or [], cluster)
    f = fit(df, y, [*others, *dummies, focal], inside, [cluster])
    if not f.n:
        return df.sparkSession.createDataFrame([(focal, None, None, None, None, None, replicates, 0)], schema)
    if focal in f.dropped:
        raise ValueError(f"{focal} can't be estimated")
    if not inside and f.n:
        k = len(f.terms)
        f.rows, f.terms, f.beta, f.apart = f.rows.withColumn(f"_x{k}", F.lit(1.0)), [*f.terms, "(Intercept)"], np.append(f.beta, 0.0), 0
        f.inverse = np.block([[f.inverse, np.zeros((k, 1))], [np.zeros((1, k)), np.full((1, 1), 1 / f.n)]])
    k, p = len(f.terms), f.terms.index(focal) if focal in f.terms else -1
    cells = [F.sum(F.col(c) * F.col("_y")) for c in f.x()] + [F.sum(F.col(c) * F.col(d)) for c in f.x() for d in f.x()]
    if p < 0:
        return df.sparkSession.createDataFrame([(focal, None, None, None, None, None, 0, 0)], schema)
    per = f.rows.groupBy("_c0").agg(F.array(*cells).alias("v")).select(F.xxhash64("_c0").alias("c"), "v")
    a, inverse = np.linalg.inv(f.inverse), f.inverse
    rest = [i for i in range(k) if i != p]
    # The restricted coefficients are base + r * slope.
    base, slope = np.zeros(k), np.zeros(k)
    slope[p] = 1.0
    if rest:
        own = a[np.ix_(rest, rest)]
        base[rest], slope[rest] = solve(own, (a @ f.beta)[rest]), -solve(own, a[rest, p])
    width = 4 * k + 3

    def totals(batches):
        out, cross, n = np.zeros((replicates + 1, width)), np.zeros((k, k)), 0
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                part = pdf.iloc[at : at + 4096]
                v, keys = np.stack(part["v"].to_numpy()), part["c"].to_numpy()
                h = v[:, k:].reshape(-1, k, k)
                s0, s1 = v[:, :k] - h @ base, h @ slope
                z, q0, q1 = h @ inverse[p], s0 @ inverse[p], s1 @ inverse[p]
                linear = np.column_stack([s0, s1, q0[:, None] * z, q1[:, None] * z])
                square = np.column_stack([q0 * q0, q0 * q1, q1 * q1])
                cross, n = cross + z.T @ z, n + len(part)
                out[0] += np.concatenate([linear.sum(axis=0), square.sum(axis=0)])
                for r in range(1, replicates + 1):
                    w = _webb(keys, r, seed)
                    out[r] += np.concatenate([w @ linear, (w * w) @ square])
        rows = [*out, np.concatenate([cross.ravel(), [n]])]
        if n:
            yield pd.DataFrame({"r": range(len(rows)), "g": rows})

    parts = per.mapInPandas(totals, "r int, g array<double>")
    size = F.when(F.col("r") <= replicates, F.lit(width)).otherwise(F.lit(k * k + 1))
    found = parts.select("r", F.posexplode(F.slice("g", F.lit(1), size)).alias("i", "v")).groupBy("r", "i").agg(F.sum("v").alias("v"))
    sums = np.zeros((replicates + 2, max(width, k * k + 1)))
    got = found.toPandas()
    sums[got["r"], got["i"]] = got["v"]
    g = int(sums[-1, k * k])
    draws = WildDraws(inverse, p, sums[:-1, :width], sums[-1, : k * k].reshape(k, k))
    estimate = float(f.beta[p])
    if g < 2:
        return df.sparkSession.createDataFrame([(focal, estimate, None, None, None, None, replicates, g)], schema)
    v, _ = cluster_variance(f, ["_c0"])
    se = float(np.sqrt(v[p, p]))
    step = se if se > 0 else abs(estimate) or 1.0
    low, high = draws.end(estimate, -step, 1 - level), draws.end(estimate, step, 1 - level)
    row = (focal, estimate, (estimate - null) / se if se > 0 else None, draws.p(null), low, high, replicates, g)
    return df.sparkSession.createDataFrame([row], schema)


def permuted(rank: np.ndarray, n: np.ndarray, key: np.ndarray, replicate: int, seed: int) -> np.ndarray:
    """Where a keyed bijection on 0 .. n - 1 takes each rank: Feistel rounds on the next even power of two, walked on while outside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2)
    out, left = rank.astype(np.int64), np.arange(len(rank))
    while len(left):
        h = half[left]
        mask = (np.int64(1) << h) - 1
        a, b = out[left] >> h, out[left] & mask
        for turn in range(6):
            mixed = _mixed(key[left] ^ (b * 8 + turn), replicate, seed)
            a, b = b, a ^ ((mixed >> np.uint64(20)).astype(np.int64) & mask)
        out[left] = a << h | b
        left = left[out[left] >= n[left]]
    return out


def permute_within_strata(df: DataFrame, key: str, y: str, x: str, stratum: str, replicates: int = 999, seed: int = 1, block: int = STRATUM_BLOCK) -> DataFrame:
    """Slope of y on x net of strata, and the two-sided p = (1 + #) / (R + 1) of x permuted inside strata.

    Only sum(x_perm * y) changes with the permutation. Rows are ranked in their stratum by key once, and laid in blocks of ranks;
    a replicate sends each rank to another by a keyed bijection, so no row is copied or sorted for it. Each block of y meets each
    block of x of its stratum, all replicates are summed there, and R numbers a task are all that is passed on: what is shuffled
    doesn't grow with R. Rows with a null are left out; without rows the slope and p are null.
    """
    rows = demean(df.dropna(subset=[key, y, x, stratum]).select(F.col(key).alias("_k"), F.col(y).alias("_y"), F.col(x).alias("_x"), F.col(stratum).alias("_s")), ["_y", "_x"], ["_s"])
    base = rows.agg(F.sum(F.col("_x") * F.col("_y")).alias("xy"), F.sum(F.col("_x") * F.col("_x")).alias("xx"))
    ranked = dense_ranks(rows, ["_s"], ["_k", "_y", "_x"], "_at")
    held = F.array_sort(F.collect_list(F.struct("_at", "_y", "_x")))
    blocks = ranked.groupBy("_s", F.floor(F.col("_at") / block).alias("_b")).agg(held.alias("h"))
    blocks = checkpointed(blocks.select(F.xxhash64("_s").alias("s"), (F.col("_b") * block).alias("at"), F.transform("h", lambda r: r["_y"]).alias("ys"), F.transform("h", lambda r: r["_x"]).alias("xs")))
    sizes = blocks.groupBy("s").agg(F.sum(F.size("ys")).alias("n"))
    pairs = blocks.select("s", F.col("at").alias("a"), "ys").join(sizes, "s").join(blocks.select("s", F.col("at").alias("b"), "xs"), "s").select("s", "n", "a", "ys", "b", "xs")

    def sums(batches):
        out = np.zeros(replicates)

        def add(part):
            ys, xs = part.column(3).flatten().to_numpy(zero_copy_only=False), part.column(5).flatten().to_numpy(zero_copy_only=False)
            wide, deep = (part.column(c).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for c in (3, 5))
            s, n, a, b = (np.repeat(part.column(c).to_numpy(), wide) for c in (0, 1, 2, 4))
            rank = a + np.arange(len(ys)) - np.repeat(np.cumsum(wide) - wide, wide)
            start, many = np.repeat(np.cumsum(deep) - deep, wide), np.repeat(deep, wide)
            for r in range(replicates):
                to = permuted(rank, n, s, r + 1, seed) - b
                here = (to >= 0) & (to < many)
                out[r] += ys[here] @ xs[start[here] + to[here]]

        for batch in batches:
            at, size = 0, 0
            lengths = batch.column(3).value_lengths().to_pylist()
            for i, n in enumerate(lengths):
                size += n
                if size >= block or i + 1 == len(lengths):
                    add(batch.slice(at, i + 1 - at))
                    at, size = i + 1, 0
        yield pa.RecordBatch.from_arrays([pa.array(range(replicates), pa.int32()), pa.array(out)], names=["r", "v"])

    some = blocks.isEmpty()
    draws = pairs.mapInArrow(sums, "r int, v double").groupBy("r").agg(F.sum("v").alias("pxy")).where(F.lit(not some))
    out = base.join(draws, F.lit(True), "left") if some else draws.join(F.broadcast(base))
    found = out.agg(F.first(F.try_divide("xy", "xx")).alias("slope"), F.count(F.when(F.abs("pxy") >= F.abs("xy") * (1 - 1e-12), 1)).alias("n_extreme"), F.count("pxy").alias("n_draws"))
    return found.withColumn("p_value", F.when(F.col("n_draws") > 0, (1 + F.col("n_extreme")) / (1 + F.col("n_draws"))))


def did_event_study(df: DataFrame, y: str, unit: str, period: str, treated: str, reference: int, periods: list[int], cluster: str | None = None) -> DataFrame:
    """Coefficients of treated x period with the reference period left out, net of unit and period effects; term is the period."""
    rows, names = _event_columns(df, treated, period, reference, periods)
    out = ols_fe(rows, y, list(names.values()), [unit, period], cluster or unit)
    label = F.create_map(*[F.lit(v) for p, n in names.items() for v in (n, str(p))])
    return out.withColumn("term", label[F.col("term")])


def _event_columns(df: DataFrame, treated: str, period: str, reference: int, periods: list[int]) -> tuple[DataFrame, dict[int, str]]:
    names = {p: f"_ev{i}" for i, p in enumerate(q for q in periods if q != reference)}
    return df.withColumns({n: (F.col(treated).cast("double") * (F.col(period) == p).cast("double")) for p, n in names.items()}), names


def pretrend_tests(df: DataFrame, y: str, unit: str, period: str, treated: str, reference: int, periods: list[int], cluster: str | None = None, short: int = 4) -> DataFrame:
    """What speaks against parallel trends before the reference period: test, estimate, std_error, f_value, df1, p_value.

    "joint leads" tests all coefficients of the event study before the reference, "last leads" those of the ``short`` last
    ones; either is null with fewer than two leads that can be estimated. "trend" is the slope of treated x (period - reference)
    on the rows up to the reference. Net of unit and period effects, errors clustered by ``cluster`` or unit.
    """
    by = cluster or unit
    rows, names = _event_columns(df, treated, period, reference, periods)
    f = fit(rows, y, list(names.values()), [unit, period], [by])
    v, g = cluster_variance(f, ["_c0"])
    leads = sorted(p for p in periods if p < reference)
    out = []
    for test, some in (("joint leads", leads), ("last leads", leads[-short:])):
        at = [f.terms.index(names[p]) for p in some if names[p] in f.terms]
        stat = float(f.beta[at] @ np.linalg.solve(v[np.ix_(at, at)], f.beta[at]) / len(at)) if len(at) > 1 and g > len(at) else None
        out.append((test, None, None, stat, len(at), None if stat is None else f_p_value(stat, len(at), g - 1)))
    (trend,) = spare(df, "trend")
    before = df.where(F.col(period) <= reference).withColumn(trend, F.col(treated).cast("double") * (F.col(period) - reference))
    row = ols_fe(before, y, [trend], [unit, period], by).first()
    out.append(("trend", row["estimate"], row["std_error"], None if row["t_value"] is None else row["t_value"] ** 2, 1, row["p_value"]))
    return df.sparkSession.createDataFrame(out, "test string, estimate double, std_error double, f_value double, df1 int, p_value double")


def placebo_leads(df: DataFrame, by: list[str], period: str, y: str, x: str, leads: list[int], fe: list[str], cluster: str) -> DataFrame:
    """The effect of x and of its value in later periods (leads that exist exactly); an effect of a lead speaks against the design."""
    from panelkit.operators.panel import lag_consecutive

    rows = df
    for k in leads:
        rows = lag_consecutive(rows, by, period, x, f"lead{k}", -k)
    return ols_fe(rows, y, [x, *[f"lead{k}" for k in leads]], fe, cluster)


def reverse_placebo(df: DataFrame, by: list[str], period: str, y: str, x: str, fe: list[str], cluster: str) -> DataFrame:
    """The regression turned around: x on y and x of the period before (where it exists exactly); terms lag_y and lag_x.

    An effect of lag_y says that the outcome leads the regressor.
    """
    from panelkit.operators.panel import lag_consecutive

    rows = lag_consecutive(lag_consecutive(df, by, period, y, "lag_y", 1), by, period, x, "lag_x", 1)
    return ols_fe(rows, x, ["lag_y", "lag_x"], fe, cluster)


def placebo_breaks(
    df: DataFrame, y: str, treated: str, period: str, eras: dict[str, tuple[int, int]], breaks: dict[str, list[int]], controls: list[str] | None = None,
    fe: list[str] | None = None, cluster: str | None = None, least_rows: int = 20, least_treated: float = 3,
) -> DataFrame:
    """What the effect of ``treated`` does inside an era (name: first and last period), where nothing should break.

    One row for each era, its test "trend" (treated x periods since the era's first) and a test "break" for each period named
    for it (treated x at or after that period): era, test, at, estimate, std_error, p_value, n, n_treated. Each is fitted
    beside ``treated``, the controls and the effects. Estimates are null with fewer than ``least_rows`` known rows or
    ``least_treated`` treated ones (a sum, so probabilities count), and where the term is collinear.
    """
    effect, *_ = spare(df, "term")
    known = df.dropna(subset=[c for c in {y, treated, period, *(controls or []), *[p for e in fe or [] for p in e.split("^")], *([cluster] if cluster else [])}])
    within = {e: F.col(period).between(*span) for e, span in eras.items()}
    counts = known.agg(*[c for e, w in within.items() for c in (F.count(F.when(w, 1)).alias(f"n_{e}"), F.coalesce(F.sum(F.when(w, F.col(treated))), F.lit(0)).cast("double").alias(f"t_{e}"))]).first()
    out = []
    for era, (first, _) in eras.items():
        n, mass = counts[f"n_{era}"], counts[f"t_{era}"]
        tests = [("trend", None, F.col(period) - first), *[("break", b, (F.col(period) >= b).cast("int")) for b in breaks.get(era, [])]]
        for test, at, part in tests:
            row = None
            if n >= least_rows and mass >= least_treated:
                rows = known.where(within[era]).withColumn(effect, F.col(treated).cast("double") * part)
                row = ols_fe(rows, y, [treated, effect, *(controls or [])], fe, cluster).where(F.col("term") == effect).first()
            out.append((era, test, at, *([row["estimate"], row["std_error"], row["p_value"]] if row else [None] * 3), n, mass))
    return df.sparkSession.createDataFrame(out, "era string, test string, at int, estimate double, std_error double, p_value double, n long, n_treated double")


def group_difference(df: DataFrame, member: str, values: list[str], cluster: str) -> DataFrame:
    """Difference of means between members and others, with errors by cluster: variable, difference, std_error, n, n_clusters.

    ``member`` is 0/1 or a probability; for the latter the difference is the slope on it. Rows with a null in the value, the
    member or the cluster are left out; a difference is null where the member doesn't vary.
    """
    out = None
    for v in values:
        row = ols_fe(df, v, [member], None, cluster).select(F.lit(v).alias("variable"), F.col("estimate").alias("difference"), "std_error", "n", "n_clusters")
        out = row if out is None else out.union(row)
    return out


def interaction_profile(df: DataFrame, y: str, category: str, period: str, controls: list[str], periods: list, cluster: str) -> DataFrame:
    """Per period the gap of a 0/1 category in y, raw and with shared slopes of controls, on the same rows; the support, and 100 (e^b - 1)."""
    rows = df.dropna(subset=[y, category, period, cluster, *controls])
    names = {p: f"_p{i}" for i, p in enumerate(periods)}
    rows = rows.withColumns({n: F.col(category).cast("double") * (F.col(period) == p).cast("double") for p, n in names.items()})
    label = F.create_map(*[F.lit(v) for p, n in names.items() for v in (n, p)]) if names else F.create_map(F.lit(""), F.lit(None).cast(rows.schema[period].dataType))

    def gaps(extra: list[str], tag: str) -> DataFrame:
        out = ols_fe(rows, y, [*names.values(), *extra], [period], cluster).where(F.col("term").isin(list(names.values())))
        return out.select(label[F.col("term")].alias(period), F.col("estimate").alias(tag), F.col("std_error").alias(f"{tag}_se"))

    support = rows.groupBy(period).agg(F.count("*").alias("n"), F.sum(F.col(category).cast("long")).alias("n_category"))
    out = support.join(gaps([], "raw"), period).join(gaps(controls, "adjusted"), period)
    return out.withColumn("adjusted_percent", 100 * (F.exp("adjusted") - 1))


def logit_fe_ame(df: DataFrame, y: str, x: list[str], fe: str | None = None, cluster: str | None = None, rounds: int = 50, tolerance: float = 1e-10) -> DataFrame:
    """Logit by Newton's method: term, estimate, std_error, average_effect = b * mean(p (1 - p)), n, n_levels, n_separated.

    Levels of ``fe`` have intercepts of their own, of any number: a round joins them to the rows and sums weights, weighted
    regressors and residuals per level; the step of the slopes comes from the k x k sums net of the levels, that of each
    intercept from its own level. Levels with one outcome only tell nothing: their rows are dropped and counted as n_separated.
    Terms that follow from others and the levels are null, as all are where the outcome is separated or nothing is left.
    Errors are clustered (CR1, effects nested in clusters don't count) or from the information. Rows with a null are left out.
    """
    names = x if fe else ["(Intercept)", *x]
    k = len(names)
    z = ([] if fe else [F.lit(1.0)]) + [F.col(c).cast("double") for c in x]
    known = df.dropna(subset=[y, *x, *([fe] if fe else []), *([cluster] if cluster else [])])
    rows = known.select(F.col(y).cast("double").alias("_y"), (F.col(fe) if fe else F.lit(0)).alias("_l"), *[c.alias(f"_z{i}") for i, c in enumerate(z)], *([F.col(cluster).alias("_c")] if cluster else []))
    ends = rows.groupBy("_l").agg(F.min("_y").alias("lo"), F.max("_y").alias("hi"), F.count("*").alias("n"))
    levels = checkpointed(ends.where("lo < hi").select("_l", F.lit(0.0).alias("_a")))
    lost = ends.where("lo = hi").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = checkpointed(rows.join(levels.select("_l"), "_l", "left_semi"))
    n, n_levels = rows.count(), levels.count()
    schema = "term string, estimate double, std_error double, average_effect double, n long, n_levels long, n_separated long"

    def nothing(which: list[str]) -> list[tuple]:
        return [(t, None, None, None, n, n_levels, lost) for t in which]

    if not n:
        return df.sparkSession.createDataFrame(nothing(names), schema)
    beta, kept, done = np.zeros(k), list(range(k)), False

    def scored(b: np.ndarray, intercepts: DataFrame) -> DataFrame:
        eta = F.col("_a") + sum((F.lit(float(v)) * F.col(f"_z{i}") for i, v in enumerate(b)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.greatest(F.least(eta, F.lit(700.0)), F.lit(-700.0))))
        return rows.join(intercepts, "_l").withColumn("_p", p).withColumn("_w", F.col("_p") * (1 - F.col("_p"))).withColumn("_r", F.col("_y") - F.col("_p"))

    def sums(b: np.ndarray, intercepts: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray, float]:
        """Level sums, and over all levels: information and score of the slopes net of the intercepts, and the sum of weights."""
        zs = [F.col(f"_z{i}") for i in range(k)]
        cells = [F.sum("_w").alias("w"), F.sum("_r").alias("r"), F.first("_a").alias("_a"), *[F.sum(F.col("_w") * c).alias(f"b{i}") for i, c in enumerate(zs)], *[F.sum(F.col("_r") * c).alias(f"g{i}") for i, c in enumerate(zs)]]
        cells += [F.sum(F.col("_w") * zs[i] * zs[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i + 1)]
        level = checkpointed(scored(b, intercepts).groupBy("_l").agg(*cells))
        share = (lambda c: F.try_divide(c, F.col("w"))) if fe else (lambda c: F.lit(0.0))
        net = [F.sum(F.col(f"h{i}_{j}") - share(F.col(f"b{i}") * F.col(f"b{j}"))).alias(f"h{i}_{j}") for i in range(k) for j in range(i + 1)]
        net += [F.sum(F.col(f"g{i}") - share(F.col(f"b{i}") * F.col("r"))).alias(f"g{i}") for i in range(k)]
        row = level.agg(*net, F.sum("w").alias("w")).first()
        h = np.zeros((k, k))
        for i in range(k):
            for j in range(i + 1):
                h[i, j] = h[j, i] = row[f"h{i}_{j}"] or 0.0
        return level, h, np.array([row[f"g{i}"] or 0.0 for i in range(k)]), row["w"]

    spread = None
    for _ in range(rounds):
        level, h, g, weight = sums(beta, levels)
        if spread is None:
            raw = np.array([v or 0.0 for v in rows.agg(*[F.sum(F.col(f"_z{i}") * F.col(f"_z{i}")) for i in range(k)]).first()]) if k else np.zeros(0)
            kept = [i for i in independent_columns(h) if h[i, i] > 1e-10 * max(raw[i], 1e-300)]
            spread = h
        step = np.zeros(k)
        try:
            step[kept] = solve(h[np.ix_(kept, kept)], g[kept]) if kept else []
        except np.linalg.LinAlgError:
            break
        if not np.isfinite(step).all() or weight < 1e-8 * n:
            break
        if fe:
            move = (F.col("r") - sum((F.lit(float(s)) * F.col(f"b{i}") for i, s in enumerate(step)), F.lit(0.0))) / F.col("w")
            shift = level.select("_l", "_a", F.greatest(F.least(move, F.lit(5.0)), F.lit(-5.0)).alias("m"))
            moved = shift.agg(F.max(F.abs("m"))).first()[0] or 0.0
            levels = checkpointed(shift.select("_l", (F.col("_a") + F.col("m")).alias("_a")))
        else:
            moved = 0.0
        beta = beta + step
        if max(np.abs(step).max(initial=0.0), moved) < tolerance * (1 + np.abs(beta).max(initial=0.0)):
            done = True
            break
    if not done or not kept:
        return df.sparkSession.createDataFrame(nothing(names), schema)
    level, h, _, weight = sums(beta, levels)
    inverse = np.linalg.inv(h[np.ix_(kept, kept)])
    v = inverse
    if cluster:
        means = level.select("_l", *[(F.col(f"b{i}") / F.col("w")).alias(f"m{i}") for i in kept])
        own = scored(beta, levels).join(means, "_l") if fe else scored(beta, levels)
        parts = [F.sum(F.col("_r") * (F.col(f"_z{i}") - F.col(f"m{i}") if fe else F.col(f"_z{i}"))).alias(f"s{j}") for j, i in enumerate(kept)]
        meat, g = gram(own.groupBy("_c").agg(*parts), [f"s{j}" for j in range(len(kept))])
        apart = _levels(rows, "_l", ["_c"])[1] if fe else 0
        scale = g / (g - 1) * (n - 1) / (n - len(kept) - apart) if g > 1 else float("nan")
        v = scale * inverse @ meat @ inverse
    at = {i: j for j, i in enumerate(kept)}
    out = [(t, float(beta[i]), float(np.sqrt(v[at[i], at[i]])), float(beta[i] * weight / n), n, n_levels, lost) if i in at else nothing([t])[0] for i, t in enumerate(names)]
    return df.sparkSession.createDataFrame(out, schema)


def auc_counts(df: DataFrame, score: str, y: str) -> DataFrame:
    """(score, n1, n0) of distinct scores; rows with a null are left out."""
    known = df.where(F.col(score).isNotNull() & F.col(y).isNotNull())
    return known.groupBy(F.col(score).alias("score")).agg(F.count(F.when(F.col(y) == 1, 1)).alias("n1"), F.count(F.when(F.col(y) == 0, 1)).alias("n0"))


def auc(counts: DataFrame) -> DataFrame:
    """Area under the curve from counts of distinct scores: pairs won plus half the ties. Null without both outcomes.

    Scores are dealt into sampled ranges and the ranges' totals carried across, so no task sorts all of them.
    """
    rows = running(counts, [], "score", {"_below": "n0"})
    won = F.sum(F.col("n1") * (F.col("_below") + F.col("n0") / 2))
    return rows.agg(F.try_divide(won, F.sum("n1").cast("double") * F.sum("n0")).alias("auc"), F.coalesce(F.sum("n1"), F.lit(0)).alias("n1"), F.coalesce(F.sum("n0"), F.lit(0)).alias("n0"))


def _copies(keys: np.ndarray, n: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Poisson(n) copies of each key's n rows for each replicate: by a hash for single rows, by a generator of the key for more."""
    out = np.stack([_poisson(keys, r, seed) for r in range(1, replicates + 1)], axis=1) * (n == 1)[:, None]
    for i in np.flatnonzero(n > 1):
        out[i] = np.random.default_rng([seed, int(keys[i].view(np.uint64))]).poisson(n[i], replicates)
    return out


def auc_bootstrap_ci(df: DataFrame, score: str, y: str, replicates: int = 999, level: float = 0.95, seed: int = 1) -> DataFrame:
    """auc and its percentile interval, resampled inside each outcome: the copies of n rows of one score and outcome are Poisson(n).

    A range of neighbouring scores draws all replicates at once, as arrays, and gives its copies and the pairs won inside it;
    lower ranges' losers are added by running totals over the ranges. Rows are never copied.
    """
    counts = auc_counts(df, score, y)
    placed = in_ranges(counts.select(F.col("score").cast("double").alias("score"), "n1", "n0"), ["score"])
    dealt = placed.repartition("_range").sortWithinPartitions("_range", "score")

    def resample(batches):
        at, held = None, None

        def row():
            return pd.DataFrame({"range": [at] * replicates, "r": range(1, replicates + 1), "n1": held[0], "n0": held[1], "won": held[2]})

        for pdf in batches:
            done = []
            for place, part in pdf.groupby("_range", sort=True):
                if place != at:
                    if held is not None:
                        done.append(row())
                    at, held = place, np.zeros((3, replicates))
                for i in range(0, len(part), SCORES_PER_BATCH):
                    some = part.iloc[i : i + SCORES_PER_BATCH]
                    keys = (some["score"].to_numpy(dtype=np.float64) + 0.0).view(np.int64)
                    a, b = (_copies(keys, some[c].to_numpy(), replicates, 2 * seed + k) for k, c in enumerate(("n1", "n0")))
                    below = held[1] + b.cumsum(axis=0) - b / 2
                    held += np.stack([a.sum(axis=0), b.sum(axis=0), (a * below).sum(axis=0)])
            if done:
                yield pd.concat(done)
        if held is not None:
            yield row()

    parts = dealt.mapInPandas(resample, "range int, r int, n1 double, n0 double, won double")
    lower = F.coalesce(F.sum("n0").over(Window.partitionBy("r").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    draws = parts.withColumn("lower", lower).groupBy("r").agg(F.try_divide(F.sum(F.col("won") + F.col("n1") * F.col("lower")), F.sum("n1") * F.sum("n0")).alias("auc"))
    tail = (1 - level) / 2
    ends = draws.agg(F.percentile("auc", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"), F.count("auc").alias("n_draws"))
    return auc(counts).join(F.broadcast(ends)).select("auc", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"), "n1", "n0", "n_draws")


def sample_flow(df: DataFrame, steps: dict[str, Column], entity: str) -> DataFrame:
    """Rows and entities left after each restriction in turn, the input first; one pass. Null conditions don't hold; an empty input gives zeros."""
    held, cells = F.lit(True), [F.struct(F.lit(0).alias("step"), F.lit("input").alias("name"), F.lit(True).alias("on"))]
    for i, (name, c) in enumerate(steps.items()):
        held = held & F.coalesce(c, F.lit(False))
        cells.append(F.struct(F.lit(i + 1).alias("step"), F.lit(name).alias("name"), held.alias("on")))
    long = df.select(F.col(entity).alias("_e"), F.inline(F.array(*cells)))
    found = long.groupBy("step", "name").agg(F.count(F.when(F.col("on"), 1)).alias("n_rows"), F.countDistinct(F.when(F.col("on"), F.col("_e"))).alias("n_entities"))
    all_steps = df.sparkSession.createDataFrame(list(enumerate(["input", *steps])), "step int, name string")
    return all_steps.join(found, ["step", "name"], "left").fillna(0, ["n_rows", "n_entities"])


def sensitivity_grid(df: DataFrame, main: str, variants: dict[str, dict], term: str, fitted: float | None = None) -> DataFrame:
    """One row per variant (arguments of ``ols_fe``, with ``where`` for a sample): the coefficient of its focal regressor, and its ratio to the main one's.

    A variant names its focal regressor as ``focal``; else ``term``. Raises where the main cell is not within 1e-6 of ``fitted``,
    the main fit's own estimate.
    """
    out = None
    for name, spec in variants.items():
        spec = dict(spec)
        sample, focal = spec.pop("where", None), spec.pop("focal", term)
        rows = ols_fe(df if sample is None else df.where(sample), **spec).where(F.col("term") == focal)
        rows = rows.select(F.lit(name).alias("variant"), F.col("estimate"), F.col("std_error"), "n")
        out = rows if out is None else out.union(rows)
    first = out.where(F.col("variant") == main).select(F.col("estimate").alias("_main"))
    if fitted is not None:
        cell = first.first()
        if cell is None or cell[0] is None or abs(cell[0] - fitted) > 1e-6:
            raise ValueError(f"the main cell is {cell and cell[0]}, the main fit {fitted}")
    return out.join(F.broadcast(first)).withColumn("to_main", F.try_divide(F.col("estimate"), F.col("_main"))).drop("_main")
