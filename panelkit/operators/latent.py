"""Probabilities of a category that isn't observed: shares, posteriors, fitted priors, raking and diagnostics.

Categories are the caller's; probability vectors are array<double> columns in their order. Results describe aggregates:
``top`` labels are descriptive only, and probabilities are not calibrated to a population unless raked.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.functions import lgamma
from panelkit.operators._names import spare
from panelkit.operators._state import checkpointed
from panelkit.operators.aggregate import ratio
from panelkit.operators.estimate import auc, auc_counts, gram, independent_columns, solve, summed
from panelkit.operators.ranges import running

#: Different rows of covariates, of any number of data rows, that a fit may bring to the driver.
MAX_CELLS = 100_000


def normalised(v: Column) -> Column:
    """A vector over its sum; null where that is zero or null."""
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(v, lambda x: x / total))


def times(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def over(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.try_divide(x, F.nullif(y, F.lit(0.0))))


def smooth_shares_eb(table: DataFrame, name: str, category: str, count: str, low: float = -2.0, high: float = 4.0, points: int = 241) -> tuple[DataFrame, DataFrame]:
    """Shares of (name, category, count) shrunk to the marginal by a Dirichlet prior; its concentration maximises the marginal likelihood on a log10 grid.

    Returns (name, category, share) and the one row (alpha, log_likelihood). The likelihood needs only how often each
    count occurs per category and how often each total occurs, so the grid meets these short tables and not the names.
    """
    cells = table.groupBy(name, category).agg(F.sum(count).cast("double").alias("_n"))
    totals = cells.groupBy(name).agg(F.sum("_n").alias("_total"))
    marginal = cells.groupBy(category).agg(F.sum("_n").alias("_m")).join(F.broadcast(cells.agg(F.sum("_n").alias("_all")))).select(category, (F.col("_m") / F.col("_all")).alias("_p"))
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    alpha = F.pow(F.lit(10.0), F.lit(low) + F.col("_i") * ((high - low) / (points - 1)))
    counts = cells.where("_n > 0").groupBy(category, "_n").agg(F.count("*").alias("_times")).join(F.broadcast(marginal), category)
    a = counts.withColumn("_i", grid).withColumn("_a", alpha)
    part = a.groupBy("_i").agg(F.sum(F.col("_times") * (lgamma(F.col("_a") * F.col("_p") + F.col("_n")) - lgamma(F.col("_a") * F.col("_p")))).alias("_x"))
    b = totals.where("_total > 0").groupBy("_total").agg(F.count("*").alias("_times")).withColumn("_i", grid).withColumn("_a", alpha)
    rest = b.groupBy("_i").agg(F.sum(F.col("_times") * (lgamma(F.col("_a")) - lgamma(F.col("_a") + F.col("_total")))).alias("_y"))
    best = part.join(rest, "_i").withColumn("_l", F.col("_x") + F.col("_y")).agg(F.max(F.struct("_l", (-F.col("_i")).alias("i"))).alias("b")).select((-F.col("b.i")).alias("_i"), F.col("b._l").alias("log_likelihood")).withColumn("alpha", alpha).select("alpha", "log_likelihood")
    full = totals.join(F.broadcast(marginal)).join(cells, [name, category], "left").join(F.broadcast(best.select("alpha")))
    shares = full.select(name, category, ((F.coalesce("_n", F.lit(0.0)) + F.col("alpha") * F.col("_p")) / (F.col("_total") + F.col("alpha"))).alias("share"))
    return shares, best


def posterior_naive_bayes(entities: DataFrame, base: Column, factors: list[tuple[str, str, DataFrame]], categories: list[str], catch_all: str = "ALL OTHER") -> DataFrame:
    """Adds posterior, method and top from P(c|first) and P(c|k) / P(c) of each further factor (name, entity column, (key, probs)).

    A key that a table lacks takes its catch-all row; without one, or with a null key, the factor says nothing. ``base`` is
    P(c). method joins the names of factors that were found; without any the posterior is the base.
    """
    out, said, post = entities, [], None
    for i, (_, col, table) in enumerate(factors):
        t = table.toDF("_key", f"_v{i}")
        rest = t.where(F.col("_key") == catch_all).agg(F.first(f"_v{i}").alias(f"_r{i}"))
        out = out.join(t, F.col(col) == F.col("_key"), "left").drop("_key").join(F.broadcast(rest))
        v = F.when(F.col(col).isNotNull(), F.coalesce(f"_v{i}", f"_r{i}"))
        said.append(v)
    for v in said:
        factor = over(v, base)
        post = factor if post is None else F.when(v.isNotNull(), F.when(post.isNull(), factor).otherwise(times(post, factor))).otherwise(post)
    posterior = normalised(F.coalesce(times(post, base), base))
    method = F.coalesce(F.nullif(F.array_join(F.array_compact(F.array(*[F.when(v.isNotNull(), F.lit(n)) for v, (n, _, _) in zip(said, factors, strict=True)])), "+"), F.lit("")), F.lit("none"))
    out = out.select(*entities.columns, posterior.alias("posterior"), method.alias("method"))
    names = F.array(*map(F.lit, categories))
    return out.withColumn("top", F.element_at(names, F.array_position("posterior", F.array_max("posterior")).cast("int")))


def likelihood_from_posterior(df: DataFrame, posterior: str, marginal: Column, neutral: list[int], levels: str, factors: dict[str, str], linked: str | None = None) -> DataFrame:
    """Adds likelihood: posterior / marginal, 1 for ``neutral`` categories, times the location factor of the row's source level, scaled to a maximum of 1.

    ``levels`` names the row's level, ``factors`` its vector column. A row without a posterior borrows the ``linked``
    likelihood column where there is one; then 1 everywhere.
    """
    ratio_ = over(F.col(posterior), marginal)
    if neutral:
        ratio_ = F.transform(ratio_, lambda x, k: F.when(k.isin(neutral), F.lit(1.0)).otherwise(x))
    factor = F.coalesce(*[F.when(F.col(levels) == v, F.col(c)) for v, c in factors.items()], F.transform(F.col(posterior), lambda x: F.lit(1.0)))
    made = times(ratio_, factor)
    top = F.array_max(made)
    own = F.transform(made, lambda x: x / top)
    flat = F.transform(marginal, lambda x: F.lit(1.0))
    return df.withColumn("likelihood", F.coalesce(own, *([F.col(linked)] if linked else []), flat))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _multinomial_step(design: np.ndarray, mass: np.ndarray, gamma: np.ndarray, penalty: float, rounds: int = 25) -> np.ndarray:
    """Newton steps of a multinomial logit with expected counts; the last category is the reference, the intercept isn't penalised."""
    k, p = mass.shape[1] - 1, design.shape[1]
    ridge = np.tile(np.r_[0.0, np.full(p - 1, penalty)], k)
    n = mass.sum(axis=1)
    for _ in range(rounds):
        pi = softmax(np.column_stack([design @ gamma.T, np.zeros(len(design))]))
        grad = ((mass[:, :k] - n[:, None] * pi[:, :k]).T @ design).ravel() - ridge * gamma.ravel()
        h = np.zeros((k * p, k * p))
        for a, b in itertools.product(range(k), range(k)):
            w = n * pi[:, a] * ((a == b) - pi[:, b])
            h[a * p : (a + 1) * p, b * p : (b + 1) * p] = (design * w[:, None]).T @ design
        step = np.linalg.solve(h + np.diag(ridge + 1e-10), grad).reshape(k, p)
        gamma = gamma + step
        if np.abs(step).max() < 1e-9:
            break
    return gamma


def em_prior_fit(df: DataFrame, covariates: list[str], likelihood: str, categories: int, weight: str | None = None, penalty: float = 0.1, tolerance: float = 1e-6, rounds: int = 500, start: list[float] | str | None = None) -> tuple[DataFrame, np.ndarray, list[float]]:
    """EM for P(c | X) = softmax(X gamma) with given likelihoods of rows; returns the frame with prior and posterior, gamma and the path of penalised log likelihoods.

    Covariates are codes with main effects. A round's E-step is one aggregate over all rows: the expected counts of each covariate
    cell, and the log likelihood. Only that table, of at most MAX_CELLS cells (more raise), reaches the driver, where the M-step
    fits gamma; likelihoods may be as many different vectors as there are rows. ``start`` is the prior of the first E-step: a
    vector, or a column of vectors; else all categories are alike. A row whose likelihoods are all 0 under the prior counts nowhere.
    Rows with a null are left out of the fit, and get nulls; without rows gamma is 0 and the path empty.
    """
    spark, k = df.sparkSession, categories
    cell, like, w, first = spare(df, "cell", "like", "w", "first")
    known = df.dropna(subset=[*covariates, likelihood, *([weight] if weight else []), *([start] if isinstance(start, str) else [])])
    keys = [tuple(r) for r in known.select(*covariates).distinct().limit(MAX_CELLS + 1).collect()]
    if len(keys) > MAX_CELLS:
        raise ValueError(f"over {MAX_CELLS} different rows of covariates")
    keys.sort()
    levels = [sorted({key[i] for key in keys}) for i in range(len(covariates))]
    design = np.array([[1.0, *[float(key[i] == v) for i, values in enumerate(levels) for v in values[1:]]] for key in keys]) if keys else np.zeros((0, 1))
    kinds = [df.schema[c].dataType.simpleString() for c in covariates]
    named = spare(df, *[f"key{i}" for i in range(len(covariates))])

    def table(values: list[tuple], *kind: str) -> DataFrame:
        return spark.createDataFrame([(*key, *v) for key, v in zip(keys, values, strict=True)], ", ".join([*[f"`{c}` {t}" for c, t in zip(named, kinds, strict=True)], *kind]))

    on = [F.col(c) == F.col(n) for c, n in zip(covariates, named, strict=True)]
    numbered = known.join(F.broadcast(table([(i,) for i in range(len(keys))], f"`{cell}` int")), on)
    given = F.lit(None).cast("array<double>") if start is None else F.col(start).cast("array<double>") if isinstance(start, str) else F.array(*[F.lit(float(v)) for v in start])
    rows = numbered.select(cell, F.col(likelihood).cast("array<double>").alias(like), (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias(w), given.alias(first))
    # Equal evidence of a cell is one row with its weight.
    rows = checkpointed(rows.groupBy(cell, like, first).agg(F.sum(w).alias(w)))

    def expected(prior: Column, frame: DataFrame) -> tuple[np.ndarray, float]:
        joint = times(prior, F.col(like))
        total = F.aggregate(joint, F.lit(0.0), lambda a, x: a + x)
        held = frame.select(cell, w, joint.alias("_joint"), total.alias("_total")).where("_total > 0")
        sums = held.groupBy(cell).agg(F.sum(F.col(w) * F.log("_total")).alias("ll"), *[F.sum(F.col(w) * F.col("_joint")[i] / F.col("_total")).alias(f"m{i}") for i in range(k)])
        mass, ll = np.zeros((len(keys), k)), 0.0
        for r in sums.collect():
            mass[r[0]] = r[2:]
            ll += r[1]
        return mass, ll

    def prior_of(gamma: np.ndarray) -> np.ndarray:
        return softmax(np.column_stack([design @ gamma.T, np.zeros(len(design))]))

    gamma, path = np.zeros((k - 1, design.shape[1])), []
    if start is not None and keys:
        gamma = _multinomial_step(design, expected(F.col(first), rows)[0], gamma, penalty)
    for _ in range(rounds if keys else 0):
        now = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(prior_of(gamma))], f"`{cell}` int, _prior array<double>")
        mass, ll = expected(F.col("_prior"), rows.join(F.broadcast(now), cell))
        path.append(ll - penalty / 2 * float((gamma[:, 1:] ** 2).sum()))
        if len(path) > 1 and abs(path[-1] - path[-2]) <= tolerance * abs(path[-2]):
            break
        gamma = _multinomial_step(design, mass, gamma, penalty)
    fitted = table([([float(x) for x in p],) for p in prior_of(gamma)] if keys else [], "prior array<double>")
    out = df.join(F.broadcast(fitted), on, "left").drop(*named)
    return out.withColumn("posterior", normalised(times(F.col("prior"), F.col(likelihood)))), gamma, path


def em_variants(df: DataFrame, covariates: list[str], variants: dict[str, str], main: str, categories: int, observed: str | None = None, **options) -> DataFrame:
    """Aggregates of the same fit under several likelihood columns: variant, category, mean posterior, mean change against the main one.

    ``observed`` (a category number or null) overrides a row's posterior by certainty; ``options`` go to each fit.
    """
    rows = df
    for name, column in variants.items():
        fitted, _, _ = em_prior_fit(rows, covariates, column, categories, **options)
        post = F.col("posterior")
        if observed:
            sure = F.transform(F.sequence(F.lit(0), F.lit(categories - 1)), lambda k: (k == F.col(observed)).cast("double"))
            post = F.when(F.col(observed).isNotNull(), sure).otherwise(post)
        rows = fitted.withColumn(f"_p_{name}", post).drop("prior", "posterior")
    cells = F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(k).alias("category"), F.col(f"_p_{n}")[k].alias("p"), F.col(f"_p_{main}")[k].alias("m")) for n in variants for k in range(categories)])
    return rows.select(F.inline(cells)).groupBy("variant", "category").agg(F.avg("p").alias("mean_posterior"), F.avg(F.abs(F.col("p") - F.col("m"))).alias("mean_change"), F.max(F.abs(F.col("p") - F.col("m"))).alias("max_change"))


def rake_to_margin(df: DataFrame, probabilities: str, category: int, by: list[str], target: DataFrame, weight: Column | None = None, reach: float = 12.0, points: int = 65, rounds: int = 5) -> DataFrame:
    """Shifts the odds of one category by exp(delta), one delta per group of ``by``, so that its weighted mean meets the target (by, target).

    Adds delta and raked (the vector). Each round evaluates a grid of deltas for all groups in one aggregate and goes on
    between the two that enclose the target; a target out of reach ends at the grid's edge.
    """
    w = F.lit(1.0) if weight is None else weight
    p = lambda d: F.col("_p") * F.exp(d) / (1 - F.col("_p") + F.col("_p") * F.exp(d))
    base = df.select(*by, F.element_at(probabilities, category + 1).alias("_p"), w.cast("double").alias("_w")).where("_p IS NOT NULL AND _w IS NOT NULL")
    bounds = target.select(*by, F.col("target"), F.lit(-reach).alias("_lo"), F.lit(reach).alias("_hi"))
    for _ in range(rounds):
        rows = base.join(bounds, by)
        step = (F.col("_hi") - F.col("_lo")) / (points - 1)
        cells = [ratio(F.sum(F.col("_w") * p(F.col("_lo") + i * step)), F.sum("_w")).alias(f"m{i}") for i in range(points)]
        means = rows.groupBy(*by, "target", "_lo", "_hi").agg(*cells)
        below = sum((F.coalesce((F.col(f"m{i}") < F.col("target")).cast("int"), F.lit(0)) for i in range(points)), F.lit(0))
        left = F.greatest(below - 1, F.lit(0))
        right = F.least(F.greatest(below, F.lit(1)), F.lit(points - 1))
        bounds = means.select(*by, "target", (F.col("_lo") + left * step).alias("_lo"), (F.col("_lo") + right * step).alias("_hi"))
        bounds = checkpointed(bounds)
    delta = (F.col("_lo") + F.col("_hi")) / 2
    out = df.join(bounds.select(*by, delta.alias("delta")), by, "left")
    shifted = F.transform(F.col(probabilities), lambda x, k: F.when(k == category, x * F.exp("delta")).otherwise(x))
    return out.withColumn("raked", normalised(shifted))


def score_diagnostics(df: DataFrame, score: str, y: str) -> DataFrame:
    """n, auc, mean score, mean outcome, entropy (bits), E[p^2] / E[p], Brier score and calibration slope of a probability against a 0/1 outcome."""
    p = F.col(score).cast("double")
    known = df.where(F.col(score).isNotNull() & F.col(y).isNotNull())
    bits = lambda q: F.when((q > 0) & (q < 1), -(q * F.log2(q) + (1 - q) * F.log2(1 - q))).otherwise(0.0)
    sums = known.agg(F.count("*").alias("n"), F.avg(p).alias("mean_score"), F.avg(y).alias("mean_outcome"), F.avg(bits(p)).alias("entropy"), ratio(F.avg(p * p), F.avg(p)).alias("concentration"), F.avg((p - F.col(y)) * (p - F.col(y))).alias("brier"), F.regr_slope(y, score).alias("slope"))
    return sums.join(F.broadcast(auc(auc_counts(known, score, y)).select("auc")))


def reliability(df: DataFrame, score: str, y: str, bins: int = 10) -> DataFrame:
    """Rows, mean score and mean outcome in bins of equal width."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(y).alias("mean_outcome"))


def tie_keeping_deciles(df: DataFrame, score: str, y: str, parts: int = 10) -> DataFrame:
    """decile, n, mean outcome, with equal scores in one decile: that of the score's middle rank. Ranks come from ranges of scores."""
    counts = auc_counts(df, score, y).withColumn("n", F.col("n1") + F.col("n0"))
    total = counts.agg(F.sum("n").alias("_all"))
    placed = running(counts, [], "score", {"_below": "n"}).join(F.broadcast(total))
    decile = F.least(F.floor((F.col("_below") + (F.col("n") + 1) / 2 - 0.5) / F.col("_all") * parts) + 1, F.lit(parts)).cast("int")
    return placed.groupBy(decile.alias("decile")).agg(F.sum("n").alias("n"), (F.sum("n1") / F.sum("n")).alias("mean_outcome"))


def mixture_regression_em(df: DataFrame, y: str, x: list[str], probabilities: str, categories: int, tolerance: float = 1e-8, rounds: int = 200) -> tuple[DataFrame, list[dict]]:
    """Normal outcome with coefficients by latent category and given category probabilities; returns rows with posterior, and the fit per category.

    Each round is one aggregate of weighted cross products per category; coefficients are solved on the driver. Starts from
    the probabilities as posteriors. Rows with a null are left out.
    """
    rows = checkpointed(df.dropna(subset=[y, *x, probabilities]))
    numbers = rows.select(F.lit(1.0).alias("_one"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(x)], F.col(y).cast("double").alias("_y"), *[F.col(probabilities)[k].cast("double").alias(f"_p{k}") for k in range(categories)])
    width = len(x) + 2
    fits: list[dict] = []
    last = None

    def parts(found: list[dict]):
        def f(m: np.ndarray) -> np.ndarray:
            d, p = m[:, :width], m[:, width:]
            if found:
                z = np.column_stack([(d[:, -1] - d[:, :-1] @ g["beta"]) / g["sigma"] for g in found])
                logs = np.log(np.maximum(p, 1e-300)) - z * z / 2 - np.log([g["sigma"] for g in found])
                p = softmax(logs)
            return np.concatenate([((d * p[:, [k]]).T @ d).ravel() for k in range(categories)])

        return f

    for _ in range(rounds):
        grams = summed(numbers, parts(fits), categories * width * width).reshape(categories, width, width)
        fits = []
        for g in grams:
            kept = independent_columns(g[:-1, :-1])
            beta = np.zeros(width - 1)
            beta[kept] = solve(g[np.ix_(kept, kept)], g[kept, -1])
            n = g[0, 0]
            ss = g[-1, -1] - 2 * beta @ g[:-1, -1] + beta @ g[:-1, :-1] @ beta
            fits.append({"beta": beta, "sigma": math.sqrt(max(ss / max(n, 1e-300), 1e-12)), "n": float(n)})
        flat = np.concatenate([np.r_[f["beta"], f["sigma"]] for f in fits])
        if last is not None and np.abs(flat - last).max() <= tolerance * (1 + np.abs(flat).max()):
            break
        last = flat
    logs = []
    for k, f in enumerate(fits):
        mean = sum((F.lit(float(b)) * (F.lit(1.0) if i == 0 else F.col(x[i - 1])) for i, b in enumerate(f["beta"])), F.lit(0.0))
        z = (F.col(y) - mean) / F.lit(f["sigma"])
        logs.append(F.log(F.greatest(F.col(probabilities)[k], F.lit(1e-300))) - z * z / 2 - F.lit(math.log(f["sigma"])))
    top = F.greatest(*logs)
    return rows.withColumn("posterior", normalised(F.array(*[F.exp(c - top) for c in logs]))), fits


def _contrast(df: DataFrame, y: str, controls: list[str], p: str, q: str, beside: bool) -> tuple[Column, Column, int, int]:
    """The contrast of a row, whether it is estimable, and the rank and number of columns of the design."""
    base = [F.lit(1.0), *[F.col(c).cast("double") for c in controls]]
    known = df.dropna(subset=[y, p, q, *controls])
    parts = [F.col(p).cast("double"), F.col(q).cast("double"), *([F.lit(1.0)] if beside else [])]
    design = known.select(*[(s * c).alias(f"_{j}_{i}") for j, s in enumerate(parts) for i, c in enumerate(base)], F.col(y).cast("double").alias("_y"))
    names = [c for c in design.columns if c != "_y"]
    g, _ = gram(design, [*names, "_y"])
    a = g[:-1, :-1]
    scale = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
    values, vectors = np.linalg.eigh(a / scale / scale[:, None])
    live = values > 1e-9 * max(values.max(), 1e-300)
    null = vectors[:, ~live]
    beta = (vectors[:, live] / values[live]) @ (vectors[:, live].T @ (g[:-1, -1] / scale)) / scale
    k = len(base)
    less = 0.0 if beside else 1.0
    contrast = sum((F.lit(float(beta[i] - less * beta[k + i])) * c for i, c in enumerate(base)), F.lit(0.0))
    free = reduce(lambda a, b: a & b, [c.isNotNull() for c in base])
    for v in null.T:
        d = v / scale
        part = sum((F.lit(float(d[i] - less * d[k + i])) * c for i, c in enumerate(base)), F.lit(0.0))
        size = F.lit(float(np.abs(d).max())) * sum((F.abs(c) for c in base), F.lit(0.0))
        free = free & (F.abs(part) <= 1e-7 * size)
    return contrast, free, int(live.sum()), len(names)


def estimable_contrast(df: DataFrame, y: str, controls: list[str], p: str, q: str, beside: bool = False) -> DataFrame:
    """Adds contrast: what category p adds to the fitted y of a row, null on rows that the data can't tell.

    The design is [p x, q x] for x in the intercept and the controls, and the contrast is p against q; with ``beside`` it is
    [p x, q x, x], and the contrast is p against the category that neither p nor q holds. A row's contrast is estimable where
    its difference of design rows lies in the space of the design. That space comes from one cross product; a row is
    checked as a column, against the directions without data.
    """
    contrast, free, *_ = _contrast(df, y, controls, p, q, beside)
    return df.withColumn("contrast", F.when(free, contrast))


def gap_ladder(df: DataFrame, y: str, controls: list[str], p: str, q: str, fitted: str, posterior: str) -> DataFrame:
    """The gap between category p and the one that neither p nor q holds, step by step: one row (step, value) each.

    - slope: y on p and q alone; slope_given_x: with the controls
    - interacted_prior: the estimable contrasts of [p x, q x, x], weighted by p
    - fitted_prior, fitted: ``fitted`` (a latent-category fit's gap for the row) on the same rows, weighted by p and by ``posterior``
    - fitted_all: ``fitted`` on all rows, weighted by ``posterior``
    - n, n_supported, share_supported (of p), rank, columns

    Rows with a null in any of the columns are left out. A step without weight, or whose p follows from the other columns,
    is null. Rows are read for two cross products and one aggregate.
    """
    rows = df.dropna(subset=[y, p, q, fitted, posterior, *controls])
    contrast, free, rank, width = _contrast(rows, y, controls, p, q, True)
    mean = lambda v, w, where: F.try_divide(F.sum(F.when(where, v * w)), F.sum(F.when(where, w)))
    pp, post, gap = F.col(p).cast("double"), F.col(posterior).cast("double"), F.col(fitted).cast("double")
    every = F.lit(True)
    steps = {
        "interacted_prior": mean(contrast, pp, free), "fitted_prior": mean(gap, pp, free), "fitted": mean(gap, post, free), "fitted_all": mean(gap, post, every),
        "n": F.count("*").cast("double"), "n_supported": F.count(F.when(free, 1)).cast("double"), "share_supported": F.try_divide(F.sum(F.when(free, pp)), F.sum(pp)),
    }
    found = rows.agg(*[c.alias(n) for n, c in steps.items()]).first().asDict()
    (one,) = spare(rows, "one")
    g, _ = gram(rows.withColumn(one, F.lit(1.0)), [one, q, *controls, p, y])
    for name, at in (("slope", [0, 1, len(g) - 2]), ("slope_given_x", list(range(len(g) - 1)))):
        kept = [at[i] for i in independent_columns(g[np.ix_(at, at)])]
        found[name] = float(solve(g[np.ix_(kept, kept)], g[kept, -1])[-1]) if at[-1] in kept else None
    found |= {"rank": float(rank), "columns": float(width)}
    order = ["slope", "slope_given_x", "interacted_prior", "fitted_prior", "fitted", "fitted_all", "n", "n_supported", "share_supported", "rank", "columns"]
    return df.sparkSession.createDataFrame([(n, found[n]) for n in order], "step string, value double")
