"""Gaussian mixtures by rounds of one aggregation each: from given parameters, and with priors on them.

A round asks for sums over all points: of each component's responsibilities, of the points and of their products under them,
and of the bound. These sums are as many as ``k * d * d`` numbers, and the new parameters follow from them on the driver, so
rows are only read. Points are taken relative to their mean, so products lose no digits to it.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import spool

#: Added to the variances, so that no component shrinks to a point.
FLOOR = 1e-6


@dataclass(frozen=True)
class Sums:
    """What a round gathers: by component the responsibilities, weighted points and weighted products; the sum of the logarithms
    of the points' densities, and the entropy of the responsibilities."""

    n: np.ndarray
    x: np.ndarray
    xx: np.ndarray
    evidence: float
    entropy: float


@dataclass(frozen=True)
class Gaussians:
    """A mixture: weights, means, covariances."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    def scores(self, x: list[Column]) -> list[Column]:
        """Logarithms of the components' weighted densities."""
        return [
            _quadratic(x, m, p, -0.5) + float(math.log(w) + 0.5 * np.linalg.slogdet(p)[1] - len(x) / 2 * math.log(2 * math.pi)) if w > 0 else F.lit(-math.inf)
            for w, m, p in zip(self.weights, self.means, np.linalg.inv(self.covariances), strict=True)
        ]


@dataclass(frozen=True)
class Posterior:
    """Dirichlet weights ``alpha`` and, of each component, a Gaussian-Wishart: precision of the mean ``beta``, mean, the inverse
    ``spread`` of the Wishart's scale, degrees of freedom ``nu``."""

    alpha: np.ndarray
    beta: np.ndarray
    means: np.ndarray
    spread: np.ndarray
    nu: np.ndarray

    def scores(self, x: list[Column]) -> list[Column]:
        """Expected logarithms of the components' weighted densities."""
        d, every = len(x), digamma(self.alpha.sum())
        out = []
        for a, b, m, s, v in zip(self.alpha, self.beta, self.means, self.spread, self.nu, strict=True):
            scale = np.linalg.inv(s)
            shape = sum(digamma((v - i) / 2) for i in range(d)) + d * math.log(2) + np.linalg.slogdet(scale)[1]
            out.append(_quadratic(x, m, scale * v, -0.5) + float(digamma(a) - every + 0.5 * (shape - d / b) - d / 2 * math.log(2 * math.pi)))
        return out


def digamma(x: float) -> float:
    """The derivative of the logarithm of the gamma function, for positive ``x``."""
    total = 0.0
    while x < 10:
        total -= 1 / x
        x += 1
    y = 1 / (x * x)
    return total + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def _quadratic(x: list[Column], mean: np.ndarray, precision: np.ndarray, factor: float) -> Column:
    """``factor`` times the squared distance of ``x`` from ``mean`` under ``precision``, as a sum of squares."""
    root = np.linalg.cholesky(precision).T
    lines = [sum(((x[j] - float(mean[j])) * float(row[j]) for j in range(i + 1, len(x))), (x[i] - float(mean[i])) * float(row[i])) for i, row in enumerate(root)]
    return sum((y * y for y in lines[1:]), lines[0] * lines[0]) * factor


def centred(df: DataFrame, columns: list[str]) -> tuple[DataFrame, np.ndarray]:
    """The complete rows of ``columns`` less their means, written once, and the means."""
    v = df.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns))).dropna()
    mean = [m or 0.0 for m in v.agg(*(F.avg(c).alias(c) for c in v.columns)).first()]
    return spool(v.select(*((F.col(c) - float(m)).alias(c) for c, m in zip(v.columns, mean, strict=True)))), np.array(mean)


def _gather(points: DataFrame, logs: list[Column], columns: list[str] | None = None) -> Sums:
    """The sums of one round over ``columns``, or all; ``logs`` are the components' scores."""
    names, k = columns or points.columns, len(logs)
    d = len(names)
    p = points.withColumns({f"l{i}": s for i, s in enumerate(logs)})
    p = p.withColumn("top", F.greatest(*(f"l{i}" for i in range(k))) if k > 1 else F.col("l0"))
    p = p.withColumn("whole", F.col("top") + F.log(sum((F.exp(F.col(f"l{i}") - F.col("top")) for i in range(1, k)), F.exp(F.col("l0") - F.col("top")))))
    p = p.withColumns({f"r{i}": F.exp(F.col(f"l{i}") - F.col("whole")) for i in range(k)})
    surprise = lambda i: F.when(F.col(f"r{i}") > 0, F.col(f"r{i}") * (F.col("whole") - F.col(f"l{i}"))).otherwise(0.0)
    wanted = [F.sum("whole"), F.sum(sum((surprise(i) for i in range(1, k)), surprise(0)))]
    wanted += [F.sum(f"r{i}") for i in range(k)]
    wanted += [F.sum(F.col(f"r{i}") * F.col(c)) for i in range(k) for c in names]
    wanted += [F.sum(F.col(f"r{i}") * F.col(names[a]) * F.col(names[b])) for i in range(k) for a in range(d) for b in range(a, d)]
    row = np.array([v if v is not None else 0.0 for v in p.agg(*(w.alias(f"s{i}") for i, w in enumerate(wanted))).first()])
    at = 2 + k + k * d
    xx, upper = np.zeros((k, d, d)), np.triu_indices(d)
    xx[:, upper[0], upper[1]] = row[at:].reshape(k, -1)
    xx[:, upper[1], upper[0]] = row[at:].reshape(k, -1)
    return Sums(row[2 : 2 + k], row[2 + k : at].reshape(k, d), xx, float(row[0]), float(row[1]))


def likeliest(sums: Sums) -> Gaussians:
    """The parameters of greatest likelihood under a round's responsibilities."""
    n = np.maximum(sums.n, 1e-300)
    means = sums.x / n[:, None]
    covariances = sums.xx / n[:, None, None] - means[:, :, None] * means[:, None, :] + FLOOR * np.eye(means.shape[1])
    return Gaussians(sums.n / sums.n.sum(), means, covariances)


def maximisation_step(points: DataFrame, model: Gaussians) -> tuple[Gaussians, float | None]:
    """The mixture after one round from ``model``, and the mean logarithm of the density under ``model``; null without points."""
    sums = _gather(points, model.scores([F.col(c) for c in points.columns]))
    return (likeliest(sums), sums.evidence / sums.n.sum()) if sums.n.sum() > 0 else (model, None)


def maximise(points: DataFrame, start: Gaussians, tolerance: float = 1e-3, most: int = 100) -> tuple[Gaussians, list[float]]:
    """Expectation maximisation from ``start`` until the mean logarithm of the density gains less than ``tolerance``; the fitted
    mixture and the means on the way, which never fall. After ``most`` rounds without that it warns."""
    model, path = start, []
    for _ in range(most):
        new, reached = maximisation_step(points, model)
        if reached is None:
            return model, path
        path.append(reached)
        if len(path) > 1 and path[-1] - path[-2] < tolerance:
            return model, path
        model = new
    warnings.warn(f"no convergence in {most} rounds", stacklevel=2)
    return model, path


@dataclass(frozen=True)
class Prior:
    """The prior of a mixture of ``k`` components: Dirichlet weight of each, precision and place of the means, degrees of freedom
    and inverse scale of the Wishart distributions."""

    alpha: float
    beta: float
    mean: np.ndarray
    nu: float
    spread: np.ndarray

    def update(self, sums: Sums) -> Posterior:
        """The posterior under a round's responsibilities."""
        n = np.maximum(sums.n, 1e-300)
        own = sums.x / n[:, None]
        beta = self.beta + sums.n
        means = (self.beta * self.mean + sums.x) / beta[:, None]
        scatter = sums.xx - n[:, None, None] * own[:, :, None] * own[:, None, :]
        off = own - self.mean
        spread = self.spread + scatter + (self.beta * sums.n / beta)[:, None, None] * off[:, :, None] * off[:, None, :]
        return Posterior(self.alpha + sums.n, beta, means, spread, self.nu + sums.n)

    def bound(self, sums: Sums, q: Posterior) -> float:
        """The lower bound of the logarithm of the evidence, for responsibilities with ``sums`` and the posterior they lead to."""
        k, d = q.means.shape
        dirichlet = lambda a: math.lgamma(a.sum()) - sum(math.lgamma(v) for v in a)
        gammas = lambda v: sum(math.lgamma((v - i) / 2) for i in range(d))
        wishart = lambda s, v: v / 2 * np.linalg.slogdet(s)[1] - v * d / 2 * math.log(2) - d * (d - 1) / 4 * math.log(math.pi) - gammas(v)
        total = sums.entropy + dirichlet(np.full(k, self.alpha)) - dirichlet(q.alpha) - sums.n.sum() * d / 2 * math.log(2 * math.pi)
        for b, s, v in zip(q.beta, q.spread, q.nu, strict=True):
            total += d / 2 * math.log(self.beta / b) + wishart(self.spread, self.nu) - wishart(s, v)
        return float(total)


def default_prior(points: DataFrame, k: int) -> Prior:
    """Weight 1 in all, one point's worth at the mean, as many degrees of freedom as columns, the points' covariance."""
    d = len(points.columns)
    cells = [(a, b) for a in range(d) for b in range(a, d)]
    row = points.agg(*(F.covar_samp(points.columns[a], points.columns[b]).alias(f"c{a}_{b}") for a, b in cells)).first()
    spread = np.eye(d) * FLOOR
    for (a, b), v in zip(cells, row, strict=True):
        spread[a, b] += v or 0.0
        spread[b, a] = spread[a, b]
    return Prior(1 / k, 1.0, np.zeros(d), float(d), spread)


def infer(points: DataFrame, prior: Prior, start: Sums, tolerance: float = 1e-3, most: int = 100) -> tuple[Posterior, list[float]]:
    """Variational inference from a first round's sums until the bound for each point gains less than ``tolerance``; the
    posterior, and the bounds for each point on the way, which never fall."""
    q, path, n = prior.update(start), [], max(1.0, float(start.n.sum()))
    for _ in range(most):
        sums = _gather(points, q.scores([F.col(c) for c in points.columns]))
        q = prior.update(sums)
        path.append(prior.bound(sums, q) / n)
        if len(path) > 1 and path[-1] - path[-2] < tolerance:
            return q, path
    warnings.warn(f"no convergence in {most} rounds", stacklevel=2)
    return q, path


def hard(points: DataFrame, label: Column, k: int, columns: list[str] | None = None) -> Sums:
    """The sums of points that each belong to one component, ``label`` from 0 to ``k - 1``."""
    return _gather(points, [F.when(label == i, 0.0).otherwise(-math.inf) for i in range(k)], columns)


def _kmeans_start(points: DataFrame, k: int, seed: int) -> Sums:
    v = VectorAssembler(inputCols=points.columns, outputCol="features").transform(points)
    centres = KMeans(k=k, seed=seed).fit(v).clusterCenters()
    x = [F.col(c) for c in points.columns]
    far = [_quadratic(x, np.asarray(m), np.eye(len(x)), 1.0) for m in centres]
    nearest = F.least(*far) if len(far) > 1 else far[0]
    return _gather(points, [F.when(f == nearest, 0.0).otherwise(-math.inf) for f in far])


def assign(df: DataFrame, columns: list[str], model: Gaussians | Posterior, mean: np.ndarray) -> DataFrame:
    """``df`` with ``cluster`` and ``probability``, those of the likeliest component; null for rows with a null."""
    logs = model.scores([F.col(c).cast("double") - float(m) for c, m in zip(columns, mean, strict=True)])
    found = F.array(*logs)
    top = F.array_max(found)
    share = 1 / F.aggregate(found, F.lit(0.0), lambda s, v: s + F.exp(v - top))
    there = F.lit(True)
    for c in columns:
        there = there & F.col(c).isNotNull()
    return df.withColumns({"cluster": F.when(there, F.array_position(found, top) - 1), "probability": F.when(there, share)})


def split_start(df: DataFrame, columns: list[str], split: Column) -> Gaussians:
    """The weights, means and sample covariances of the rows where ``split`` holds and of the others: a start for
    :func:`mixture_from`, in the place of the columns themselves."""
    side = F.coalesce(split, F.lit(False)).cast("int")
    d, parts = len(columns), []
    v = df.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)), (1 - side).alias("side")).dropna()
    for r in v.groupBy("side").agg(F.count("*").alias("n"), *(F.avg(f"x{i}").alias(f"m{i}") for i in range(d)), *(F.covar_samp(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i in range(d) for j in range(d))).orderBy("side").collect():
        parts.append((r["n"], [r[f"m{i}"] for i in range(d)], [[r[f"c{i}_{j}"] or 0.0 for j in range(d)] for i in range(d)]))
    n = np.array([p[0] for p in parts], float)
    return Gaussians(n / n.sum(), np.array([p[1] for p in parts]), np.array([p[2] for p in parts]) + FLOOR * np.eye(d) * (np.array([p[0] for p in parts]) < 2)[:, None, None])


def mixture_from(df: DataFrame, columns: list[str], start: Gaussians, tolerance: float = 1e-3, most: int = 100) -> DataFrame:
    """``df`` with ``cluster`` and ``probability`` of a Gaussian mixture fitted from given weights, means and covariances (the
    inverses of precisions). Rows with a null take no part and get null."""
    points, mean = centred(df, columns)
    model, _ = maximise(points, Gaussians(start.weights, start.means - mean, start.covariances), tolerance, most)
    return assign(df, columns, model, mean)


def bayesian_mixture(df: DataFrame, columns: list[str], k: int, seed: int = 1, tolerance: float = 1e-3, most: int = 100) -> DataFrame:
    """``df`` with ``cluster`` and ``probability`` of a mixture of ``k`` Gaussians or fewer, inferred with a Dirichlet prior on
    the weights and Gaussian-Wishart priors on the components, from clusters by k-means. A component that loses its points goes
    back to its prior. Rows with a null take no part and get null; without points the clusters are null."""
    points, mean = centred(df, columns)
    if points.isEmpty():
        return df.withColumns({"cluster": F.lit(None).cast("long"), "probability": F.lit(None).cast("double")})
    model, _ = infer(points, default_prior(points, k), _kmeans_start(points, k, seed), tolerance, most)
    return assign(df, columns, model, mean)
