"""Mixtures, outliers of stores and steady states against plain numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfarer.operators import markov, mixtures, outliers

COLUMNS = ["u", "v", "w"]


def sample(n: int = 240) -> np.ndarray:
    rng = np.random.default_rng(3)
    a = rng.multivariate_normal([1e3, 0, 1], [[1, 0.6, 0], [0.6, 1, 0], [0, 0, 0.3]], n)
    b = rng.multivariate_normal([1e3 + 4, 2, 0], [[0.5, 0, 0], [0, 2, 0.3], [0, 0.3, 1]], n // 2)
    return np.vstack([a, b])


@pytest.fixture(scope="module")
def points(spark):
    rows = [(i, *map(float, r)) for i, r in enumerate(sample())] + [(-1, None, 1.0, 2.0)]
    return spark.createDataFrame(rows, "id long, u double, v double, w double").repartition(3)


def em(x, w, m, c, tolerance=1e-3):
    path = []
    while True:
        log = np.stack([math.log(a) - 0.5 * np.einsum("ni,ij,nj->n", x - b, np.linalg.inv(s), x - b) - 0.5 * np.linalg.slogdet(s)[1] - x.shape[1] / 2 * math.log(2 * math.pi) for a, b, s in zip(w, m, c, strict=True)], 1)
        top = log.max(1, keepdims=True)
        whole = top + np.log(np.exp(log - top).sum(1, keepdims=True))
        r = np.exp(log - whole)
        path.append(whole.mean())
        if len(path) > 1 and path[-1] - path[-2] < tolerance:
            return w, m, c, r, path
        n = r.sum(0)
        w, m = n / len(x), r.T @ x / n[:, None]
        c = np.stack([(r[:, k, None] * (x - m[k])).T @ (x - m[k]) / n[k] + 1e-6 * np.eye(x.shape[1]) for k in range(len(n))])


def test_from_given_components(spark, points):
    x = sample()
    start = mixtures.split_start(points, COLUMNS, F.col("u") > 1_002)
    side = x[:, 0] > 1_002
    assert start.means == pytest.approx(np.array([x[side].mean(0), x[~side].mean(0)])) and start.covariances[0] == pytest.approx(np.cov(x[side].T))
    w, m, c, r, path = em(x, start.weights, start.means, start.covariances)
    centre, mean = mixtures.centred(points, COLUMNS)
    model, mine = mixtures.maximise(centre, mixtures.Gaussians(start.weights, start.means - mean, start.covariances))
    assert mine == pytest.approx(path, rel=1e-9) and all(b >= a for a, b in zip(mine, mine[1:], strict=False))
    out = {q["id"]: q for q in mixtures.mixture_from(points, COLUMNS, start).collect()}
    assert out.pop(-1)["cluster"] is None and len(out) == len(x)
    assert [out[i]["cluster"] for i in range(len(x))] == list(r.argmax(1))
    assert [out[i]["probability"] for i in range(len(x))] == pytest.approx(list(r.max(1)), rel=1e-6)
    assert model.weights == pytest.approx(w, rel=1e-6)


def variational(x, r, k, rounds):
    """Bishop's update equations and bound, each term as it is written there."""
    n_all, d = x.shape
    mean, w0, alpha0, beta0, nu0 = x.mean(0), np.linalg.inv(np.cov(x.T) + 1e-6 * np.eye(d)), 1 / k, 1.0, float(d)
    psi, path = mixtures.digamma, []
    log_b = lambda w, v: -v / 2 * np.linalg.slogdet(w)[1] - (v * d / 2 * math.log(2) + d * (d - 1) / 4 * math.log(math.pi) + sum(math.lgamma((v + 1 - i) / 2) for i in range(1, d + 1)))
    for turn in range(rounds + 1):
        n = r.sum(0)
        xb = r.T @ x / n[:, None]
        s = [(r[:, j, None] * (x - xb[j])).T @ (x - xb[j]) / n[j] for j in range(k)]
        alpha, beta, nu = alpha0 + n, beta0 + n, nu0 + n
        m = (beta0 * mean + n[:, None] * xb) / beta[:, None]
        w = [np.linalg.inv(np.linalg.inv(w0) + n[j] * s[j] + beta0 * n[j] / beta[j] * np.outer(xb[j] - mean, xb[j] - mean)) for j in range(k)]
        lam = np.array([sum(psi((nu[j] + 1 - i) / 2) for i in range(1, d + 1)) + d * math.log(2) + np.linalg.slogdet(w[j])[1] for j in range(k)])
        lpi = np.array([psi(a) - psi(alpha.sum()) for a in alpha])
        if turn:
            off = lambda j, p: (p - m[j]) @ w[j] @ (p - m[j])
            t = 0.5 * sum(n[j] * (lam[j] - d / beta[j] - nu[j] * np.trace(s[j] @ w[j]) - nu[j] * off(j, xb[j]) - d * math.log(2 * math.pi)) for j in range(k))
            t += (r * lpi).sum() - (r * np.log(np.maximum(r, 1e-300))).sum()
            t += math.lgamma(k * alpha0) - k * math.lgamma(alpha0) + (alpha0 - 1) * lpi.sum()
            t += 0.5 * sum(d * math.log(beta0 / (2 * math.pi)) + lam[j] - d * beta0 / beta[j] - beta0 * nu[j] * off(j, mean) for j in range(k))
            t += k * log_b(w0, nu0) + (nu0 - d - 1) / 2 * lam.sum() - 0.5 * sum(nu[j] * np.trace(np.linalg.inv(w0) @ w[j]) for j in range(k))
            t -= ((alpha - 1) * lpi).sum() + math.lgamma(alpha.sum()) - sum(map(math.lgamma, alpha))
            entropy = [-log_b(w[j], nu[j]) - (nu[j] - d - 1) / 2 * lam[j] + nu[j] * d / 2 for j in range(k)]
            t -= sum(0.5 * lam[j] + d / 2 * math.log(beta[j] / (2 * math.pi)) - d / 2 - entropy[j] for j in range(k))
            path.append(t / n_all)
        quad = np.stack([d / beta[j] + nu[j] * np.einsum("ni,ij,nj->n", x - m[j], w[j], x - m[j]) for j in range(k)], 1)
        log = lpi + lam / 2 - d / 2 * math.log(2 * math.pi) - quad / 2
        r_next = np.exp(log - log.max(1, keepdims=True))
        r_next /= r_next.sum(1, keepdims=True)
        if turn == rounds:
            return path, r_next
        r = r_next
    return path, r


def test_inference_against_each_term(points):
    x, k = sample(), 3
    centre, mean = mixtures.centred(points, COLUMNS)
    label = F.when(F.col("x0") > 2.0, 0).when(F.col("x1") > 0.0, 1).otherwise(2)
    own = np.where(x[:, 0] - mean[0] > 2.0, 0, np.where(x[:, 1] - mean[1] > 0, 1, 2))
    q, path = mixtures.infer(centre, mixtures.default_prior(centre, k), mixtures.hard(centre, label, k))
    want, r = variational(x - mean, np.eye(k)[own], k, len(path))
    assert path == pytest.approx(want, rel=1e-7) and all(b >= a - 1e-12 for a, b in zip(path, path[1:], strict=False)) and path[-1] - path[-2] < 1e-3
    out = {q["id"]: q for q in mixtures.assign(points, COLUMNS, q, mean).collect()}
    assert [out[i]["cluster"] for i in range(len(x))] == list(r.argmax(1))


def test_two_groups_are_told_apart(spark, points):
    out = {r["id"]: r["cluster"] for r in mixtures.bayesian_mixture(points, COLUMNS, 2).collect()}
    assert out.pop(-1) is None
    first = [out[i] for i in range(240)].count(out[0])
    assert max(first, 240 - first) > 230 and sum(out[i] != max(out.values(), key=list(out.values()).count) for i in range(240, 360)) > 110
    empty = mixtures.bayesian_mixture(points.limit(0), COLUMNS, 2)
    assert empty.count() == 0 and "cluster" in empty.columns


def test_digamma():
    assert mixtures.digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-13) and mixtures.digamma(0.5) == pytest.approx(-1.9635100260214235, abs=1e-12)


def test_outliers_of_stores(spark):
    rng = random.Random(8)
    rows = [("hot", rng.gauss(0, 0.4), rng.gauss(0, 0.4)) for _ in range(900)] + [("hot", rng.uniform(-6, 6), rng.uniform(-6, 6)) for _ in range(60)]
    rows += [("same", 1.0, 1.0)] * 12 + [("same", 1.2, 1.0), ("same", 5.0, 1.0), ("few", 0.0, 0.0), (None, 0.0, 0.0), ("few", None, 1.0), ("few", float("nan"), 1.0), ("same", -0.0, 0.0), ("same", 0.0, 0.0)]
    df = spark.createDataFrame(rows, "store_id string, x double, y double").repartition(4)
    got = {(r["store_id"], r["x"], r["y"]): (r["signals"], r["is_core"], r["is_outlier"]) for r in outliers.density_outliers(df, 0.3, 10).collect()}
    want = {}
    for s in ("hot", "same", "few"):
        mine = [(x + 0.0, y) for k, x, y in rows if k == s and x is not None and x == x]
        xy = np.array(mine)
        near = ((xy[:, None] - xy[None]) ** 2).sum(2) <= 0.3 * 0.3
        core = near.sum(1) >= 10
        for i, p in enumerate(mine):
            want[(s, *p)] = (mine.count(p), bool(core[i]), not bool((near[i] & core).any()))
    assert got == want and {v[2] for v in want.values()} == {True, False}
    assert outliers.density_outliers(df.limit(0)).count() == 0


def test_two_means_of_stores(spark):
    rng = random.Random(9)
    rows = [(s, rng.gauss(5 * rng.randint(0, 1), 1), rng.gauss(0, 1)) for s in "aab" * 80] + [("one", 2.0, 2.0)] * 5
    df = spark.createDataFrame(rows, "store_id string, x double, y double")
    got = {(r["store_id"], r["x"], r["y"]): r["cluster"] for r in outliers.two_means(df).collect()}
    for s in ("a", "b", "one"):
        xy = np.array(sorted((x, y) for k, x, y in rows if k == s))
        c = np.array([xy[0], xy[-1]])
        while True:
            far = ((xy - c[1]) ** 2).sum(1) < ((xy - c[0]) ** 2).sum(1)
            new = np.array([xy[~far].mean(0) if (~far).any() else c[0], xy[far].mean(0) if far.any() else c[1]])
            if np.abs(new - c).max() <= 1e-9:
                break
            c = new
        assert [got[(s, *p)] for p in map(tuple, xy)] == list(far.astype(int))
    assert outliers.two_means(df.limit(0)).count() == 0


def test_stationary_distribution(spark):
    rng = np.random.default_rng(4)
    m = rng.random((14, 14)) * (rng.random((14, 14)) < 0.5) + 0.2 * np.eye(14)[:, rng.permutation(14)]
    m[0], m[0, 1] = 0.0, 1.0
    m /= m.sum(1, keepdims=True)
    a = spark.createDataFrame([(f"B{i}", f"B{j}", float(m[i, j])) for i in range(14) for j in range(14) if m[i, j]], "src string, dst string, p double")
    got = {r["store_id"]: r["p"] for r in markov.stationary(a).collect()}
    values, vectors = np.linalg.eig(m.T)
    v = np.real(vectors[:, np.argmax(np.real(values))])
    assert [got[f"B{i}"] for i in range(14)] == pytest.approx(list(v / v.sum()), abs=1e-9)
    two = spark.createDataFrame([("x", "y", 1.0), ("y", "x", 1.0)], a.schema)
    assert {r["store_id"]: r["p"] for r in markov.stationary(two).collect()} == pytest.approx({"x": 0.5, "y": 0.5})
    assert markov.stationary(a.limit(0)).count() == 0
