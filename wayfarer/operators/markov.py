"""Markov chains, mixtures of them, and hidden Markov models over store sequences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..plans.session import forget, spool


def counts(signals: DataFrame, on: str = "store_id", returns: bool = True) -> DataFrame:
    """``(mac_address, src, dst, n)``: moves of each device; without ``returns`` moves within a state are left out."""
    s = signals.where(F.col(on).isNotNull()).select("mac_address", "date_time", "event_id", F.col(on).alias("src"))
    s = s.withColumn("dst", F.lead("src").over(S.track())).where("dst is not null")
    return (s if returns else s.where("src <> dst")).groupBy("mac_address", "src", "dst").agg(F.count("*").alias("n"))


def transitions(signals: DataFrame, on: str = "store_id", returns: bool = True) -> DataFrame:
    """``(src, dst, p)``: moves from a state as shares; a state without moves has no row."""
    n = counts(signals, on, returns).groupBy("src", "dst").agg(F.sum("n").alias("n"))
    return n.select("src", "dst", (F.col("n") / F.sum("n").over(Window.partitionBy("src"))).alias("p"))


def initial(signals: DataFrame, on: str = "store_id") -> DataFrame:
    """``(store_id, n, p)``: the devices that begin in each state; 0 for states where none begins."""
    s = signals.where(F.col(on).isNotNull())
    first = s.groupBy("mac_address").agg(F.min_by(on, F.struct("date_time", "event_id")).alias("state"))
    n = first.groupBy("state").agg(F.count("*").alias("n"))
    every = s.select(F.col(on).alias("store_id")).distinct()
    j = every.join(n, F.col("store_id") == F.col("state"), "left").select("store_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return j.select("store_id", "n", S.ratio("n", F.sum("n").over(Window.partitionBy())).alias("p"))


def step(pi: DataFrame, a: DataFrame) -> DataFrame:
    """``(store_id, p)`` one move on from ``pi``."""
    return pi.select(F.col("store_id").alias("src"), F.col("p").alias("q")).join(a, "src").groupBy(F.col("dst").alias("store_id")).agg(F.sum(F.col("q") * F.col("p")).alias("p"))


def steady_state(pi: DataFrame, a: DataFrame, repeats: int = 10) -> DataFrame:
    """``(store_id, p)`` after ``repeats`` moves."""
    a = spool(a)
    for i in range(repeats):
        pi = step(pi, a)
        if i % 5 == 4:
            pi = spool(pi)
    return pi


def stationary(a: DataFrame, size: int = 6, tolerance: float = 1e-10, most: int = 100) -> DataFrame:
    """``(store_id, p)``: the distribution that a move leaves as it is, the left eigenvector of the largest eigenvalue.

    Arnoldi's method: each vector is a move of the last one, made orthogonal to those before; products with the matrix are
    joins, and only the small matrix of their coefficients comes to the driver. From its eigenvector the next ``size`` vectors
    start, until the residual is at most ``tolerance``; it is an error if it isn't after ``most`` such turns. States without moves
    away lose what reaches them; where the chain falls apart the result is one of its distributions. No moves give no rows.
    """
    a = spool(a)
    states = spool(a.select(F.col("src").alias("store_id")).union(a.select("dst")).distinct())
    n = states.count()
    now = spool(states.withColumn("p", F.lit(1.0 / max(1, n))))
    for _ in range(most):
        norm = now.agg(F.sqrt(F.sum(F.col("p") * F.col("p")))).first()[0]
        if not norm:
            return now
        basis, h, k = spool(now.select("store_id", F.array(F.col("p") / norm).alias("q"))), np.zeros((size + 1, size)), 0
        while k < size:
            moved = step(basis.select("store_id", F.get("q", F.lit(k)).alias("p")), a).withColumnRenamed("p", "w")
            both = spool(basis.join(moved, "store_id", "left").select("store_id", "q", F.coalesce("w", F.lit(0.0)).alias("w")))
            # Twice, as once loses digits.
            for _again in range(2):
                dots = both.agg(*(F.sum(F.col("w") * F.get("q", F.lit(i))).alias(f"h{i}") for i in range(k + 1))).first()
                h[: k + 1, k] += np.array(dots)
                both = both.withColumn("w", sum((F.get("q", F.lit(i)) * -float(dots[i]) for i in range(k + 1)), F.col("w")))
            h[k + 1, k] = rest = both.agg(F.sqrt(F.sum(F.col("w") * F.col("w")))).first()[0]
            k += 1
            if rest < 1e-14:
                break
            last, basis = basis, spool(both.select("store_id", F.concat("q", F.array(F.col("w") / rest)).alias("q")))
            forget(last)
        values, vectors = np.linalg.eig(h[:k, :k])
        top = int(np.argmax(np.abs(values)))
        y = np.real(vectors[:, top] / vectors[np.argmax(np.abs(vectors[:, top])), top])
        residual = abs(h[k, k - 1] * y[-1]) / np.linalg.norm(y)
        ritz = basis.select("store_id", sum((F.get("q", F.lit(i)) * float(y[i]) for i in range(1, k)), F.get("q", F.lit(0)) * float(y[0])).alias("p"))
        total = ritz.agg(F.sum("p")).first()[0]
        now = spool(ritz.select("store_id", (F.col("p") / (total or 1.0)).alias("p")))
        if residual <= tolerance:
            return now
    raise RuntimeError(f"residual {residual} after {most} turns")


def residuals(pi: DataFrame, a: DataFrame, repeats: int = 10) -> DataFrame:
    """``(step, residual)``: the squared change of each move."""
    spark, rows = pi.sparkSession, []
    a = spool(a)
    for i in range(repeats):
        new = spool(step(pi, a))
        j = new.select("store_id", F.col("p").alias("q")).join(pi.select("store_id", "p"), "store_id", "full")
        change = F.coalesce("q", F.lit(0.0)) - F.coalesce("p", F.lit(0.0))
        rows.append((i, j.agg(F.sum(change * change)).first()[0] or 0.0))
        pi = new
    return spark.createDataFrame(rows, "step int, residual double")


def ingoing(a: DataFrame) -> DataFrame:
    return a.groupBy(F.col("dst").alias("store_id")).agg(F.sum("p").alias("ingoing"))


def process(signals: DataFrame, directory: DataFrame, repeats: int = 10) -> DataFrame:
    """The directory with ``pi``, the chance one move on (``next``) and after many (``steady``)."""
    a, pi = transitions(signals), initial(signals).select("store_id", "p")
    out = directory.join(pi.toDF("store_id", "pi"), "store_id", "left")
    return out.join(step(pi, a).toDF("store_id", "next"), "store_id", "left").join(steady_state(pi, a, repeats).toDF("store_id", "steady"), "store_id", "left")


def mixture_step(own: DataFrame, weights: DataFrame, start: DataFrame, a: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One round of expectation maximisation for a mixture of chains.

    ``own`` is ``(mac_address, src, dst, n, first)``; ``weights (k, w)``, ``start (k, state, b)``, ``a (k, src, dst, p)``.
    Gives responsibilities ``(mac_address, k, gamma)`` and the new weights, starts and chains; moves get one more each.
    """
    first = own.groupBy("mac_address").agg(F.first("first").alias("state"))
    moves = own.join(a, ["src", "dst"]).groupBy("mac_address", "k").agg(F.sum(F.col("n") * F.log("p")).alias("ll"))
    ll = first.join(start, "state").join(weights, "k").join(moves, ["mac_address", "k"], "left")
    ll = ll.select("mac_address", "k", (F.log("w") + F.log("b") + F.coalesce("ll", F.lit(0.0))).alias("ll"))
    w = Window.partitionBy("mac_address")
    e = F.exp(F.col("ll") - F.max("ll").over(w))
    gamma = spool(ll.select("mac_address", "k", (e / F.sum(e).over(w)).alias("gamma")))
    new_w = gamma.groupBy("k").agg(F.sum("gamma").alias("s")).select("k", (F.col("s") / F.sum("s").over(Window.partitionBy())).alias("w"))
    s = gamma.join(first, "mac_address").groupBy("k", "state").agg(F.sum("gamma").alias("s"))
    new_b = s.select("k", "state", ((F.col("s") + 1e-9) / F.sum(F.col("s") + 1e-9).over(Window.partitionBy("k"))).alias("b"))
    grid = a.select("k", "src", "dst")
    n = own.join(gamma, "mac_address").groupBy("k", "src", "dst").agg(F.sum(F.col("gamma") * F.col("n")).alias("s"))
    n = grid.join(n, ["k", "src", "dst"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)) + 1)
    new_a = n.select("k", "src", "dst", (F.col("s") / F.sum("s").over(Window.partitionBy("k", "src"))).alias("p"))
    return gamma, new_w, new_b, new_a


def mixture(signals: DataFrame, k: int = 2, rounds: int = 5, on: str = "store_id", seed: int = 0) -> DataFrame:
    """``(mac_address, k, gamma)``: responsibilities of ``k`` chains for each device. States are a dimension, so the
    chains' matrices are small tables; counts stay by device."""
    s = signals.where(F.col(on).isNotNull())
    first = s.groupBy("mac_address").agg(F.min_by(on, F.struct("date_time", "event_id")).alias("first"))
    own = spool(counts(signals, on).join(first, "mac_address"))
    spark = signals.sparkSession
    ks = spark.range(k).select(F.col("id").cast("int").alias("k"))
    states = spool(s.select(F.col(on).alias("state")).distinct())
    u = lambda *c: 0.05 + F.pmod(F.xxhash64(*c, F.lit(seed)), F.lit(1000).cast("long")) / 1000
    a = ks.join(states.toDF("src")).join(states.toDF("dst")).withColumn("p", u("k", "src", "dst"))
    a = spool(a.select("k", "src", "dst", (F.col("p") / F.sum("p").over(Window.partitionBy("k", "src"))).alias("p")))
    b = ks.join(states).select("k", "state", (F.lit(1.0) / F.count("*").over(Window.partitionBy("k"))).alias("b"))
    w = ks.select("k", F.lit(1.0 / k).alias("w"))
    for _ in range(rounds):
        gamma, w, b, a = mixture_step(own, w, b, a)
        w, b, a = spool(w), spool(b), spool(a)
    return gamma


def _forward_backward(codes: np.ndarray, pi: np.ndarray, a: np.ndarray, b: np.ndarray):
    n, k = len(codes), len(pi)
    alpha, beta, scale = np.zeros((n, k)), np.ones((n, k)), np.zeros(n)
    alpha[0] = pi * b[:, codes[0]]
    scale[0] = alpha[0].sum()
    alpha[0] /= scale[0]
    for t in range(1, n):
        alpha[t] = (alpha[t - 1] @ a) * b[:, codes[t]]
        scale[t] = alpha[t].sum()
        alpha[t] /= scale[t]
    for t in range(n - 2, -1, -1):
        beta[t] = a @ (b[:, codes[t + 1]] * beta[t + 1]) / scale[t + 1]
    gamma = alpha * beta
    gamma /= gamma.sum(1, keepdims=True)
    xi = np.zeros((k, k))
    for t in range(n - 1):
        xi += alpha[t][:, None] * a * (b[:, codes[t + 1]] * beta[t + 1])[None] / scale[t + 1]
    return gamma, xi


def _viterbi(codes: np.ndarray, pi: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    tiny = 1e-300
    la, lb, best, back = np.log(a + tiny), np.log(b + tiny), np.log(pi + tiny) + np.log(b[:, codes[0]] + tiny), []
    for c in codes[1:]:
        s = best[:, None] + la
        back.append(s.argmax(0))
        best = s.max(0) + lb[:, c]
    path = [int(best.argmax())]
    for p in reversed(back):
        path.append(int(p[path[-1]]))
    return np.array(path[::-1])


def hidden_states(signals: DataFrame, k: int = 2, rounds: int = 5, on: str = "store_id", seed: int = 0) -> DataFrame:
    """``(mac_address, label, states)``: a hidden Markov model over stores; the label is the largest state of the likeliest path.

    Devices' sequences are expected side by side in tasks, and only the summed counts, of the size of the model, meet.
    """
    s = signals.where(F.col(on).isNotNull())
    names = sorted(r[0] for r in s.select(on).distinct().collect())  # a dimension of some hundred stores
    if not names:
        return signals.sparkSession.createDataFrame([], "mac_address string, label int, states array<int>")
    code = F.array_position(F.array(*map(F.lit, names)), F.col(on)).cast("int") - 1
    seq = s.groupBy("mac_address").agg(F.sort_array(F.collect_list(F.struct("date_time", "event_id", code.alias("c")))).alias("q"))
    seq = spool(seq.select("mac_address", F.transform("q", lambda q: q["c"]).alias("codes")))
    rng, m = np.random.default_rng(seed), len(names)
    pi, a, b = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(m), k)
    for _ in range(rounds):

        def expect(batches, model=(pi, a, b)):
            g0, xi, e = np.zeros(k), np.zeros((k, k)), np.zeros((k, m))
            for batch in batches:
                for codes in batch["codes"]:
                    gamma, x = _forward_backward(np.asarray(codes), *model)
                    g0 += gamma[0]
                    xi += x
                    np.add.at(e.T, np.asarray(codes), gamma)
            flat = np.concatenate([g0, xi.ravel(), e.ravel()])
            yield pd.DataFrame({"i": np.arange(len(flat)), "v": flat})

        sums = seq.mapInPandas(expect, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()["v"].to_numpy()
        pi, a, b = sums[:k] + 1e-9, sums[k : k + k * k].reshape(k, k) + 1e-9, sums[k + k * k :].reshape(k, m) + 1e-9
        pi, a, b = pi / pi.sum(), a / a.sum(1, keepdims=True), b / b.sum(1, keepdims=True)

    def decode(batches, model=(pi, a, b)):
        for batch in batches:
            paths = [_viterbi(np.asarray(c), *model) for c in batch["codes"]]
            yield pd.DataFrame({"mac_address": batch["mac_address"], "label": [int(p.max()) for p in paths], "states": [p.tolist() for p in paths]})

    return seq.mapInPandas(decode, "mac_address string, label int, states array<int>")
