"""Distributions, tests and scaling."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..plans.session import spool
from .dominance import below_left
from .ordering import numbered, running


def value_frequency(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("frequency"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """``(bucket, n, density)`` of equal bins from least to largest; the largest value falls into the last bin."""
    v = df.select(F.col(value).cast("double").alias("v")).where("v is not null")
    b = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("total"))
    j = v.join(F.broadcast(b)).withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    bucket = F.least(F.coalesce(F.floor(S.ratio(F.col("v") - F.col("lo"), "width")), F.lit(0).cast("long")), F.lit(bins - 1).cast("long"))
    g = j.groupBy(bucket.alias("bucket"), "width", "total").agg(F.count("*").alias("n"))
    return g.select("bucket", "n", S.ratio("n", F.col("total") * F.col("width")).alias("density"))


def log_bin(df: DataFrame, value: str, start: float = 1.0, width: float = 1.0, a: float = 2.0) -> DataFrame:
    """``(bucket, lo, hi, centre, density)`` of bins whose width grows by the factor ``a``; empty bins have density 0.

    Edges go on until one exceeds the largest value; what lies below the second edge counts in the first bin.
    """
    if a <= 1:
        raise ValueError("bins must grow")
    v = df.select(F.col(value).cast("double").alias("v")).where("v is not null")
    top = v.agg(F.max("v").alias("hi")).first()["hi"]
    if top is None:
        return df.sparkSession.createDataFrame([], "bucket long, lo double, hi double, centre double, density double")
    edges, w = [float(start)], float(width)
    while edges[-1] <= top:
        edges.append(edges[-1] + w)
        w *= a
    if len(edges) == 1:
        edges.append(edges[0] + w)
    bounds = F.array(*map(F.lit, edges))
    bucket = F.greatest(F.size(F.filter(bounds, lambda e: e <= F.col("v"))) - 1, F.lit(0)).cast("long")
    n = v.groupBy(bucket.alias("own")).agg(F.count("*").alias("n"))
    frame = df.sparkSession.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))], "bucket long, lo double, hi double")
    total = v.agg(F.count("*").alias("total"))
    j = frame.join(n, F.col("bucket") == F.col("own"), "left").join(total)
    density = F.coalesce("n", F.lit(0)) / F.col("total") / (F.col("hi") - F.col("lo"))
    return j.select("bucket", "lo", "hi", F.sqrt(F.col("lo") * F.col("hi")).alias("centre"), density.alias("density"))


def power_law_sample(spark, gamma: float, n: int, seed: int = 0) -> DataFrame:
    """``(value)``: draws of a power law from 1 on."""
    return spark.range(n).select(F.pow(1 / (1 - F.rand(seed)), F.lit(1 / gamma)).alias("value"))


def ks_1d(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """``(d, p)``, after the columns ``by``: the largest difference between the distributions of two groups (0 and 1), and its
    asymptotic probability.

    Values are counted first; running sums then go over stretches of distinct values. Null values and values that are no
    numbers are left out, a group without values gives nulls.
    """
    v = df.select(*by, F.col(value).alias("v"), F.col(group).alias("g")).where("v is not null and not isnan(v) and g in (0, 1)")
    c = v.groupBy(*by, "v").agg(F.sum((F.col("g") == 0).cast("long")).alias("a"), F.sum((F.col("g") == 1).cast("long")).alias("b"))
    r = running(c, ["v"], {"below_a": "a", "below_b": "b"}, by)
    n = c.groupBy(*by).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    j = r.join(n, list(by)) if by else r.join(F.broadcast(n))
    d = F.max(F.abs(S.ratio(F.col("below_a"), "na") - S.ratio(F.col("below_b"), "nb")))
    out = j.groupBy(*by).agg(d.alias("d"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    return out.select(*by, "d", ks_probability(F.sqrt(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb"))) * F.col("d")).alias("p"))


def ks_features(df: DataFrame, features: list[str], group: str) -> DataFrame:
    """``(feature, d, p)`` of :func:`ks_1d` for all ``features`` at once."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features)))
    long = df.select(each.alias("e"), F.col(group).alias("side"))
    return ks_1d(long.select("e.feature", "e.value", "side"), "value", "side", ["feature"])


def ks_probability(z: Column) -> Column:
    """The survival function of Kolmogorov's distribution, 100 terms."""
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * z * z)
    )
    return F.when(z < 0.05, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), terms)))


def correlation(x: Column, y: Column) -> Column:
    """The correlation of two columns that are null in the same rows; null, not an error, where one of them is constant."""
    return S.ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def ks_2d(df: DataFrame, x: str, y: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """``(d, p)``, after the columns ``by``: the two-sample statistic in the plane, the mean over both samples' points as
    origins, and its approximate probability.

    At each point of one sample the shares of both samples in its quadrants are compared; the point itself is left out and
    may then count in any quadrant, wherever it makes the difference greatest. Quadrants follow from the points below and
    left of a point (:mod:`.dominance`) and from those left of it and below it, which are running sums. Rows with nulls and
    values that are no numbers are left out; without points in both samples the result is null.
    """
    by = list(by)
    v = df.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(group).alias("g")).where("not isnan(x) and not isnan(y) and g in (0, 1)")
    side = lambda g, c: F.when(F.col("g") == g, F.col(c))
    n = v.groupBy(*by).agg(*(F.count(side(g, "x")).alias(f"n{g}") for g in (0, 1)), *(correlation(side(g, "x"), side(g, "y")).alias(f"r{g}") for g in (0, 1)))
    c = spool(v.groupBy(*by, "x", "y").agg(*(F.count(side(g, "x")).alias(f"w{g}") for g in (0, 1))))
    line = lambda a: spool(running(c.groupBy(*by, a).agg(F.sum("w0").alias("w0"), F.sum("w1").alias("w1")), [a], {f"{a}0": "w0", f"{a}1": "w1"}, by).drop("w0", "w1"))
    p = spool(below_left(c, "x", "y", ["w0", "w1"], by)).join(line("x"), [*by, "x"]).join(line("y"), [*by, "y"])
    p = p.join(n, by) if by else p.join(F.broadcast(n))

    def shares(g: int) -> list[Column]:
        """Points of sample ``g`` in the four quadrants, lower left last."""
        n, left, low, both = (F.col(c) for c in (f"n{g}", f"x{g}", f"y{g}", f"below_w{g}"))
        return [n - left - low + both, left - both, low - both, both]

    def apart(own: int) -> Column:
        """The greatest difference at a point of sample ``own``."""
        n, m, every = F.col(f"n{own}"), F.col(f"n{1 - own}"), []
        for i, (mine, theirs) in enumerate(zip(shares(own), shares(1 - own), strict=True)):
            mine, theirs = (mine - (1 if i == 3 else 0)) / n, theirs / m
            every += [mine + 1 / n - theirs, theirs - mine]
        return F.when((F.col(f"w{own}") > 0) & (m > 0), F.greatest(*every))

    best = p.groupBy(*by).agg(F.max(apart(0)).alias("d0"), F.max(apart(1)).alias("d1"), *(F.max(k).alias(k) for k in ("n0", "n1", "r0", "r1")))
    return _plane_test(best, by)


def _plane_test(best: DataFrame, by: Sequence[str]) -> DataFrame:
    """``(d, p)``, after the columns ``by``, from the greatest differences ``d0`` and ``d1`` at the samples' points, their numbers and
    correlations."""
    size = F.sqrt(F.col("n0") * F.col("n1") / (F.col("n0") + F.col("n1")))
    spread = F.sqrt(1 - (F.col("r0") * F.col("r0") + F.col("r1") * F.col("r1")) / 2)
    best = best.select(*by, ((F.col("d0") + F.col("d1")) / 2).alias("d"), size.alias("size"), spread.alias("spread"))
    return best.select(*by, "d", ks_probability(F.col("d") * F.col("size") / (1 + F.col("spread") * (0.25 - 0.75 / F.col("size")))).alias("p"))


def normal_points(n: int) -> Column:
    """An array of ``n`` points ``(x, y)`` of a standard normal sample: radii by even quantiles, angles by the golden section."""
    turn = (math.sqrt(5) - 1) / 2
    radius = lambda k: F.sqrt(-2 * F.log((k + 0.5) / n))
    angle = lambda k: 2 * math.pi * (k * turn - F.floor(k * turn))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct((radius(k) * F.cos(angle(k))).alias("x"), (radius(k) * F.sin(angle(k))).alias("y")))


#: Places of a device in one row, at most.
PLACES_IN_ROW = 1_024


def ks_normal(signals: DataFrame, points: int = 1_000) -> DataFrame:
    """``(mac_address, d, p)``: each device's places, less their mean, against a fixed normal sample of ``points``.

    A device of up to ``PLACES_IN_ROW`` places is a row that meets the normal sample where it lies; one of more is tested by
    :func:`ks_2d`, where the sample adds less than a row for each of its own.
    """
    s = signals.select("mac_address", "x", "y").where("x is not null and y is not null")
    mean = spool(s.groupBy("mac_address").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count("*").alias("many")))
    own = s.join(mean, "mac_address").select("mac_address", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"), "many")
    fixed = signals.sparkSession.range(1).select(F.explode(normal_points(points)).alias("p")).select("p.x", "p.y")
    qx, qy = np.array([tuple(r) for r in fixed.collect()], float).reshape(-1, 2).T
    r1 = fixed.agg(correlation(F.col("x"), F.col("y"))).first()[0]

    def counted(x: np.ndarray, y: np.ndarray, ox: np.ndarray, oy: np.ndarray) -> list[np.ndarray]:
        """How many points ``x, y`` lie in the quadrants of the origins, lower left last."""
        left, low = np.searchsorted(np.sort(x), ox, "right"), np.searchsorted(np.sort(y), oy, "right")
        both = ((x <= ox[:, None]) & (y <= oy[:, None])).sum(1)
        return [len(x) - left - low + both, left - both, low - both, both]

    def apart(mine: list[np.ndarray], theirs: list[np.ndarray], n: int, m: int) -> float:
        every = []
        for i, (a, b) in enumerate(zip(mine, theirs, strict=True)):
            a, b = (a - (1 if i == 3 else 0)) / n, b / m
            every += [(a + 1 / n - b).max(), (b - a).max()]
        return float(max(every))

    normal = counted(qx, qy, qx, qy)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs, ys = b.column("xs"), b.column("ys")
            at, x, y = xs.offsets.to_numpy() - xs.offsets[0].as_py(), xs.flatten().to_numpy(), ys.flatten().to_numpy()
            d0, d1 = [], []
            for i, j in zip(at[:-1], at[1:], strict=True):
                px, py = x[i:j], y[i:j]
                d0.append(apart(counted(px, py, px, py), counted(qx, qy, px, py), j - i, points) if i < j else None)
                d1.append(apart(normal, counted(px, py, qx, qy), points, j - i) if i < j else None)
            columns = [b.column("mac_address"), b.column("n0"), b.column("r0"), pa.array(d0, pa.float64()), pa.array(d1, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["mac_address", "n0", "r0", "d0", "d1"])

    number = ~F.isnan("x") & ~F.isnan("y")
    x, y = F.when(number, F.col("x")), F.when(number, F.col("y"))
    rows = own.where(F.col("many") <= PLACES_IN_ROW).groupBy("mac_address").agg(F.count(x).alias("n0"), correlation(x, y).alias("r0"), F.collect_list(x).alias("xs"), F.collect_list(y).alias("ys"))
    best = rows.mapInArrow(test, "mac_address string, n0 long, r0 double, d0 double, d1 double")
    best = best.withColumns({"n1": F.lit(points).cast("long"), "r1": F.lit(r1).cast("double")})
    found = _plane_test(best, ["mac_address"])
    large = mean.where(F.col("many") > PLACES_IN_ROW).select("mac_address")
    if large.isEmpty():
        return found
    some = own.where(F.col("many") > PLACES_IN_ROW).select("mac_address", "x", "y", F.lit(0).alias("g"))
    sample = large.select("mac_address", F.explode(normal_points(points)).alias("p")).select("mac_address", "p.x", "p.y", F.lit(1).alias("g"))
    return found.union(ks_2d(some.union(sample), "x", "y", "g", ["mac_address"]))


#: Points of a block of the energy statistic: two blocks' distances are what a task holds.
BLOCK = 1_000


def energies(df: DataFrame, columns: list[str], group: str, rounds: int = 0, seed: int = 0, logarithmic: bool = True) -> DataFrame:
    """``(round, e)``: the energy statistic of two groups (0 and 1) of standardised points, for the real labels (round 0) and
    for ``rounds`` random relabellings that keep the groups' sizes.

    The mean of the logarithms of distances (or of distances) between the groups less half the means within each. Points
    with a null are left out, and so are logarithms of pairs in one place. A relabelling gives group 0 to the first points in
    the order of a seeded hash, so it doesn't depend on partitions. Blocks of points meet two by two; a meeting returns sums
    over its pairs for all labellings at once.
    """
    v = df.select(*columns, group).where(F.col(group).isin(0, 1)).dropna(subset=columns)
    c = v.groupBy(*columns, group).agg(F.count("*").alias("copies"))
    every = c.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).withColumn("id", F.xxhash64(*columns, group, "copy"))
    z = spool(zscore(every, columns).select("id", *columns, (F.col(group) == 0).alias("real")))
    counts = z.agg(F.count("*").alias("n"), F.sum(F.col("real").cast("long")).alias("n0")).first()
    n, n0 = counts["n"], counts["n0"] or 0
    turns = z.select("id", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")) if rounds else None
    if rounds:
        place = numbered(turns.withColumn("h", F.xxhash64("id", "round", F.lit(seed))), ["h", "id"], "place", ["round"])
        first = place.where(F.col("place") < n0).groupBy("id").agg(F.collect_list("round").alias("first"))
        z = z.join(first, "id", "left")
    else:
        z = z.withColumn("first", F.lit(None).cast("array<int>"))
    blocks = -(-n // BLOCK) or 1
    z = z.withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)))
    z = z.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    z = z.withColumns({"low": F.least("block", "with"), "high": F.greatest("block", "with")})

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        xy, label = pdf[columns].to_numpy(float), np.zeros((len(pdf), rounds + 1))
        label[:, 0] = pdf["real"]
        for i, f in enumerate(pdf["first"]):
            if f is not None:
                label[i, f] = 1
        low = (pdf["block"] == pdf["low"]).to_numpy()
        a, b = (low, ~low) if pdf["low"].iloc[0] != pdf["high"].iloc[0] else (low, low)
        d = np.sqrt(((xy[a][:, None] - xy[b][None]) ** 2).sum(2))
        if logarithmic:
            d = np.log(d, out=np.zeros_like(d), where=d > 0)
        # In a block of its own each pair is there twice.
        d *= 0.5 if a is b else 1.0
        la, lb = label[a], label[b]
        both = ((d @ lb) * la).sum(0)
        one, other, whole = d.sum(1) @ la, d.sum(0) @ lb, d.sum()
        return pd.DataFrame({"round": np.arange(rounds + 1), "s00": both, "s01": one + other - 2 * both, "s11": whole - one - other + both})

    sums = z.groupBy("low", "high").applyInPandas(meet, "round int, s00 double, s01 double, s11 double").groupBy("round").agg(*(F.sum(k).alias(k) for k in ("s00", "s01", "s11")))
    m0, m1 = float(n0), float(n - n0)
    return sums.select("round", (S.ratio("s01", F.lit(m0 * m1)) - S.ratio("s00", F.lit(m0 * m0)) - S.ratio("s11", F.lit(m1 * m1))).alias("e"))


def energy_statistic(df: DataFrame, columns: list[str], group: str, logarithmic: bool = True) -> DataFrame:
    """``(statistic)`` of :func:`energies` for the real labels."""
    return energies(df, columns, group, logarithmic=logarithmic).select(F.col("e").alias("statistic"))


def energy_test(df: DataFrame, columns: list[str], group: str, rounds: int = 99, seed: int = 0, logarithmic: bool = True) -> DataFrame:
    """``(statistic, p, shape, location, scale, p_fit)``: the energy statistic, the share of ``rounds`` relabellings that reach
    it, the extreme-value distribution fitted to them, and that distribution's probability above the statistic."""
    e = [r["e"] for r in energies(df, columns, group, rounds, seed, logarithmic).orderBy("round").collect()]
    spark, kind = df.sparkSession, "statistic double, p double, shape double, location double, scale double, p_fit double"
    if not e or e[0] is None:
        return spark.createDataFrame([(None,) * 6], kind)
    fit = extreme_value_fit(np.array(e[1:])) if rounds > 2 else None
    p = sum(x >= e[0] for x in e[1:]) / rounds if rounds else None
    return spark.createDataFrame([(e[0], p, *(fit or (None,) * 3), extreme_value_above(e[0], *fit) if fit else None)], kind)


def _extreme_loss(p: np.ndarray, x: np.ndarray) -> float:
    """Negative log-likelihood of a generalised extreme-value distribution: shape, location, logarithm of the scale."""
    shape, location, log_scale = p
    z = (x - location) / math.exp(log_scale)
    if abs(shape) < 1e-9:
        return float(len(x) * log_scale + (z + np.exp(-z)).sum())
    t = 1 + shape * z
    if (t <= 0).any():
        return math.inf
    return float(len(x) * log_scale + ((1 + 1 / shape) * np.log(t) + t ** (-1 / shape)).sum())


def extreme_value_fit(x: np.ndarray, steps: int = 100) -> tuple[float, float, float] | None:
    """``(shape, location, scale)`` of greatest likelihood, by damped Newton steps from the moments of a Gumbel distribution;
    null if all values are the same. A positive shape has a heavy upper tail."""
    spread = float(np.std(x))
    if not spread > 0:
        return None
    y = (x - x.mean()) / spread
    scale = math.sqrt(6) / math.pi
    p, h, damp = np.array([0.0, -np.euler_gamma * scale, math.log(scale)]), 1e-4, 1e-3
    now = _extreme_loss(p, y)
    unit = np.eye(3) * h
    for _ in range(steps):
        f = lambda *moves: _extreme_loss(p + sum(moves), y)  # noqa: E731, B023
        slope = np.array([(f(u) - f(-u)) / (2 * h) for u in unit])
        curve = np.array([[(f(u, v) - f(u, -v) - f(-u, v) + f(-u, -v)) / (4 * h * h) for v in unit] for u in unit])
        if not (np.isfinite(slope).all() and np.isfinite(curve).all()):
            break
        values, vectors = np.linalg.eigh(curve)
        while damp < 1e12:
            step = vectors @ ((vectors.T @ slope) / (np.abs(values) + damp))
            new = _extreme_loss(p - step, y)
            if new <= now:
                break
            damp *= 10
        else:
            break
        p, moved, damp = p - step, now - new, max(damp / 10, 1e-9)
        now = new
        if moved < 1e-12 * max(1.0, abs(now)) and np.abs(step).max() < 1e-8:
            break
    return float(p[0]), float(p[1] * spread + x.mean()), float(math.exp(p[2]) * spread)


def extreme_value_above(value: float, shape: float, location: float, scale: float) -> float:
    """The probability of more than ``value``."""
    z = (value - location) / scale
    if abs(shape) < 1e-9:
        return -math.expm1(-math.exp(-z))
    t = 1 + shape * z
    if t <= 0:
        return 0.0 if shape < 0 else 1.0
    return -math.expm1(-(t ** (-1 / shape)))


def zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with each column less its mean over its population deviation; a constant column becomes 0."""
    stats = df.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("dev", F.stddev_pop))))
    j = df.join(F.broadcast(stats))
    z = {c: F.when(F.col(f"dev_{c}") > 0, (F.col(c) - F.col(f"mean_{c}")) / F.col(f"dev_{c}")).otherwise(F.col(c) - F.col(f"mean_{c}")) for c in columns}
    return j.withColumns(z).select(df.columns)


def matrix_correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(r)`` of two matrices ``(i, j, value)`` over all cells of either; a missing cell is 0."""
    j = a.select("i", "j", F.col("value").alias("va")).join(b.select("i", "j", F.col("value").alias("vb")), ["i", "j"], "full")
    return j.agg(F.corr(F.coalesce("va", F.lit(0.0)), F.coalesce("vb", F.lit(0.0))).alias("r"))


def pca_variance(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(component, ratio, singular_value)`` from the covariances, which Spark gathers in one aggregation."""
    k = len(columns)
    row = df.dropna(subset=columns).agg(
        F.count("*").alias("n"), *(F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k))
    ).first()
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    values = np.clip(np.linalg.eigvalsh(cov)[::-1], 0, None)
    total = values.sum() or 1.0
    rows = [(i, float(v / total), math.sqrt(v * max(0, row["n"] - 1))) for i, v in enumerate(values)]
    return df.sparkSession.createDataFrame(rows, "component int, ratio double, singular_value double")


def by_manufacturer(devices: DataFrame, feature: str, least: int = 70) -> DataFrame:
    """``(manufacturer, n, mean, deviation)`` of manufacturers with at least ``least`` devices."""
    g = devices.groupBy("manufacturer").agg(F.count("*").alias("n"), F.avg(feature).alias("mean"), F.stddev_samp(feature).alias("deviation"))
    return g.where(F.col("n") >= least)


def dfa(signals: DataFrame, least: int = 32) -> DataFrame:
    """``(mac_address, exponent)``: detrended fluctuation analysis of each track's distances from its centre; null if too short."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["date_time", "event_id"])
        xy = pdf[["x", "y"]].to_numpy(float)
        walk = np.cumsum((r := np.hypot(*(xy - xy.mean(0)).T)) - r.mean())
        n, out = len(walk), None
        if n >= least:
            sizes = np.unique(np.floor(np.logspace(np.log10(4), np.log10(n / 4), 12)).astype(int))
            fluct = []
            for s in sizes:
                parts = walk[: n // s * s].reshape(-1, s)
                t = np.arange(s) - (s - 1) / 2
                slope = parts @ t / (t @ t)
                rest = parts - parts.mean(1, keepdims=True) - slope[:, None] * t
                fluct.append(np.sqrt((rest**2).mean()))
            good = np.array(fluct) > 0
            if good.sum() > 1:
                out = float(np.polyfit(np.log(sizes[good]), np.log(np.array(fluct)[good]), 1)[0])
        return pd.DataFrame({"mac_address": pdf["mac_address"].iloc[:1], "exponent": pd.array([out], "Float64")})

    return signals.select("mac_address", "date_time", "event_id", "x", "y").groupBy("mac_address").applyInPandas(one, "mac_address string, exponent double")
