"""Gaussian-kernel likelihoods and sequential Bayes over them.

Kernel densities are sums over all training values. They are held as expansions: the line is cut into cells of a quarter of
a bandwidth, and a cell keeps ``TERMS`` coefficients of a polynomial that, times a Gaussian, is the whole sum for any place
in the cell. With ``s`` and ``d`` the distances of a place and of a training value from the cell's centre, in bandwidths,
``exp(-(s - d)^2 / 2) = exp(-s^2 / 2) * exp(-d^2 / 2) * exp(s * d)``, and the last factor is a power series in ``s``. A value
adds to the cells up to ``REACH`` bandwidths away, where a double underflows, so ``|s * d| < 4.9`` and what lies beyond the
last term is below 1e-11 of any kernel's term.

Values don't visit these cells one by one. A value's distance ``e`` from the centre of its own part of a cell (``PARTS`` to a
cell) is below 1/32 of a bandwidth, and all that a part's values add anywhere follows from its ``MOMENTS`` sums of
``e^i * exp(-e^2 / 2) / i!``: with ``D`` the distance of the part's centre from the cell's, they add
``exp(-D^2 / 2) * exp(s * D) * sum(moment_i * (s - D)^i)``, where ``|e * D| < 1.3`` and terms beyond the last are below 1e-16.
Read as a polynomial in ``s`` that is a product with a matrix which depends on ``D`` alone. Training reads each value once;
what follows has the size of the value range, not of the table; a likelihood is a look-up.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..plans.session import forget, spool
from .statistics import histogram, ks_1d

CLASSES = ("Stationary", "Shopper", "Mall Worker")
UNKNOWN = "Not Classified"
#: Cells of a bandwidth, bandwidths that a value reaches, and coefficients of a cell.
FINE, REACH, TERMS = 4, 38.75, 32
#: Parts of a cell that values are summed up in, sums of a part, and parts that are spread to cells at once and by one task.
PARTS, MOMENTS, CHUNK, SPREAD = 4, 20, 256, 4_096


def _long(rows: DataFrame, features: list[str], *columns: str | Column) -> DataFrame:
    """A row ``(..., feature, x)`` for each row and feature; ``x`` is null if it is no finite number."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), S.finite(F.col(f).cast("double")).alias("x")) for f in features)))
    return rows.select(*columns, each.alias("e")).select("*", "e.feature", "e.x").drop("e")


@functools.cache
def _shifts() -> np.ndarray:
    """For each place of a part in its cell the matrix from a part's sums to the coefficients of all cells in its reach."""
    reach = int(REACH * FINE)
    d = (((np.arange(PARTS) + 0.5) / PARTS - 0.5)[:, None] - np.arange(-reach, reach + 1)) / FINE
    powers = lambda x, n: np.cumprod(np.concatenate((np.ones((*x.shape, 1)), np.repeat(x[..., None], n - 1, -1)), -1), -1)
    back, on = powers(-d, MOMENTS), powers(d, TERMS)
    out = np.zeros((*d.shape, MOMENTS, TERMS))
    for i in range(MOMENTS):
        for b in range(i + 1):
            for k in range(b, TERMS):
                out[..., i, k] += math.comb(i, b) / math.factorial(k - b) * back[..., i - b] * on[..., k - b]
    out *= np.exp(-d * d / 2)[..., None, None]
    return out.transpose(0, 2, 1, 3).reshape(PARTS, MOMENTS, -1)


def _spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of parts ``(feature, k, h, n, part, m0, m1, ...)`` as coefficients ``(feature, k, h, n, cell, t0, t1, ...)``."""
    shifts, reach = _shifts(), int(REACH * FINE)
    moments, terms = [f"m{i}" for i in range(MOMENTS)], [f"t{j}" for j in range(TERMS)]
    for batch in batches:
        for keys, group in batch.groupby(["feature", "k", "h", "n"], sort=False):
            for at in range(0, len(group), CHUNK):
                chunk = group.iloc[at : at + CHUNK]
                part, m = chunk["part"].to_numpy(), chunk[moments].to_numpy()
                targets = np.floor_divide(part, PARTS)[:, None] + np.arange(-reach, reach + 1)
                cells, index = np.unique(targets, return_inverse=True)
                index, sums = index.reshape(targets.shape), np.zeros((len(cells), TERMS))
                for place in range(PARTS):
                    mine = part % PARTS == place
                    added = (m[mine] @ shifts[place]).reshape(-1, 2 * reach + 1, TERMS)
                    # Parts at the same place of their cells are in different cells.
                    for j, column in enumerate(index[mine].T):
                        sums[column] += added[:, j]
                out = pd.DataFrame(sums, columns=terms)
                for i, (name, key) in enumerate(zip(("feature", "k", "h", "n"), keys, strict=True)):
                    out.insert(i, name, key)
                out.insert(4, "cell", cells)
                yield out


def training(devices: DataFrame, features: list[str], classes: tuple[str, ...] = CLASSES, label: str = "dbscan_label") -> DataFrame:
    """``(feature, k, h, n, cell, terms)``: the expansions of each feature's density in class number ``k``.

    Of all devices with more than 10 signals and a finite value; ``h`` is Scott's bandwidth, ``n`` the number of values. A
    class with fewer than two values, or with equal ones, has no rows.
    """
    k = F.coalesce(*(F.when(F.col(label) == name, i) for i, name in enumerate(classes)))
    v = _long(devices.where("frequency > 10"), features, k.alias("k")).where("k is not null and x is not null")
    width = v.groupBy("feature", "k").agg(F.count("*").alias("n"), (F.stddev_samp("x") * F.pow(F.count("*").cast("double"), F.lit(-0.2))).alias("h")).where("h > 0")
    # One row for each feature and class.
    u = v.join(F.broadcast(width), ["feature", "k"]).withColumn("u", F.col("x") / F.col("h") * (FINE * PARTS)).withColumn("part", F.floor("u"))
    u = u.withColumn("e", (F.col("u") - F.col("part") - 0.5) / (FINE * PARTS)).withColumn("weight", F.exp(-F.col("e") * F.col("e") / 2))
    moments = spool(
        u.groupBy("feature", "k", "h", "n", "part").agg(
            *(F.sum(F.pow("e", F.lit(float(i))) * F.col("weight") / float(math.factorial(i))).alias(f"m{i}") for i in range(MOMENTS))
        )
    )
    schema = "feature string, k int, h double, n long, cell long, " + ", ".join(f"t{j} double" for j in range(TERMS))
    cells = moments.repartition(1 + moments.count() // SPREAD).mapInPandas(_spread, schema)
    sums = cells.groupBy("feature", "k", "h", "n", "cell").agg(*(F.sum(f"t{j}").alias(f"t{j}") for j in range(TERMS)))
    return spool(sums.select("feature", "k", "h", "n", "cell", F.array(*(f"t{j}" for j in range(TERMS))).alias("terms")))


def density(points: DataFrame, train: DataFrame) -> DataFrame:
    """``points`` ``(..., feature, x)`` with ``k`` and ``l``: each class's density at ``x``, a row for each class that has one.

    A null ``x`` has null densities; so far from all training values that a double underflows, the density is 0.
    """
    width = train.select("feature", "k", "h", "n").distinct()
    asked = points.join(F.broadcast(width), "feature").withColumn("u", F.col("x") / F.col("h") * FINE).withColumn("cell", F.floor("u"))
    found = asked.join(train.select("feature", "k", "cell", "terms"), ["feature", "k", "cell"], "left")
    at = (F.col("u") - F.col("cell") - 0.5) / FINE
    total = F.get("terms", F.lit(TERMS - 1))
    for j in range(TERMS - 2, -1, -1):
        total = total * F.col("s") + F.get("terms", F.lit(j))
    found = found.withColumn("s", at)
    value = F.coalesce(total * F.exp(-F.col("s") * F.col("s") / 2), F.lit(0.0)) / F.col("n") / (F.col("h") * math.sqrt(2 * math.pi))
    return found.select(*points.columns, "k", F.when(F.col("x").isNotNull(), value).alias("l"))


def likelihoods(devices: DataFrame, train: DataFrame, features: list[str], classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """``devices`` with ``l_<feature>_<k>``; null where the class or the device has no value. ``mac_address`` tells rows apart."""
    found = density(_long(devices, features, F.col("mac_address").alias("asked")), train).groupBy("asked").agg(
        *(F.max(F.when((F.col("feature") == f) & (F.col("k") == k), F.col("l"))).alias(f"l_{f}_{k}") for f in features for k in range(len(classes)))
    )
    return devices.join(found, F.col("mac_address") == F.col("asked"), "left").drop("asked")


def cumulative_ks(devices: DataFrame, features: list[str], classes: tuple[str, str] = ("Stationary", "Shopper"), steps: int = 100, label: str = "dbscan_label") -> DataFrame:
    """``(feature, d, p)``: the two-sample test between the running sums of two classes' densities on ``steps`` places from 0
    to the feature's largest value."""
    train = training(devices, features, classes, label)
    top = _long(devices, features).groupBy("feature").agg(F.max("x").alias("top"))
    grid = top.select("feature", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"), "top")
    at = density(grid.select("feature", "step", (F.col("step") * F.col("top") / (steps - 1)).alias("x")), train)
    # A feature and class has ``steps`` rows.
    order = Window.partitionBy("feature", "k").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ks_1d(at.withColumn("sum", F.sum("l").over(order)), "sum", "k", ["feature"])


def density_check(devices: DataFrame, feature: str, name: str, bins: int = 25, steps: int = 1_000, label: str = "dbscan_label") -> DataFrame:
    """``(part, place, x, density)`` of one class: the bars of a histogram (by their left edges) and the kernel density on
    ``steps`` places from 0 to 1.2 times the largest value."""
    own = devices.where(F.col(label) == name)
    top = own.agg(F.max(S.finite(F.col(feature).cast("double"))).alias("top"))
    grid = top.select(F.lit(feature).alias("feature"), F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("place"), "top")
    curve = density(grid.select("feature", "place", (F.col("place") * 1.2 * F.col("top") / (steps - 1)).alias("x")), training(devices, [feature], (name,), label))
    v = own.select(S.finite(F.col(feature).cast("double")).alias("v"))
    range_ = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    bars = histogram(v, "v", bins).join(F.broadcast(range_))
    bars = bars.select(F.lit("histogram").alias("part"), F.col("bucket").cast("int").alias("place"), (F.col("lo") + F.col("bucket") * (F.col("hi") - F.col("lo")) / bins).alias("x"), "density")
    return curve.select(F.lit("kernel").alias("part"), "place", "x", F.col("l").alias("density")).union(bars)


def sequential(
    devices: DataFrame, features: list[str], prior: tuple[float, ...] = (0.05, 0.9, 0.05), classes: tuple[str, ...] = CLASSES, label: str = "dbscan_label", trace: bool = False
) -> DataFrame:
    """``(mac_address, p_0, p_1, ...)``: posteriors of unclassified devices with over 10 signals, feature after feature.

    ``trace`` keeps every step as ``p_<class>_<step>``. A missing likelihood makes all that follows null.
    """
    train = training(devices, features, classes, label)
    d = likelihoods(devices.where((F.col("frequency") > 10) & (F.col(label) == UNKNOWN)), train, features, classes)
    n, kept = len(classes), []
    p = [F.lit(float(x)) for x in prior]
    for step, f in enumerate(features):
        w = [p[k] * F.col(f"l_{f}_{k}") for k in range(n)]
        total = sum(w[1:], w[0])
        d = d.withColumns({f"p_{k}_{step}": S.ratio(w[k], total) for k in range(n)})
        p = [F.col(f"p_{k}_{step}") for k in range(n)]
        kept += [f"p_{k}_{step}" for k in range(n)]
    return d.select("mac_address", *(kept if trace else []), *(p[k].alias(f"p_{k}") for k in range(n)))


def label_posteriors(posteriors: DataFrame, confidence: float = 0.99, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """``(mac_address, bayesian_label)``: the class above ``confidence``, else not classified."""
    label = F.coalesce(*(F.when(F.col(f"p_{k}") > confidence, name) for k, name in enumerate(classes)), F.lit(UNKNOWN))
    return posteriors.select("mac_address", label.alias("bayesian_label"))


def label_devices(devices: DataFrame, features: list[str], prior: tuple[float, ...] = (0.025, 0.95, 0.025), confidence: float = 0.99) -> DataFrame:
    """``devices`` with ``bayesian_label``; null for those that were classified before."""
    found = label_posteriors(sequential(devices, features, prior), confidence)
    return devices.join(found, "mac_address", "left")


def progress(posteriors: DataFrame, steps: int, confidence: float = 0.99) -> DataFrame:
    """``(step, stationary_share)`` from a trace."""
    cols = [F.avg(F.coalesce((F.col(f"p_0_{i}") > confidence).cast("double"), F.lit(0.0))) for i in range(steps)]
    row = posteriors.agg(F.array(*cols).alias("a"))
    return row.select(F.posexplode("a").alias("step", "stationary_share"))


def naive(devices: DataFrame, features: list[str], prior: float = 0.5, label: str = "is_out_of_hours") -> DataFrame:
    """``(mac_address, stationary, shopper)``: unnormalised products of two classes' likelihoods and priors."""
    classes = ("1", "0")
    train = training(devices.withColumn("two", F.col(label).cast("string")), features, classes, "two")
    d = likelihoods(devices.where("frequency > 10"), train, features, classes)
    product = lambda k, p: F.aggregate(F.array(*(F.col(f"l_{f}_{k}") for f in features)), F.lit(float(p)), lambda s, v: s * v)
    return d.select("mac_address", product(0, prior).alias("stationary"), product(1, 1 - prior).alias("shopper"))


def two_class(devices: DataFrame, features: list[str], prior: float = 0.5) -> DataFrame:
    """``(mac_address, shopper_probability, shopper_label)`` by out-of-hours training."""
    n = naive(devices, features, prior)
    p = S.ratio("shopper", F.col("stationary") + F.col("shopper"))
    return n.select("mac_address", p.alias("shopper_probability"), S.label_of(p).alias("shopper_label"))


def recursive(devices: DataFrame, features: list[str], prior: tuple[float, float] = (0.1, 0.9), confidence: float = 0.95, most: int = 10_000) -> DataFrame:
    """``(mac_address, round)``: devices found stationary, round by round, until a round finds none or one device at most is
    left that was seen out of hours.

    Devices seen out of hours train the stationary class; what is found leaves the rest. A round takes a device at least, and
    usually most of those to be found. More than ``most`` rounds are an error. Rounds are written to the shared folder.
    """
    found, rest, turn = [], spool(devices), 0
    while True:
        n = naive(rest, features, prior[0])
        hit = spool(n.where(S.ratio("stationary", F.col("stationary") + F.col("shopper")) > confidence).select("mac_address", F.lit(turn).alias("round")))
        found.append(hit)
        if hit.isEmpty():
            break
        last, rest, turn = rest, spool(rest.join(hit, "mac_address", "left_anti")), turn + 1
        forget(last)
        if rest.where("is_out_of_hours = 1").limit(2).count() <= 1:
            break
        if turn >= most:
            raise RuntimeError(f"no end after {most} rounds")
    return functools.reduce(DataFrame.union, found)


def bootstrap(devices: DataFrame, features: list[str], rounds: int = 5, prior: tuple[float, float] = (0.1, 0.9), confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """``(mac_address, stationary, other)``: how often a device is found stationary over resampled device tables.

    A stand-in for drawing n of n devices with replacement and keeping the distinct ones, which takes each with probability
    1 - 1/e: here a hash of device, round and seed decides for each device by itself with that probability, the same on any
    number of partitions, so the number of devices drawn varies a little more.
    """
    keep = 1 - math.exp(-1)
    # Each round reads the table several times.
    devices = spool(devices.select("mac_address", "frequency", "is_out_of_hours", *features))
    parts = []
    for i in range(rounds):
        u = F.pmod(F.xxhash64("mac_address", F.lit(i), F.lit(seed)), F.lit(1_000_000).cast("long")) / 1e6
        n = naive(devices.where(u < keep), features, prior[0])
        parts.append(n.select("mac_address", (S.ratio("stationary", F.col("stationary") + F.col("shopper")) > confidence).alias("hit")))
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return every.groupBy("mac_address").agg(n(F.col("hit")).alias("stationary"), n(~F.col("hit")).alias("other"))


def consistency(counts: DataFrame) -> DataFrame:
    """``(consistent, inconsistent, empty)`` of a bootstrap's counts."""
    return counts.agg(
        F.sum(((F.col("stationary") == 0) != (F.col("other") == 0)).cast("long")).alias("consistent"),
        F.sum(((F.col("stationary") > 0) & (F.col("other") > 0)).cast("long")).alias("inconsistent"),
        F.sum(((F.col("stationary") == 0) & (F.col("other") == 0)).cast("long")).alias("empty"),
    )
