"""Smaller analyses over signals, features and labels: gaps, slopes, groups, encodings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..schema import MALLS
from . import cleaning, features, flows, statistics
from .ordering import numbered


def analysis_ready(devices: DataFrame, columns: list[str], least: int = 10) -> DataFrame:
    """Devices with more than ``least`` signals whose ``columns`` are all there; an infinite or NaN value counts as missing."""
    finite = devices.withColumns({c: S.finite(F.col(c).cast("double")) for c in columns})
    return finite.where(F.col("frequency") > least).dropna(subset=columns)


def slopes(signals: DataFrame) -> DataFrame:
    """``(event_id, slope)``: the change of y over that of x to the device's next signal; null without a change of x."""
    w = S.track()
    return signals.select("event_id", S.ratio(F.lead("y").over(w) - F.col("y"), F.lead("x").over(w) - F.col("x")).alias("slope"))


def with_directory(signals: DataFrame, directory: DataFrame, suffix: str = "_actual") -> DataFrame:
    """Signals with their store's columns from the directory under ``suffix``; null without a store in it."""
    renamed = directory.select("store_id", *(F.col(c).alias(c + suffix) for c in directory.columns if c != "store_id"))
    return signals.join(renamed, "store_id", "left")


def gaps(signals: DataFrame, manufacturer: str) -> DataFrame:
    """``(mac_address, event_id, gap)``: seconds to the next signal, for devices of one manufacturer."""
    own = signals.where(F.col("manufacturer") == manufacturer)
    gap = S.seconds_between("date_time", F.lead("date_time").over(S.track()))
    return own.select("mac_address", "event_id", gap.alias("gap")).where("gap is not null")


def without_store(signals: DataFrame) -> DataFrame:
    """``(mac_address, event_id, x, y)`` of signals that are in no store."""
    return signals.where("store_id is null").select("mac_address", "event_id", "x", "y")


def manufacturers_of(signals: DataFrame, some: DataFrame) -> DataFrame:
    """``(manufacturer, devices)`` of the devices in ``some``, such as those seen twice at one time."""
    own = signals.join(some.select("mac_address").distinct(), "mac_address", "left_semi")
    return own.groupBy("manufacturer").agg(F.count_distinct("mac_address").alias("devices"))


def step_speeds(signals: DataFrame) -> DataFrame:
    """``(mac_address, event_id, speed)``: each step's length over its seconds; null for a step within a second."""
    s = features.steps(signals)
    return s.where("x1 is not null").select("mac_address", "event_id", S.ratio(F.col("d"), F.col("ds").cast("double")).alias("speed"))


def largest_groups(rows: DataFrame, by: str, n: int) -> DataFrame:
    """The rows of the ``n`` most frequent values of ``by``; of equally frequent ones the first by value."""
    top = rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("count")).orderBy(F.col("count").desc(), by).limit(n)
    return rows.join(top.select(by), by, "left_semi")


def volume_by_manufacturer(signals: DataFrame, n: int = 30, minutes: int = 15) -> DataFrame:
    """``(manufacturer, bin, signals, devices)`` of the ``n`` manufacturers with the most devices."""
    own = signals.select("mac_address", "manufacturer").distinct()
    top = largest_groups(own, "manufacturer", n).select("manufacturer").distinct()
    binned = signals.join(top, "manufacturer", "left_semi").withColumn("bin", S.time_bin("date_time", minutes))
    return binned.groupBy("manufacturer", "bin").agg(F.count("*").alias("signals"), F.count_distinct("mac_address").alias("devices"))


def by_mall(signals: DataFrame, measure, value: str) -> DataFrame:
    """``(location, n, mean, std)`` of what ``measure`` gives for each device, mall by mall."""
    of = signals.select("mac_address", "location").distinct()
    return measure(signals).join(of, "mac_address").groupBy("location").agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")
    )


def group_statistics(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """``(by, n, mean_<c>, std_<c>)`` for each group."""
    each = [f(c).alias(f"{name}_{c}") for c in columns for name, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return rows.groupBy(by).agg(F.count("*").alias("n"), *each)


def likeliest_start(initial: DataFrame) -> DataFrame:
    """``(store_id, p)`` of the store that most tracks begin in; of several the first by name."""
    return initial.select("store_id", "p").orderBy(F.col("p").desc(), "store_id").limit(1)


def encode_labels(rows: DataFrame, column: str) -> DataFrame:
    """``(column, code)``: distinct values numbered from 0 in order.

    The order is a prefix count over stretches of the distinct values.
    """
    values = rows.where(F.col(column).isNotNull()).select(column).distinct()
    return numbered(values, [column], "code").withColumn("code", F.col("code").cast("int"))


def one_hot(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the code of ``column`` and ``size``, the number of codes: position ``code`` of ``size`` is hot."""
    codes = encode_labels(rows, column)
    return rows.join(codes.join(codes.agg(F.count("*").alias("size"))), column, "left")


def matrix_slice(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """The rows ``(a, b, ...)`` of a matrix whose row and column are both among ``names`` ``(name)``."""
    return pairs.join(names.select(F.col("name").alias("a")), "a", "left_semi").join(names.select(F.col("name").alias("b")), "b", "left_semi")


def clean_malls(signals: DataFrame, largest_separation: float = 15.0, by_place: tuple[str, ...] = ("Mall of Mauritius",)) -> DataFrame:
    """The signals of all malls, cleaned mall by mall: duplicate times are resolved, and in the malls ``by_place`` signals
    far from the others of their store go."""
    out = None
    for mall in MALLS:
        one = cleaning.resolve_duplicates(signals.where(F.col("location") == mall), largest_separation)
        one = cleaning.clean_stores(one) if mall in by_place else one
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def manufacturers_and_class(devices: DataFrame, manufacturers: list[str], name: str, label: str = "dbscan_label") -> DataFrame:
    """``(region, size)``: how many devices are of exactly the manufacturers, and of class ``name`` or not, that a region's bits
    tell: a bit for each manufacturer in turn, the last one for the class."""
    made = devices.where(F.col("manufacturer").isin(manufacturers)).select("mac_address", F.col("manufacturer").alias("group"))
    own = devices.where(F.col(label) == name).select("mac_address", F.lit("class").alias("group"))
    return flows.venn(made.union(own), "mac_address", "group", [*manufacturers, "class"])


def pair_plot(devices: DataFrame, columns: list[str], hue: str = "is_out_of_hours") -> DataFrame:
    """``(hue, x_name, y_name, x, y)``: the points of each pair of two different ``columns``, of devices that have them all."""
    v = devices.select(hue, *(F.col(c).cast("double").alias(c) for c in columns)).dropna()
    pairs = F.array(*(F.struct(F.lit(a).alias("x_name"), F.lit(b).alias("y_name"), F.col(a).alias("x"), F.col(b).alias("y")) for a in columns for b in columns if a != b))
    return v.select(hue, F.explode(pairs).alias("p")).select(hue, "p.*")


def significance_curve(spark: SparkSession, mean: float, deviation: float, level: float, low: float = -5.0, high: float = 5.0, steps: int = 200, tail: int = 50) -> DataFrame:
    """``(part, place, x, y)``: a bell curve of height 1 on ``steps`` places (``curve``), its part from ``level`` on (``tail``) and
    the height at ``level`` (``level``)."""
    grid = lambda part, a, n: spark.range(n).select(F.lit(part).alias("part"), F.col("id").cast("int").alias("place"), (a + F.col("id") * ((high - a) / (n - 1))).alias("x"))
    at = spark.range(1).select(F.lit("level"), F.lit(0), F.lit(float(level)))
    rows = grid("curve", low, steps).union(grid("tail", level, tail)).union(at)
    return rows.withColumn("y", F.exp(-F.pow(F.col("x") - mean, F.lit(2.0)) / (2 * deviation**2)))


def confident_posteriors(posteriors: DataFrame, probability: str, level: float = 0.95, bins: int = 75) -> DataFrame:
    """``(bucket, n, density)``: a histogram of the posterior probabilities above ``level``."""
    return statistics.histogram(posteriors.where(F.col(probability) > level), probability, bins)


def _lens(d: Column, big: Column, small: Column) -> Column:
    """The area that circles of two radii have in common, their centres ``d`` apart."""
    part = lambda r, o: r * r * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (d * d + r * r - o * o) / (2 * d * r))))
    kite = F.greatest(F.lit(0.0), (big + small - d) * (d + small - big) * (d - small + big) * (d + small + big))
    return part(small, big) + part(big, small) - F.sqrt(kite) / 2


def circles(devices: DataFrame, manufacturers: list[str], name: str, label: str = "dbscan_label", steps: int = 60) -> DataFrame:
    """``(manufacturer, inside, outside, radius, distance, x, y)``: circles of the manufacturers' sets around that of class
    ``name``, of an area of one for each device, so far from it that the common area is the number of common devices.

    Centres are at even angles around the class, which is at the origin. The distance is found by halving: the common area
    falls as circles part. Sets apart touch, a set within the class lies at its edge; manufacturers without devices are left out.
    """
    total = devices.agg(F.sum((F.col(label) == name).cast("long")).alias("whole"))
    own = devices.where(F.col("manufacturer").isin(manufacturers)).groupBy("manufacturer").agg(
        F.sum(F.coalesce((F.col(label) == name).cast("long"), F.lit(0))).alias("inside"), F.count("*").alias("all")
    )
    c = own.join(F.broadcast(total)).withColumns({"big": F.sqrt(F.col("whole") / math.pi), "small": F.sqrt(F.col("all") / math.pi)})
    big, small, wanted = F.col("big"), F.col("small"), F.col("inside").cast("double")

    def halve(s: Column) -> Column:
        middle = (s["lo"] + s["hi"]) / 2
        far = _lens(middle, big, small) < wanted
        return F.struct(F.when(far, s["lo"]).otherwise(middle).alias("lo"), F.when(far, middle).otherwise(s["hi"]).alias("hi"))

    start = F.struct(F.abs(big - small).alias("lo"), (big + small).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda s, _: halve(s))
    distance = F.when(F.col("inside") == 0, big + small).when(F.col("inside") == F.least("whole", "all"), F.abs(big - small)).otherwise((found["lo"] + found["hi"]) / 2)
    turn = 2 * math.pi / len(manufacturers) * F.coalesce(*(F.when(F.col("manufacturer") == m, float(i)) for i, m in enumerate(manufacturers)))
    c = c.withColumns({"distance": distance, "turn": turn})
    return c.select(
        "manufacturer", "inside", (F.col("all") - F.col("inside")).alias("outside"), small.alias("radius"), "distance",
        (F.col("distance") * F.cos("turn")).alias("x"), (F.col("distance") * F.sin("turn")).alias("y"),
    )
