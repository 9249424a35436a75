"""Counts by time and store, and flows between stores over sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .ordering import numbered, running


def per_bin(signals: DataFrame, minutes: int = 15) -> DataFrame:
    """``(bin, signals, devices)``, bins rounded to the nearest, ties to even."""
    return signals.groupBy(S.time_bin("date_time", minutes).alias("bin")).agg(F.count("*").alias("signals"), F.count_distinct("mac_address").alias("devices"))


def arrivals(starts: DataFrame, minutes: int = 30) -> DataFrame:
    """``(bin, devices)`` by start time."""
    return starts.groupBy(S.time_bin("start_time", minutes).alias("bin")).agg(F.count_distinct("mac_address").alias("devices"))


def stay_by_band(stays: DataFrame, width: int = 100) -> DataFrame:
    """``(band, bucket, devices)``: lengths of stay by the hours of arrival 9-12, 12-15, 15-18, 18-21, 21-24, bounds left out."""
    tod = S.second_of_day("start_time")
    band = F.coalesce(*(F.when((tod > h * 3600) & (tod < (h + 3) * 3600), f"{h}-{h + 3}") for h in (9, 12, 15, 18, 21)))
    s = stays.withColumn("band", band).where("band is not null")
    s = s.withColumn("least", F.min("length_of_stay").over(Window.partitionBy("band")))
    bucket = F.floor((F.col("length_of_stay") - F.col("least")) / width)
    return s.groupBy("band", bucket.alias("bucket")).agg(F.count("*").alias("devices"))


def _framed(signals: DataFrame, window: int, slide: int, compat: bool) -> DataFrame:
    """Signals after 07:00, once for each window of ``window`` minutes that they lie in: a new one starts each ``slide``.

    ``compat`` takes windows without their bounds and leaves out the last full one, as the older code does.
    """
    day = signals.where(S.second_of_day("date_time") > 25_200)
    bounds = day.agg(F.min(S.micros("date_time")).alias("t0"), F.max(S.micros("date_time")).alias("t1"))
    w, s = window * 60_000_000, slide * 60_000_000
    frames = F.floor((F.col("t1") - F.col("t0") - w) / s) + (0 if compat else 1)
    t = day.join(F.broadcast(bounds)).withColumns({"t": S.micros("date_time") - F.col("t0"), "frames": frames})
    if compat:
        lo, hi = F.floor((F.col("t") - w) / s) + 1, F.ceil(F.col("t") / s) - 1
    else:
        lo, hi = F.floor((F.col("t") - w) / s) + 1, F.floor(F.col("t") / s)
    t = t.withColumns({"lo": F.greatest(F.lit(0).cast("long"), lo), "hi": F.least(F.col("frames") - 1, hi)})
    return t.where("lo <= hi").withColumn("frame", F.explode(F.sequence("lo", "hi"))).drop("t0", "t1", "t", "lo", "hi", "frames")


def sliding_flow(signals: DataFrame, window: int = 60, slide: int = 30, compat: bool = True) -> DataFrame:
    """``(frame, src, dst, weight)``: moves between different stores within each window."""
    return adjacency(_framed(signals, window, slide, compat), "frame")


def adjacency(signals: DataFrame, *frame: str) -> DataFrame:
    """``(..., src, dst, weight)``: how often devices went from one store to another; signals without store don't count."""
    w = S.track(*frame, "mac_address")
    s = signals.where("store_id is not null").withColumn("src", F.lag("store_id").over(w))
    return s.where("src <> store_id").groupBy(*frame, "src", F.col("store_id").alias("dst")).agg(F.count("*").alias("weight"))


def _visitors(n: Column, compat: bool) -> Column:
    return F.when(n > 0, n + 1).otherwise(0) if compat else n


def sliding_visitors(signals: DataFrame, window: int = 60, slide: int = 30, compat: bool = True) -> DataFrame:
    """``(frame, store_id, frequency)``: devices in each store and window; ``compat`` counts one more where there is any."""
    s = _framed(signals, window, slide, compat).where("store_id is not null")
    n = s.groupBy("frame", "store_id").agg(F.count_distinct("mac_address").alias("n"))
    return n.select("frame", "store_id", _visitors(F.col("n"), compat).cast("long").alias("frequency"))


def store_positions(signals: DataFrame) -> DataFrame:
    """``(store_id, x, y, visitors)``: mean place and devices of each store."""
    return signals.where("store_id is not null").groupBy("store_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count_distinct("mac_address").alias("visitors"))


def net_flow(edges: DataFrame) -> DataFrame:
    """``(src, dst, net)``: flow less the flow back."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("back"))
    j = edges.join(back, ["src", "dst"], "full")
    return j.select("src", "dst", (F.coalesce("weight", F.lit(0)) - F.coalesce("back", F.lit(0))).alias("net"))


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("store_id")).agg(F.sum("weight").alias("in_degree"))


def add_visitors(signals: DataFrame, directory: DataFrame) -> DataFrame:
    """``directory`` with ``count_of_shoppers``; null for stores that no one was seen in."""
    n = signals.where("store_id is not null").groupBy("store_id").agg(F.count_distinct("mac_address").alias("count_of_shoppers"))
    return directory.join(n, "store_id", "left")


def shop_frequency(signals: DataFrame) -> DataFrame:
    return signals.where(S.is_shop("store_id")).groupBy("store_id").agg(F.count("*").alias("frequency"))


def shop_area(signals: DataFrame, shops_only: bool = True, rounded: bool = False) -> DataFrame:
    """``(store_id, area)``: over each x the spread of y, summed; ``rounded`` takes whole metres, and 1 for no spread."""
    s = signals.where(S.is_shop("store_id")) if shops_only else signals.where("store_id is not null")
    if rounded:
        s = s.withColumns({"x": F.rint("x"), "y": F.rint("y")})
    height = F.max("y") - F.min("y")
    columns = s.groupBy("store_id", "x").agg((F.when(height == 0, 1.0).otherwise(height) if rounded else height).alias("height"))
    return columns.groupBy("store_id").agg(F.sum("height").alias("area"))


def regression(points: DataFrame, x: Column, y: Column) -> DataFrame:
    """``(slope, intercept, r, stderr, n)`` of a line through ``(x, y)``."""
    p = points.select(x.alias("x"), y.alias("y")).where("x is not null and y is not null")
    r = F.corr("x", "y")
    slope = F.regr_slope("y", "x")
    return p.agg(
        slope.alias("slope"), F.regr_intercept("y", "x").alias("intercept"), r.alias("r"),
        F.sqrt(S.ratio((1 - r * r) * F.regr_syy("y", "x"), F.regr_sxx("y", "x") * (F.count("*") - 2))).alias("stderr"), F.count("*").alias("n"),
    )


def area_power_law(signals: DataFrame) -> DataFrame:
    """Visitors against area of shops on logarithmic axes."""
    area = shop_area(signals, rounded=True)
    n = signals.where(S.is_shop("store_id")).groupBy("store_id").agg(F.count_distinct("mac_address").alias("visitors"))
    p = area.join(n, "store_id").where("area > 0")
    return regression(p, F.log10("area"), F.log10(F.col("visitors").cast("double")))


def degree_rank(degrees: DataFrame) -> DataFrame:
    """``(store_id, frequency, rank)``: 0 for the largest."""
    return numbered(degrees.select("store_id", "frequency"), [F.col("frequency").desc(), F.col("store_id").asc()], "rank").withColumn("rank", F.col("rank").cast("int"))


def rank_probability(degrees: DataFrame) -> DataFrame:
    """``(frequency, rank)``: the number of distinct degrees times the share of stores of that degree or more."""
    c = degrees.groupBy("frequency").agg(F.count("*").alias("c"))
    every = c.agg(F.sum("c").alias("stores"), F.count("*").alias("degrees"))
    found = running(c, [F.col("frequency").desc()], {"above": "c"}).join(F.broadcast(every))
    return found.select("frequency", (F.col("above") / F.col("stores") * F.col("degrees")).alias("rank"))


def top_per_group(df: DataFrame, group: str, order: str, k: int, tie: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.col(order).desc(), tie)
    return df.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)


def venn(members: DataFrame, key: str, group: str, groups: list[str]) -> DataFrame:
    """``(region, size)``: how many keys are in exactly the groups of each region, as a bit mask by place in ``groups``."""
    bit = F.coalesce(*(F.when(F.col(group) == g, 1 << i) for i, g in enumerate(groups)))
    return members.withColumn("b", bit).where("b is not null").groupBy(key).agg(F.bit_or("b").alias("region")).groupBy("region").agg(F.count("*").alias("size"))
