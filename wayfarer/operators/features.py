"""Per-device features: one window over each device's track, one aggregation by device."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..schema import WIFI_TYPES


def steps(signals: DataFrame, *keys: str) -> DataFrame:
    """Signals with the step to the next signal and the turn at it, all over one window.

    Adds ``dx dy d`` (step and length), ``ds`` (whole seconds, days left out), ``theta`` (turning angle between this step
    and the next), ``straightness`` (the two steps over what they cover together), and ``n`` (the place in the track).
    """
    w = S.track(*keys)
    s = signals.withColumns(
        {
            "x1": F.lead("x").over(w), "y1": F.lead("y").over(w), "x2": F.lead("x", 2).over(w), "y2": F.lead("y", 2).over(w),
            "t1": F.lead("date_time").over(w), "n": F.row_number().over(w),
        }
    )
    s = s.withColumns({"dx": F.col("x1") - F.col("x"), "dy": F.col("y1") - F.col("y"), "ex": F.col("x2") - F.col("x1"), "ey": F.col("y2") - F.col("y1")})
    length = lambda a, b: F.sqrt(F.col(a) * F.col(a) + F.col(b) * F.col(b))
    s = s.withColumns({"d": length("dx", "dy"), "e": length("ex", "ey"), "ds": S.seconds_between("date_time", "t1")})
    dot = F.col("dx") * F.col("ex") + F.col("dy") * F.col("ey")
    chord = F.sqrt(F.pow(F.col("x2") - F.col("x"), F.lit(2.0)) + F.pow(F.col("y2") - F.col("y"), F.lit(2.0)))
    return s.withColumns(
        {
            "dot": dot,
            "theta": S.finite(F.acos(S.ratio(dot, F.col("d") * F.col("e")))),
            "straightness": S.ratio(F.col("d") + F.col("e"), chord),
        }
    )


def remove_consecutive(signals: DataFrame, *keys: str) -> DataFrame:
    """The last signal of each run in one store; a signal without store is kept."""
    after = F.lead("store_id").over(S.track(*keys))
    marked = signals.withColumn("after_store", after)
    return marked.where("after_store is null or store_id is null or after_store <> store_id").drop("after_store")


def first_of_runs(signals: DataFrame, *keys: str) -> DataFrame:
    """The first signal of each run in one store."""
    marked = signals.withColumn("before_store", F.lag("store_id").over(S.track(*keys)))
    return marked.where("before_store is null or before_store <> store_id").drop("before_store")


def frequency(signals: DataFrame) -> DataFrame:
    """``(mac_address, frequency)``."""
    return signals.groupBy("mac_address").agg(F.count("*").alias("frequency"))


def gyration(signals: DataFrame, drop_repeats: bool = False) -> DataFrame:
    """``(mac_address, centroid_x, centroid_y, radius_of_gyration)``."""
    s = remove_consecutive(signals) if drop_repeats else signals
    return s.groupBy("mac_address").agg(
        F.avg("x").alias("centroid_x"),
        F.avg("y").alias("centroid_y"),
        F.sqrt(F.var_pop("x") + F.var_pop("y")).alias("radius_of_gyration"),
    )


def density_deviation(signals: DataFrame, minutes: int = 5) -> DataFrame:
    """``(mac_address, count_density_variance)``: sample deviation of the counts in the time bins that have signals."""
    bins = signals.groupBy("mac_address", S.time_bin("date_time", minutes).alias("bin")).agg(F.count("*").alias("n"))
    return bins.groupBy("mac_address").agg(F.stddev_samp("n").alias("count_density_variance"))


def length_of_stay(signals: DataFrame) -> DataFrame:
    """``(mac_address, length_of_stay, total_stay)``: last minus first signal without and with whole days."""
    lo, hi = F.min("date_time"), F.max("date_time")
    return signals.groupBy("mac_address").agg(
        S.seconds_between(lo, hi).alias("length_of_stay"), S.seconds_between(lo, hi, unwrapped=True).alias("total_stay")
    )


def out_of_hours(signals: DataFrame) -> DataFrame:
    """``(mac_address, is_out_of_hours)``: 1 with a signal from 03:00 to 05:00, both included."""
    night = S.second_of_day("date_time").between(10_800, 18_000)
    return signals.groupBy("mac_address").agg(F.max(night.cast("int")).alias("is_out_of_hours"))


def _step_measures() -> dict[str, Column]:
    angles = F.count("*") > 2
    return {
        "av_speed": F.avg(F.when(F.col("ds") > 0, F.col("d") / F.col("ds"))),
        "av_turning_angle": F.avg("theta"),
        "total_turning_angle": F.when(angles, F.coalesce(F.sum(F.abs("theta")), F.lit(0.0))),
        "av_turning_angle_velocity": F.avg(F.col("next_theta") - F.col("theta")),
        "av_path_length": F.avg("d"),
        "total_path_length": F.sum("d"),
        "av_straightness": F.avg("straightness"),
    }


def step_features(signals: DataFrame, drop_repeats: bool = False) -> DataFrame:
    """Speed, angles, path lengths and straightness by device."""
    s = steps(remove_consecutive(signals) if drop_repeats else signals)
    s = s.withColumn("next_theta", F.lead("theta").over(S.track()))
    return s.groupBy("mac_address").agg(*(c.alias(k) for k, c in _step_measures().items()))


def wifi_priority(signals: DataFrame) -> DataFrame:
    """``(mac_address, wifi_type)``: the kind of highest priority that a device was seen with."""
    rank = F.coalesce(*(F.when(F.col("wifi_type") == k, i) for i, k in enumerate(WIFI_TYPES)))
    kinds = F.array(*map(F.lit, WIFI_TYPES))
    return signals.groupBy("mac_address").agg(F.element_at(kinds, F.min(rank) + 1).alias("wifi_type"))


def start_end(signals: DataFrame) -> DataFrame:
    """First and last place and time of each device."""
    order = F.struct("date_time", "event_id")
    return signals.groupBy("mac_address").agg(
        F.min_by("x", order).alias("start_x"), F.min_by("y", order).alias("start_y"),
        F.max_by("x", order).alias("end_x"), F.max_by("y", order).alias("end_y"),
        F.min("date_time").alias("start_time"), F.max("date_time").alias("end_time"),
    )


def shops_visited(signals: DataFrame) -> DataFrame:
    """``(mac_address, number_of_shops)``."""
    shop = F.when(S.is_shop("store_id"), F.col("store_id"))
    return signals.groupBy("mac_address").agg(F.count_distinct(shop).alias("number_of_shops"))


def forward_probability(signals: DataFrame, drop_repeats: bool = False) -> DataFrame:
    """``(mac_address, forwards)``: how often a step goes on in the direction of the last; steps of length 0 don't count."""
    s = steps(remove_consecutive(signals) if drop_repeats else signals)
    moved = s.where("d > 0").withColumns({"next_dx": F.lead("dx").over(S.track()), "next_dy": F.lead("dy").over(S.track())})
    dot = F.col("dx") * F.col("next_dx") + F.col("dy") * F.col("next_dy")
    return moved.groupBy("mac_address").agg(F.avg((dot > 0).cast("int")).alias("forwards"))


def device_features(signals: DataFrame, oui: DataFrame | None = None) -> DataFrame:
    """The feature table, one row for each device. ``oui`` adds the manufacturer.

    One shuffle by device serves the window, the counts by time bin and the aggregation.
    """
    w, bins = S.track(), Window.partitionBy("mac_address", "bin")
    s = steps(signals.withColumn("bin", S.time_bin("date_time", 5)))
    s = s.withColumns(
        {
            "next_theta": F.lead("theta").over(w),
            # Each bin's count stands at one of its rows, so that the deviation over rows is that over bins.
            "bin_count": F.when(F.row_number().over(bins.orderBy("date_time", "event_id")) == 1, F.count("*").over(bins)),
        }
    )
    order, lo, hi = F.struct("date_time", "event_id"), F.min("date_time"), F.max("date_time")
    rank = F.coalesce(*(F.when(F.col("wifi_type") == k, i) for i, k in enumerate(WIFI_TYPES)))
    out = s.groupBy("mac_address").agg(
        F.count("*").alias("frequency"),
        F.struct(F.avg("x").alias("x"), F.avg("y").alias("y")).alias("centroid"),
        F.sqrt(F.var_pop("x") + F.var_pop("y")).alias("radius_of_gyration"),
        F.stddev_samp("bin_count").alias("count_density_variance"),
        S.seconds_between(lo, hi).alias("length_of_stay"),
        F.max(S.second_of_day("date_time").between(10_800, 18_000).cast("int")).alias("is_out_of_hours"),
        *(c.alias(k) for k, c in _step_measures().items()),
        F.min_by(F.struct("x", "y"), order).alias("start_coordinate"),
        F.max_by(F.struct("x", "y"), order).alias("end_coordinate"),
        F.element_at(F.array(*map(F.lit, WIFI_TYPES)), F.min(rank) + 1).alias("wifi_type"),
        lo.alias("start_time"),
        hi.alias("end_time"),
        F.count_distinct(F.when(S.is_shop("store_id"), F.col("store_id"))).alias("number_of_shops"),
    )
    out = out.withColumns(
        {
            "av_speed_from_total": S.ratio("total_path_length", "length_of_stay"),
            "turning_angle_density": S.ratio("total_turning_angle", "total_path_length"),
        }
    )
    if oui is not None:
        from .joins import add_manufacturer

        out = add_manufacturer(out, oui)
    return out


def turning_runs(signals: DataFrame) -> DataFrame:
    """``(mac_address, run, length)``: path lengths between turns of more than a right angle."""
    w = S.track()
    s = steps(signals).where("d is not null").withColumn("sharp", F.coalesce((F.lag("theta").over(w) > math.pi / 2).cast("int"), F.lit(0)))
    s = s.withColumn("run", F.sum("sharp").over(w))
    return s.groupBy("mac_address", "run").agg(F.sum("d").alias("length"))


def diffusion(signals: DataFrame) -> DataFrame:
    """``(mac_address, n, msd)``: mean squared distance from the start over the signals before the n-th."""
    w = S.track()
    s = signals.withColumns({"x0": F.first("x").over(w), "y0": F.first("y").over(w), "n": F.row_number().over(w) - 1})
    square = F.pow(F.col("x") - F.col("x0"), F.lit(2.0)) + F.pow(F.col("y") - F.col("y0"), F.lit(2.0))
    return s.select("mac_address", "n", F.avg(square).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("msd"))


def fraction_visited(signals: DataFrame) -> DataFrame:
    """``(mac_address, fraction)`` of all stores; being in none counts as a store."""
    store = F.coalesce("store_id", F.lit("none"))
    total = signals.agg(F.count_distinct(store).alias("stores"))
    own = signals.groupBy("mac_address").agg(F.count_distinct(store).alias("own"))
    return own.join(F.broadcast(total)).select("mac_address", (F.col("own") / F.col("stores")).alias("fraction"))


def direction_bias(signals: DataFrame, shops: DataFrame) -> DataFrame:
    """``(mac_address, clockwise, anticlockwise, neutral, none, moves)`` over moves between shops about the mall's centre.

    ``shops`` is ``(store_id, shop_x, shop_y)``. ``neutral`` counts moves without direction and moves within a shop.
    """
    angle = shops.select(F.col("store_id").alias("shop"), S.centre_angle("shop_x", "shop_y").alias("angle"))
    s = signals.join(F.broadcast(angle), F.col("store_id") == F.col("shop"))
    moves = s.withColumn("next_angle", F.lead("angle").over(S.track())).where("next_angle is not null")
    moves = moves.withColumn("way", S.angle_direction("angle", "next_angle"))
    n = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("long")
    return moves.groupBy("mac_address").agg(
        n(F.col("way") == 1).alias("clockwise"),
        n(F.col("way") == -1).alias("anticlockwise"),
        n(F.coalesce(F.col("way"), F.lit(0)) == 0).alias("neutral"),
        n(F.col("way").isNull()).alias("none"),
        F.count("*").alias("moves"),
    )
