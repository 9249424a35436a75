"""Signals that lie apart from the others of their store, for all stores in one job.

Stores are of very different sizes, so the work is dealt out by cells of the floor within a store, and places that many
signals share count once with their number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import forget, spool


def places(signals: DataFrame, group: str = "store_id", x: str = "x", y: str = "y") -> DataFrame:
    """``(group, x, y, signals)``: the distinct places of each group; rows with a null or a value that is no number go."""
    v = signals.select(F.col(group).alias("group"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    v = v.where("group is not null and x is not null and y is not null and not isnan(x) and not isnan(y)")
    # A negative zero is a zero.
    return v.groupBy("group", (F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y")).agg(F.count("*").alias("signals"))


def density_outliers(signals: DataFrame, eps: float = 0.3, least: int = 10, group: str = "store_id", x: str = "x", y: str = "y") -> DataFrame:
    """``(group, x, y, signals, is_core, is_outlier)`` of all places: a core place has at least ``least`` signals of its group
    within ``eps``, its own included; an outlier has no core place within ``eps``.

    Cells are so small that what is in one is within ``eps`` of each other: a cell with ``least`` signals has core places
    only. Just the places of other cells, fewer than ``least`` in each, are held against their surroundings, so the pairs
    grow with the places however many of them one cell holds.
    """
    side = eps / math.sqrt(2) * (1 - 1e-9)
    p = places(signals, group, x, y).withColumns({"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)})
    p = spool(p)
    full = p.groupBy("group", "cx", "cy").agg(F.sum("signals").alias("held"))
    p = spool(p.join(spool(full), ["group", "cx", "cy"]).withColumn("dense", F.col("held") >= least))
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)))
    asked = p.where(~F.col("dense")).select("group", "x", "y", "cx", "cy", F.explode(steps).alias("s"))
    asked = asked.select("group", "x", "y", (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"))
    around = p.select(F.col("group"), "cx", "cy", F.col("x").alias("ox"), F.col("y").alias("oy"), "signals", "dense")
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    near = spool(asked.join(around, ["group", "cx", "cy"]).where(dx * dx + dy * dy <= eps * eps).select("group", "x", "y", "ox", "oy", "signals", "dense"))
    core = near.groupBy("group", "x", "y").agg(F.sum("signals").alias("found"), F.max("dense").alias("by_dense")).withColumn("is_core", F.col("found") >= least)
    core = spool(core.select("group", "x", "y", "is_core", "by_dense"))
    # Places that are no core themselves, beside a core place of a cell with few.
    others = core.where("is_core").select("group", F.col("x").alias("ox"), F.col("y").alias("oy"))
    beside = near.join(others, ["group", "ox", "oy"], "left_semi").select("group", "x", "y").distinct().withColumn("beside", F.lit(True))
    found = p.join(core, ["group", "x", "y"], "left").join(beside, ["group", "x", "y"], "left")
    is_core = F.col("dense") | F.coalesce("is_core", F.lit(False))
    reached = is_core | F.coalesce("by_dense", F.lit(False)) | F.coalesce("beside", F.lit(False))
    return found.select(F.col("group").alias(group), "x", "y", "signals", is_core.alias("is_core"), (~reached).alias("is_outlier"))


def _squared(a: str, b: str) -> Column:
    dx, dy = F.col("x") - F.col(a), F.col("y") - F.col(b)
    return dx * dx + dy * dy


def two_means_start(p: DataFrame) -> DataFrame:
    """``(group, ax, ay, bx, by)``: each group's first and last place."""
    ends = p.groupBy("group").agg(F.min(F.struct("x", "y")).alias("a"), F.max(F.struct("x", "y")).alias("b"))
    return ends.select("group", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))


def two_means_step(p: DataFrame, centres: DataFrame) -> DataFrame:
    """The centres after one round: means of the signals nearer to each; a centre without signals stays. Ties go to the first."""
    second = _squared("bx", "by") < _squared("ax", "ay")
    side = {"a": ~second, "b": second}
    j = p.join(centres, "group")
    sums = j.groupBy("group", "ax", "ay", "bx", "by").agg(
        *(F.sum(F.when(s, F.col("signals") * F.col(v) if v else F.col("signals"))).alias(f"{k}_{v or 'n'}") for k, s in side.items() for v in ("", "x", "y"))
    )
    return sums.select("group", *(F.coalesce(F.col(f"{k}_{v}") / F.col(f"{k}_n"), f"{k}{v}").alias(f"{k}{v}") for k in "ab" for v in "xy"))


def two_means(signals: DataFrame, group: str = "store_id", x: str = "x", y: str = "y", tolerance: float = 1e-9) -> DataFrame:
    """``(group, x, y, signals, cluster)``: two means of each group's signals, 0 for the one that starts at the first place.

    Rounds go on for all groups at once until no centre moves by more than ``tolerance``; a round lowers the squared distances,
    so they end. A group with one place is all in cluster 0.
    """
    p = spool(places(signals, group, x, y))
    centres = spool(two_means_start(p))
    while True:
        new = spool(two_means_step(p, centres))
        old = centres.select(F.col("group").alias("of"), *(F.col(c).alias(f"old_{c}") for c in ("ax", "ay", "bx", "by")))
        moved = F.greatest(*(F.abs(F.col(c) - F.col(f"old_{c}")) for c in ("ax", "ay", "bx", "by")))
        still = new.join(old, F.col("group") == F.col("of")).where(moved > tolerance).isEmpty()
        forget(centres)
        centres = new
        if still:
            break
    cluster = (_squared("bx", "by") < _squared("ax", "ay")).cast("int")
    return p.join(centres, "group").select(F.col("group").alias(group), "x", "y", "signals", cluster.alias("cluster"))
