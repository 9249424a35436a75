"""Cleaning of signals: several positions at one time, unlikely speeds, misplaced stores, legacy filters."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..plans.session import spool
from .features import steps


def resolve_duplicates(signals: DataFrame, largest_separation: float = 15.0) -> DataFrame:
    """One position for each device and time.

    Positions at one time that are close are averaged. If two that follow each other are farther apart than
    ``largest_separation``, the one is taken that is nearest, on average, to the position before and to the one after the
    next (only to the one before at a track's end; before a track's start stands its last position). Then equal rows of
    device, time, mall and place are one.
    """
    w, every = S.track(), S.track().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = signals.withColumns(
        {
            "rn": F.row_number().over(w),
            "px": F.coalesce(F.lag("x").over(w), F.last("x").over(every)), "py": F.coalesce(F.lag("y").over(w), F.last("y").over(every)),
            "nx": F.lead("x", 2).over(w), "ny": F.lead("y", 2).over(w),
        }
    )
    order = F.struct("rn")
    g = s.groupBy("mac_address", "date_time").agg(
        F.sort_array(F.collect_list(F.struct("rn", "x", "y"))).alias("p"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"),
        F.min_by("px", order).alias("px"), F.min_by("py", order).alias("py"), F.max_by("nx", order).alias("nx"), F.max_by("ny", order).alias("ny"),
    ).where(F.size("p") > 1)
    gap = lambda a, b: S.distance(a["x"], a["y"], b["x"], b["y"])
    apart = F.exists(F.sequence(F.lit(1), F.size("p") - 1), lambda i: gap(F.element_at("p", i), F.element_at("p", i + 1)) > largest_separation)
    to = lambda a: F.when(
        F.col("nx").isNull(), S.distance(a["x"], a["y"], F.col("px"), F.col("py"))
    ).otherwise((S.distance(a["x"], a["y"], F.col("px"), F.col("py")) + S.distance(a["x"], a["y"], F.col("nx"), F.col("ny"))) / 2)
    best = F.array_min(F.transform("p", lambda a: F.struct(to(a).alias("d"), a["rn"].alias("rn"), a["x"].alias("x"), a["y"].alias("y"))))
    fixed = g.select(
        "mac_address", "date_time", F.when(apart, best["x"]).otherwise(F.col("mean_x")).alias("new_x"), F.when(apart, best["y"]).otherwise(F.col("mean_y")).alias("new_y")
    )
    out = signals.join(fixed, ["mac_address", "date_time"], "left").withColumns({"x": F.coalesce("new_x", "x"), "y": F.coalesce("new_y", "y")})
    once = Window.partitionBy("mac_address", "date_time", "location", "x", "y").orderBy("event_id")
    return out.withColumn("copy", F.row_number().over(once)).where("copy = 1").select(signals.columns)


def duplicate_devices(signals: DataFrame) -> DataFrame:
    """``(mac_address, equal_times, moved)``: signals at the time of the one before them, and those elsewhere."""
    w = S.track()
    s = signals.withColumns({"t1": F.lead("date_time").over(w), "x1": F.lead("x").over(w), "y1": F.lead("y").over(w)}).where("t1 = date_time")
    return s.groupBy("mac_address").agg(F.count("*").alias("equal_times"), F.sum(((F.col("x") != F.col("x1")) | (F.col("y") != F.col("y1"))).cast("long")).alias("moved"))


def periods(signals: DataFrame) -> DataFrame:
    """``(mac_address, n, seconds, off_hours)``: time to the next signal, and whether it starts before 08 or after 22."""
    s = steps(signals).where("ds is not null")
    tod = S.second_of_day("date_time")
    return s.select("mac_address", "n", F.col("ds").alias("seconds"), ((tod < 28_800) | (tod > 79_200)).alias("off_hours"))


def unlikely_speeds(signals: DataFrame, limit: float, error: float) -> DataFrame:
    """``(mac_address, fast_steps)`` of devices with more than one step whose speed, less the error at both ends, exceeds ``limit``."""
    s = steps(signals).withColumn("way", F.col("d") - 2 * error)
    fast = ((F.col("ds") == 0) & (F.col("way") > 0)) | (S.ratio("way", "ds") > limit)
    return s.where(fast).groupBy("mac_address").agg(F.count("*").alias("fast_steps")).where("fast_steps > 1")


def around_duplicates(signals: DataFrame) -> DataFrame:
    """``(mac_address, n, window)``: the signals around each one that has the next one's time, from one before to two after."""
    w = S.track()
    s = signals.withColumns(
        {
            "n": F.row_number().over(w), "same": F.lead("date_time").over(w) == F.col("date_time"),
            "window": F.collect_list(F.struct("date_time", "x", "y")).over(w.rowsBetween(-1, 2)),
        }
    )
    return s.where("same").select("mac_address", "n", "window")


def neighbour_counts(points: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """``points`` with ``near``: how many points of the same store lie within ``tolerance``, itself included.

    Points are met by cells of a grid as wide as the tolerance, so a point is held against nine cells, not its store.
    """
    p = points.withColumns({"gx": F.floor(F.col("x") / tolerance), "gy": F.floor(F.col("y") / tolerance)})
    step = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    # Points at one place are counted once each side, so a place with very many signals costs one row.
    places = p.groupBy("store_id", "x", "y", "gx", "gy").agg(F.count("*").alias("here"))
    probe = places.select("store_id", "x", "y", "gx", "gy", F.explode(step).alias("s")).selectExpr("store_id", "x", "y", "gx + s.i cx", "gy + s.j cy")
    other = places.selectExpr("store_id", "x x2", "y y2", "gx cx", "gy cy", "here")
    found = probe.join(other, ["store_id", "cx", "cy"]).where(S.distance(F.col("x"), F.col("y"), F.col("x2"), F.col("y2")) <= tolerance)
    near = found.groupBy("store_id", "x", "y").agg(F.sum("here").alias("near"))
    return points.join(near, ["store_id", "x", "y"])


def clean_stores(signals: DataFrame, k: int = 5, tolerance: float = 1.0, shops_only: bool = False) -> DataFrame:
    """Signals whose k-th nearest signal of the same store, itself the first, is within ``tolerance``.

    Signals without store stay. Of a store with fewer than ``k`` signals none stays.
    """
    near = neighbour_counts(signals.where("store_id is not null"), tolerance).where(F.col("near") >= k).select(signals.columns)
    out = near.unionByName(signals.where("store_id is null"))
    return out.where(S.has_shop("store_id")) if shops_only else out


#: Places in a cell where the search for neighbours begins, at most, unless they are too close to be told apart.
CROWD = 64
#: Places in a cell and around it that one row holds, at most.
HELD = 4_096


def _kth_of(places: str, k: int) -> Column:
    """The distance from ``x, y`` within which ``places`` hold ``k`` points; null if they hold fewer."""
    far = F.transform(places, lambda p: F.struct(S.distance(F.col("x"), F.col("y"), p["x2"], p["y2"]).alias("distance"), p["here"].alias("here")))
    # The k nearest places hold the k nearest points.
    near = F.slice(F.array_sort(far), 1, k)
    start = F.struct(F.lit(0).cast("long").alias("found"), F.lit(None).cast("double").alias("distance"))
    step = lambda s, p: F.struct(
        (s["found"] + p["here"]).alias("found"), F.when(s["found"] >= k, s["distance"]).when(s["found"] + p["here"] >= k, p["distance"]).alias("distance")
    )
    return F.aggregate(near, start, step)["distance"]


def _kth_by_pairs(asked: DataFrame, other: DataFrame, k: int) -> DataFrame:
    """As :func:`_kth_of`, for each place asked, where cells may hold any number of places."""
    asked = asked.select("store_id", "x", "y", "unit", "extent", (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"))
    near = asked.join(other, ["store_id", "cx", "cy"]).withColumn("distance", S.distance(F.col("x"), F.col("y"), F.col("x2"), F.col("y2")))
    order = Window.partitionBy("store_id", "x", "y").orderBy("distance", "x2", "y2")
    near = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    near = near.withColumn("found", F.sum("here").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return near.groupBy("store_id", "x", "y", "unit", "extent").agg(F.min(F.when(F.col("found") >= k, F.col("distance"))).alias("distance"))


def kth_neighbour(points: DataFrame, k: int = 5) -> DataFrame:
    """``(store_id, point_id, distance)``: to the k-th nearest point of the same store, itself the first. Stores with fewer points,
    and points without a store or place, are left out.

    Cells begin so small that few places share one, and double from round to round. A place is done as soon as its k-th
    neighbour among the nine cells around it is no farther than a cell's side, since nothing outside them is nearer. Places
    that a round leaves have fewer than ``k`` neighbours within a side, so few of them are in one cell, and the pairs of a
    round grow with the places, however dense some of them stand. Where no more than
    ``HELD`` places are in a cell and around it, as when all ask, these are one row: nothing is shuffled or sorted for each pair.
    """
    p = points.select("store_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("store_id is not null and x is not null and y is not null")
    p = p.groupBy("store_id", "x", "y").agg(F.count("*").alias("here"))
    width = p.groupBy("store_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("extent"), F.count("*").alias("places"))
    # A unit is a side at which a store's cells hold a place each on average.
    unit = F.when(F.col("extent") > 0, F.col("extent") / F.sqrt(F.col("places"))).otherwise(1.0)
    width = spool(width.select("store_id", "x0", "y0", "extent", unit.alias("unit")))
    p = spool(p.join(width, "store_id").select("store_id", "x", "y", "here", ((F.col("x") - F.col("x0")) / F.col("unit")).alias("u"), ((F.col("y") - F.col("y0")) / F.col("unit")).alias("v"), "unit", "extent"))
    side = 1.0
    cells = lambda w: {"cx": F.floor(F.col("u") / w), "cy": F.floor(F.col("v") / w)}
    while side > 2.0**-30:
        most = p.withColumns(cells(side)).groupBy("store_id", "cx", "cy").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= CROWD:
            break
        side /= 2
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    rest, done = p.select("store_id", "x", "y", "u", "v", "unit", "extent"), []
    while True:
        asked = rest.withColumns(cells(side)).select("store_id", "x", "y", "unit", "extent", "cx", "cy")
        other = p.withColumns(cells(side)).select("store_id", "cx", "cy", F.col("x").alias("x2"), F.col("y").alias("y2"), "here")
        around = asked.select("store_id", "cx", "cy").distinct().select("store_id", F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.explode(steps).alias("s"))
        around = around.select("store_id", "ax", "ay", (F.col("ax") + F.col("s.i")).alias("cx"), (F.col("ay") + F.col("s.j")).alias("cy"))
        crowd = other.groupBy("store_id", "cx", "cy").agg(F.count("*").alias("n")).join(around, ["store_id", "cx", "cy"])
        if (crowd.groupBy("store_id", "ax", "ay").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0) <= HELD:
            # A row of what is in a cell and around it meets the places that ask.
            held = other.select("store_id", F.explode(steps).alias("s"), "cx", "cy", F.struct("x2", "y2", "here").alias("place"))
            held = held.select("store_id", (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"), "place")
            held = held.join(asked.select("store_id", "cx", "cy").distinct(), ["store_id", "cx", "cy"], "left_semi").groupBy("store_id", "cx", "cy").agg(F.collect_list("place").alias("places"))
            best = asked.join(held, ["store_id", "cx", "cy"]).select("store_id", "x", "y", "unit", "extent", _kth_of("places", k).alias("distance"))
        else:
            best = _kth_by_pairs(asked.withColumn("s", F.explode(steps)), other, k)
        whole = F.col("unit") * side >= F.col("extent")
        best = spool(best.withColumn("sure", F.coalesce(F.col("distance") <= F.col("unit") * side, F.lit(False)) | whole))
        done.append(best.where("sure").select("store_id", "x", "y", "distance"))
        rest = rest.join(best.where("not sure").select("store_id", "x", "y"), ["store_id", "x", "y"], "left_semi")
        if best.where("not sure").isEmpty():
            break
        rest, side = spool(rest), side * 2
    found = functools.reduce(DataFrame.union, done)
    there = points.select("store_id", "point_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return there.join(found.where("distance is not null"), ["store_id", "x", "y"]).select("store_id", "point_id", "distance")


def stationary_devices(signals: DataFrame) -> DataFrame:
    """``(mac_address, n)`` of devices with over 10 signals on fewer than 5 values of x and of y."""
    g = signals.groupBy("mac_address").agg(F.count("*").alias("n"), F.count_distinct("x").alias("nx"), F.count_distinct("y").alias("ny"))
    return g.where("n > 10 and nx < 5 and ny < 5").select("mac_address", "n")


def legacy_clean(signals: DataFrame, open_hour: int, close_hour: int, minimum: int, speed: float) -> DataFrame:
    """Older chain: equal rows are one, then devices go that were seen between close and open, are rare, or too fast."""
    s = signals.dropDuplicates(["mac_address", "date_time", "location", "store_id", "x", "y"])
    tod = S.second_of_day("date_time")
    lo, hi = close_hour * 3600, open_hour * 3600
    shut = tod.between(lo, hi) if lo <= hi else (tod >= lo) | (tod <= hi)
    v = steps(s).withColumn("v", S.ratio("d", "ds"))
    own = v.groupBy("mac_address").agg(
        F.max(shut.cast("int")).alias("shut"), F.count("*").alias("n"), F.avg(F.when(F.col("v") < 1e5, F.col("v"))).alias("v")
    )
    good = own.where((F.col("shut") == 0) & (F.col("n") >= minimum) & (F.coalesce("v", F.lit(0.0)) <= speed))
    return s.join(good.select("mac_address"), "mac_address", "left_semi")


def store_neighbours(signals: DataFrame, limit: float) -> DataFrame:
    """``(mac_address, fast_steps, null_share)``: stores around steps faster than ``limit``, and how many are unknown."""
    w = S.track()
    s = signals.withColumns({"before_store": F.lag("store_id").over(w), "after_store": F.lead("store_id").over(w)})
    s = steps(s).where(S.ratio("d", "ds") > limit)
    nulls = sum(F.col(c).isNull().cast("double") for c in ("before_store", "store_id", "after_store"))
    return s.groupBy("mac_address").agg(F.count("*").alias("fast_steps"), F.avg(nulls / 3).alias("null_share"))
