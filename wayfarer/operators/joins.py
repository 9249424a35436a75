"""Joins between signals, features and dimension tables.

Dimension tables (OUI, directories, communities of shops) are joined without a hint: Spark broadcasts the ones whose size
it knows to be small and shuffles the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S


def add_manufacturer(devices: DataFrame, oui: DataFrame) -> DataFrame:
    """``devices`` with ``manufacturer`` by the MAC's first six digits; a prefix listed twice counts once."""
    names = oui.groupBy(F.col("Assignment").alias("prefix")).agg(F.min("Organization Name").alias("manufacturer"))
    rows = devices.withColumn("own_prefix", S.oui_prefix("mac_address"))
    return rows.join(names, F.col("own_prefix") == F.col("prefix"), "left").drop("own_prefix", "prefix")


def keep_devices(signals: DataFrame, devices: DataFrame) -> DataFrame:
    """Signals of the listed devices."""
    return signals.join(devices.select("mac_address").distinct(), "mac_address", "left_semi")


def drop_devices(signals: DataFrame, devices: DataFrame) -> DataFrame:
    """Signals of all but the listed devices."""
    return signals.join(devices.select("mac_address").distinct(), "mac_address", "left_anti")


def overwrite_positions(signals: DataFrame, fixed: DataFrame) -> DataFrame:
    """Signals with ``x`` and ``y`` of ``fixed`` where that has the same device and time."""
    new = fixed.select("mac_address", "date_time", F.col("x").alias("new_x"), F.col("y").alias("new_y"))
    out = signals.join(new, ["mac_address", "date_time"], "left")
    return out.withColumns({"x": F.coalesce("new_x", "x"), "y": F.coalesce("new_y", "y")}).drop("new_x", "new_y")


def first_last(signals: DataFrame) -> DataFrame:
    """``(mac_address, arrive, leave, arrive_store, leave_store)``."""
    order = F.struct("date_time", "event_id")
    return signals.groupBy("mac_address").agg(
        F.min("date_time").alias("arrive"),
        F.max("date_time").alias("leave"),
        F.min_by("store_id", order).alias("arrive_store"),
        F.max_by("store_id", order).alias("leave_store"),
    )


def with_categories(signals: DataFrame, directory: DataFrame) -> DataFrame:
    """Signals with their store's ``store_category``; ``None`` as text where there is none."""
    names = directory.select(F.col("store_id").alias("directory_id"), "store_category")
    out = signals.join(names, F.col("store_id") == F.col("directory_id"), "left").drop("directory_id")
    return out.fillna("None", ["store_category"])


def shop_corridor_ratio(signals: DataFrame) -> DataFrame:
    """``(store_id, area_id, shop_count, area_count, ratio)``: each shop and the first corridor of the same number."""
    counts = signals.where("store_id is not null").groupBy("store_id").agg(F.count("*").alias("n"))
    number = F.substring("store_id", 2, 10)
    shops = counts.where(S.is_shop("store_id") & (F.length("store_id") == 4)).select("store_id", F.col("n").alias("shop_count"), number.alias("number"))
    areas = counts.where("substring(store_id, 1, 1) = 'A'").select(number.alias("number"), F.col("store_id").alias("area_id"), F.col("n").alias("area_count"))
    first = areas.groupBy("number").agg(F.min(F.struct("area_id", "area_count")).alias("a")).select("number", "a.*")
    out = shops.join(first, "number")
    return out.select("store_id", "area_id", "shop_count", "area_count", S.ratio("shop_count", "area_count").alias("ratio"))


def community_visits(signals: DataFrame, communities: DataFrame) -> DataFrame:
    """``(community, store_id, visits)`` of devices that have a community, stores only."""
    s = signals.where("store_id is not null").join(communities, "mac_address")
    return s.groupBy("community", "store_id").agg(F.count("*").alias("visits"))


def points_in_polygons(points: DataFrame, edges: DataFrame) -> DataFrame:
    """``(point_id, label)``: the polygon that a point lies in, ``more than 1 shop``, or null.

    ``edges`` is ``(name, x1, y1, x2, y2)``, each polygon's sides; the boxes of polygons are joined by cells of a grid, so
    only points near a polygon are held against its sides. A ray to the right crosses an odd number of sides inside.
    """
    size = 25.0
    cell = lambda c: F.floor(F.col(c) / size)
    box = edges.groupBy("name").agg(
        F.min(F.least("x1", "x2")).alias("x_lo"), F.max(F.greatest("x1", "x2")).alias("x_hi"),
        F.min(F.least("y1", "y2")).alias("y_lo"), F.max(F.greatest("y1", "y2")).alias("y_hi"),
        F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("sides"),
    )
    cells = box.withColumn("cx", F.explode(F.sequence(cell("x_lo"), cell("x_hi")))).withColumn(
        "cy", F.explode(F.sequence(cell("y_lo"), cell("y_hi")))
    )
    p = points.select("point_id", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    crosses = lambda s: (
        ((s["y1"] > F.col("y")) != (s["y2"] > F.col("y")))
        & (F.col("x") < (s["x2"] - s["x1"]) * (F.col("y") - s["y1"]) / F.nullif(s["y2"] - s["y1"], F.lit(0.0)) + s["x1"])
    )
    inside = F.size(F.filter("sides", crosses)) % 2 == 1
    hits = p.join(cells, ["cx", "cy"]).where(inside).groupBy("point_id").agg(F.count("*").alias("n"), F.min("name").alias("name"))
    out = points.select("point_id").join(hits, "point_id", "left")
    return out.select("point_id", F.when(F.col("n") > 1, "more than 1 shop").otherwise(F.col("name")).alias("label"))


def store_pairs(stores: DataFrame) -> DataFrame:
    """``(src, dst, dx, dy, distance, turn)`` of all ordered pairs of stores ``(store_id, x, y)``.

    ``turn`` is 0 where the second store lies up to half a turn on about the mall's centre, 1 beyond, 0.5 for equal
    angles. The directory is a dimension table of some hundred stores; the pairs are its matrix.
    """
    a = stores.select(F.col("store_id").alias("src"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    b = stores.select(F.col("store_id").alias("dst"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    p = a.join(b, F.lit(True))
    p = p.withColumns({"dx": F.col("xb") - F.col("xa"), "dy": F.col("yb") - F.col("ya")})
    way = S.angle_direction(S.centre_angle("xa", "ya"), S.centre_angle("xb", "yb"))
    turn = F.when(way.isNull(), 0.5).when(way == -1, 0.0).when(way == 1, 1.0).otherwise(0.5)
    return p.select("src", "dst", "dx", "dy", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("distance"), turn.alias("turn"))
