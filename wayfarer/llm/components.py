"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is an aggregation and a join on a node. The join's other side has one row for each node; a node that very many
edges meet is dealt out with several copies of its row, so its edges don't end up in one task. The number of rounds grows
with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, spool

#: Edges of a node that one task joins, and nodes with more than that, at most: the bound of what is broadcast.
HEAVY, MOST = 10_000, 100_000


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` ``(x, y)`` with ``m`` of ``least`` ``(z, m, degree)`` where ``x = z``."""
    # A node is heavy above HEAVY edges, or above the share of all edges that fewer than MOST nodes can have.
    total = least.agg(F.coalesce(F.sum("degree"), F.lit(0))).first()[0]
    size = max(HEAVY, -(-total // MOST))
    copies = F.floor(F.col("degree") / size) + 1
    heavy = F.broadcast(least.where(F.col("degree") > size).select(F.col("z").alias("x"), copies.alias("copies")))
    dealt = edges.join(heavy, "x", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("y"), F.col("copies")), F.lit(0)))
    each = least.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("degree") > size, copies - 1).otherwise(0))))
    return dealt.join(each, (F.col("x") == F.col("z")) & (dealt["part"] == each["part"])).select("x", "y", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is hung on the smallest node around it."""
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(
        edges.select(F.col("v").alias("x"), F.col("u").alias("y"))
    )
    least = both.groupBy(F.col("x").alias("z")).agg(F.least(F.min("y"), F.first("x")).alias("m"), F.count("*").alias("degree"))
    moved = _with_least(both.where("y > x"), spool(least))
    return moved.where("y <> m").select(F.col("y").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its neighbours below are hung on the smallest of these."""
    down = edges.select(F.greatest("u", "v").alias("x"), F.least("u", "v").alias("y"))
    least = spool(down.groupBy(F.col("x").alias("z")).agg(F.min("y").alias("m"), F.count("*").alias("degree")))
    moved = _with_least(down, least).where("y <> m").select(F.col("y").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select(F.col("z").alias("u"), F.col("m").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one other that hangs on none, so that nothing is left to do."""
    up = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
    ends = up.union(edges.select("v", F.lit(0), F.lit(1)))
    each = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return each.where("hangs > 1 or hangs = 1 and holds = 1").isEmpty()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``(node, component)`` for every node that has an edge; ``component`` is the smallest node reachable.

    ``edges`` has two integer columns. Edges with a null end and loops are left out; repeated edges and either direction
    do no harm. No edges give an empty result. The rounds end when every edge leads to the least node of its component.
    """
    now = spool(
        edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v"))
        .where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    while not _are_stars(now):
        large = spool(_large_star(now))
        new = spool(_small_star(large))
        forget(now)
        forget(large)
        now = new
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
