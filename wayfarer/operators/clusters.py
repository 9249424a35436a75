"""Clustering: density-based on a grid, k-means, Gaussian mixtures and Gaussian naive Bayes."""

from __future__ import annotations

import functools
import itertools
import math

from pyspark.ml.classification import NaiveBayes
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import forget, spool
from .ordering import numbered


def eps_pairs(points: DataFrame, columns: list[str], eps: float) -> DataFrame:
    """``(a, b)``: ordered pairs of ``id`` within ``eps``, itself included, met by cells of a grid on two columns."""
    p = points.dropna(subset=columns)
    grid = columns[:2]
    cell = {f"g{i}": F.floor(F.col(c) / eps) for i, c in enumerate(grid)}
    p = p.withColumns(cell)
    near = [()]
    for _ in grid:
        near = [(*t, d) for t in near for d in (-1, 0, 1)]
    step = F.array(*(F.struct(*(F.lit(d).alias(f"s{i}") for i, d in enumerate(t))) for t in near))
    a = p.select(F.col("id").alias("a"), *(F.col(c).alias(f"a_{c}") for c in columns), *cell, F.explode(step).alias("s"))
    a = a.select("a", *(f"a_{c}" for c in columns), *((F.col(g) + F.col(f"s.s{i}")).alias(g) for i, g in enumerate(cell)))
    b = p.select(F.col("id").alias("b"), *(F.col(c).alias(f"b_{c}") for c in columns), *cell)
    d2 = sum(F.pow(F.col(f"a_{c}") - F.col(f"b_{c}"), F.lit(2.0)) for c in columns)
    return a.join(b, list(cell)).where(d2 <= eps * eps).select("a", "b")


def vector_pairs(points: DataFrame, eps: float, pivots: int = 6) -> DataFrame:
    """``(a, b)``: ordered pairs of ``id`` whose ``vector`` arrays are within ``eps``, itself included, in any number of
    dimensions.

    A vector's distances from a few pivots, vectors spread by a hash, are its place in a space of few dimensions: by the
    triangle inequality two vectors within ``eps`` are within ``eps`` in each of these distances. Two of them, which vary most,
    are the grid on which vectors meet; the others drop pairs before whole vectors are compared. Nothing within ``eps`` is lost.
    """
    p = points.where("vector is not null").select("id", "vector")
    chosen = p.orderBy(F.xxhash64("id"), "id").limit(pivots).agg(F.collect_list("vector").alias("pivots"))
    apart = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    # One row of a few vectors.
    near = spool(p.join(F.broadcast(chosen)).select("id", "vector", F.transform("pivots", lambda q: apart(F.col("vector"), q)).alias("far")))
    spread = near.agg(F.max(F.size("far")).alias("n"), *(F.var_pop(F.get("far", F.lit(i))).alias(f"v{i}") for i in range(pivots))).first()
    best = sorted(range(spread["n"] or 0), key=lambda i: -(spread[f"v{i}"] or 0.0))[:2]
    best = (best * 2)[:2] or [0, 0]
    # The grid is a little wider than the distance, for the last digit of the pivots' distances.
    wide = eps * (1 + 1e-9) + 1e-12
    cell = {f"g{k}": F.floor(F.get("far", F.lit(i)) / wide) for k, i in enumerate(best)}
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    placed = near.withColumns(cell)
    a = placed.select(F.col("id").alias("a"), F.col("vector").alias("va"), F.col("far").alias("fa"), "g0", "g1", F.explode(steps).alias("s"))
    a = a.select("a", "va", "fa", (F.col("g0") + F.col("s.i")).alias("g0"), (F.col("g1") + F.col("s.j")).alias("g1"))
    b = placed.select(F.col("id").alias("b"), F.col("vector").alias("vb"), F.col("far").alias("fb"), "g0", "g1")
    may = F.forall(F.zip_with("fa", "fb", lambda x, y: F.abs(x - y) <= wide), lambda ok: ok)
    return a.join(b, ["g0", "g1"]).where(may).where(apart(F.col("va"), F.col("vb")) <= eps).select("a", "b")


def _core(ids: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    n = pairs.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("neighbours"))
    return ids.join(n.withColumn("is_core", (F.col("neighbours") >= least).cast("int")), "id")


def vector_core_points(points: DataFrame, eps: float, least: int) -> DataFrame:
    """``(id, neighbours, is_core)`` of all vectors."""
    return _core(points.select("id"), vector_pairs(points, eps), least)


def vector_dbscan(points: DataFrame, eps: float, least: int) -> DataFrame:
    """``(id, label)`` of all vectors, as :func:`dbscan` numbers them."""
    return _labels(points.select("id"), spool(vector_pairs(points, eps)), least)


def core_points(points: DataFrame, columns: list[str], eps: float, least: int) -> DataFrame:
    """``(id, neighbours, is_core)`` of all points."""
    n = eps_pairs(points, columns, eps).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("neighbours"))
    n = n.withColumn("is_core", (F.col("neighbours") >= least).cast("int"))
    return points.select("id").join(n, "id")


def dbscan(points: DataFrame, columns: list[str], eps: float, least: int) -> DataFrame:
    """``(id, label)``: -1 for noise; clusters are numbered by their least core id, and a border point is in the least of them.

    In up to three columns no pairs of points are made. A cell's diagonal is below ``eps``, so a cell of ``least`` points has core
    points only, and a cell's core points are in one cluster. Points of the other cells, fewer than ``least`` each, are held
    against the cells around them, and of two cells it is asked only whether any core points are within reach (:func:`_cell_links`).
    """
    if len(columns) > 3:
        return _labels(points.select("id"), spool(eps_pairs(points, columns, eps)), least)
    at = [f"c{i}" for i in range(len(columns))]
    given = points.dropna(subset=columns).select("id", *(F.col(c).cast("double").alias(k) for c, k in zip(columns, at, strict=True)))
    given = given.where(" and ".join(f"abs({k}) < double('infinity')" for k in at))
    side = eps / math.sqrt(len(columns)) * (1 - 1e-6)
    cell = [f"g{i}" for i in range(len(columns))]
    places = given.groupBy(*at).agg(F.count("*").alias("here"), F.min("id").alias("first"))
    places = spool(places.withColumns({g: F.floor(F.col(k) / side) for g, k in zip(cell, at, strict=True)}))
    crowd = places.groupBy(*cell).agg(F.sum("here").alias("crowd"))
    steps = [t for t in itertools.product(range(-2, 3), repeat=len(cell)) if sum(max(0, abs(d) - 1) ** 2 for d in t) * side * side <= eps * eps]
    around = F.array(*(F.struct(*(F.lit(d).cast("long").alias(g) for g, d in zip(cell, t, strict=True))) for t in steps))

    def met(few: DataFrame, others: DataFrame, *kept: str) -> DataFrame:
        """The places ``few``, as ``a_c0, ...``, with the columns ``kept`` of those of ``others`` within reach."""
        a = few.select(*(F.col(k).alias(f"a_{k}") for k in at), *cell, F.explode(around).alias("s"))
        a = a.select(*(f"a_{k}" for k in at), *((F.col(g) + F.col(f"s.{g}")).alias(g) for g in cell))
        return a.join(others, cell).where(_apart2(*((F.col(f"a_{k}"), F.col(k)) for k in at)) <= eps * eps).select(*(f"a_{k}" for k in at), *kept)

    rare = spool(places.join(crowd.where(F.col("crowd") < least), cell, "left_semi"))
    keys = [F.col(f"a_{k}").alias(k) for k in at]
    own = met(rare, places, "here").groupBy(*keys).agg(F.sum("here").alias("near")).where(F.col("near") >= least)
    core = places.join(crowd.where(F.col("crowd") >= least), cell, "left_semi").unionByName(rare.join(own.select(*at), at, "left_semi"))
    core = spool(core)
    # A cell goes by its least core id.
    named = spool(core.groupBy(*cell).agg(F.min("first").alias("name")))
    links = _cell_links(core, at, cell, side, eps, steps)
    ends = [named.select(*(F.col(g).alias(f"{e}_{g}") for g in cell), F.col("name").alias(e)) for e in "ab"]
    links = links.join(ends[0], [f"a_{g}" for g in cell]).join(ends[1], [f"b_{g}" for g in cell]).select("a", "b")
    links = spool(links.union(links.select("b", "a")).union(named.select(F.col("name").alias("a"), F.col("name").alias("b"))))
    label = _numbered_roots(links).withColumnRenamed("id", "name")
    of_cell = spool(named.join(label, "name").select(*cell, "label"))
    cores = core.join(of_cell, cell).select(*at, "label")
    border = met(rare.join(own.select(*at), at, "left_anti"), core.select(*at, *cell).join(of_cell, cell), "label").groupBy(*keys).agg(F.min("label").alias("label"))
    found = given.join(cores.unionByName(border), at).select("id", "label")
    return points.select("id").join(found, "id", "left").select("id", F.coalesce("label", F.lit(-1)).cast("long").alias("label"))


#: Pairs of core places that the search for links between cells looks at in one go.
FEW_PAIRS = 20_000_000


def _apart2(*axes: tuple[Column, Column]) -> Column:
    return sum(F.pow(a - b, F.lit(2.0)) for a, b in axes)


def _cell_links(core: DataFrame, at: list[str], cell: list[str], side: float, eps: float, steps: list[tuple[int, ...]]) -> DataFrame:
    """``(a_g0, ..., b_g0, ...)``: pairs of cells that hold core places within ``eps``, each pair once.

    Each round knows parts of cells by their bounds and one of their places. Parts whose bounds are too far apart go; parts
    whose places are within reach link their cells; of the rest, halves of each side meet in the next round, until few pairs
    of places are left and meet themselves. In a part of one place bounds and place are the same, so nothing stays open.
    """
    level, linked, last = 0, [], None
    part = [f"p{i}" for i in range(len(cell))]
    in_part = lambda level: core.withColumns({p: F.floor(F.col(k) / side * 2.0**level) for p, k in zip(part, at, strict=True)})
    both = [f"{e}_{g}" for e in "ab" for g in cell]
    onwards = F.array(*(F.struct(*(F.lit(d).cast("long").alias(g) for g, d in zip(cell, t, strict=True))) for t in steps if t > (0,) * len(cell)))
    cells = core.select(*cell).distinct()
    other = cells.select(*cell, F.explode(onwards).alias("s")).select(*(F.col(g).alias(f"a_{g}") for g in cell), *((F.col(g) + F.col(f"s.{g}")).alias(f"b_{g}") for g in cell))
    open_ = other.join(cells.select(*(F.col(g).alias(f"b_{g}") for g in cell)), [f"b_{g}" for g in cell], "left_semi")
    # At first a part is its cell.
    open_ = spool(open_.select(*both, *(F.col(f"{e}_{g}").alias(f"{e}_{p}") for e in "ab" for g, p in zip(cell, part, strict=True))))
    while True:
        bounds = in_part(level).groupBy(*part).agg(
            F.count("*").alias("many"), F.min(F.struct(*at)).alias("one"), *(F.min(k).alias(f"lo_{k}") for k in at), *(F.max(k).alias(f"hi_{k}") for k in at)
        )
        end = lambda e: bounds.select(*(F.col(c).alias(f"{e}_{c}") for c in bounds.columns))  # noqa: E731, B023
        seen = open_.join(end("a"), [f"a_{p}" for p in part]).join(end("b"), [f"b_{p}" for p in part])
        gap = sum(F.pow(F.greatest(F.col(f"a_lo_{k}") - F.col(f"b_hi_{k}"), F.col(f"b_lo_{k}") - F.col(f"a_hi_{k}"), F.lit(0.0)), F.lit(2.0)) for k in at)
        seen = seen.where(gap <= eps * eps).withColumn("near", _apart2(*((F.col(f"a_one.{k}"), F.col(f"b_one.{k}")) for k in at)) <= eps * eps)
        seen = spool(seen.select(*both, *(f"{e}_{p}" for e in "ab" for p in part), "near", (F.col("a_many") * F.col("b_many")).alias("pairs")))
        hit = seen.where("near").select(*both).distinct()
        linked.append(hit)
        rest = spool(seen.join(hit, both, "left_anti").drop("near"))
        forget(open_)
        pairs = rest.agg(F.sum("pairs")).first()[0] or 0
        if pairs <= FEW_PAIRS:
            end = lambda e: in_part(level).select(*(F.col(c).alias(f"{e}_{c}") for c in (*at, *part)))
            met = rest.join(end("a"), [f"a_{p}" for p in part]).join(end("b"), [f"b_{p}" for p in part])
            linked.append(met.where(_apart2(*((F.col(f"a_{k}"), F.col(f"b_{k}")) for k in at)) <= eps * eps).select(*both).distinct())
            return spool(functools.reduce(DataFrame.union, linked).distinct())
        level += 1
        child = lambda e: in_part(level).select(*part).distinct().select(  # noqa: E731, B023
            *(F.floor(F.col(p) / 2).alias(f"{e}_{p}") for p in part), *(F.col(p).alias(f"{e}_child_{p}") for p in part)
        )
        halved = rest.join(child("a"), [f"a_{p}" for p in part]).join(child("b"), [f"b_{p}" for p in part])
        open_ = spool(halved.select(*both, *(F.col(f"{e}_child_{p}").alias(f"{e}_{p}") for e in "ab" for p in part)))


def _numbered_roots(links: DataFrame) -> DataFrame:
    """``(id, label)`` of all ends of the spooled ``links`` ``(a, b)``, given both ways and from each end to itself: components,
    numbered from 0 by their least end."""
    label = spool(links.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root")))
    while True:  # a label jumps to its root's label, so rounds grow with the logarithm of a cluster's width
        least_near = links.join(label.toDF("b", "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("root"))
        jump = least_near.join(label.toDF("root", "next"), "root", "left").select("id", F.least("root", F.coalesce("next", "root")).alias("root"))
        new = spool(jump)
        changed = new.join(label.toDF("id", "old"), "id").where("root <> old").limit(1).count()
        forget(label)
        label = new
        if not changed:
            break
    return label.join(numbered(label.select("root").distinct(), ["root"], "label"), "root").select("id", "label")


def _labels(ids: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    """``(id, label)`` of all ``ids`` from the spooled pairs within reach."""
    core = pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= least).select(F.col("a").alias("c"))
    links = spool(pairs.join(core, F.col("a") == F.col("c"), "left_semi").join(core, F.col("b") == F.col("c"), "left_semi"))
    cores = _numbered_roots(links)
    border = pairs.join(cores.toDF("b", "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("border"))
    out = ids.join(cores, "id", "left").join(border, "id", "left")
    return out.select("id", F.coalesce("label", "border", F.lit(-1)).cast("long").alias("label"))


def _vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(df.dropna(subset=columns))


def kmeans(df: DataFrame, columns: list[str], k: int, seed: int = 1) -> DataFrame:
    """``df`` with ``cluster``."""
    v = _vectors(df, columns)
    return KMeans(k=k, seed=seed, predictionCol="cluster").fit(v).transform(v).drop("features")


def gaussian_mixture(df: DataFrame, columns: list[str], k: int, seed: int = 1) -> DataFrame:
    """``df`` with ``cluster`` and ``probability``: full-covariance mixture by expectation maximisation.

    Stands in for the Bayesian mixture as well, whose prior on weights Spark does not have.
    """
    v = _vectors(df, columns)
    out = GaussianMixture(k=k, seed=seed, predictionCol="cluster", probabilityCol="p").fit(v).transform(v)
    return out.withColumn("probability", F.array_max(vector_to_array("p"))).drop("features", "p")


def gaussian_nb(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """``df`` with ``predicted``: Gaussian naive Bayes trained on rows whose ``label`` is not null."""
    v = _vectors(df, columns)
    model = NaiveBayes(modelType="gaussian", labelCol="target", predictionCol="predicted").fit(
        v.where(F.col(label).isNotNull()).withColumn("target", F.col(label).cast("double"))
    )
    return model.transform(v).drop("features", "rawPrediction", "probability")
