"""Counts of the points below and left of each point, by blocks of ranks.

Points are numbered twice: by ``(x, y)`` and by ``(y, x)``. One point lies in the lower left quadrant of another exactly if
both its numbers are less, so only ranks matter, and ties, or many points on one line, do no harm. Ranks by ``(x, y)`` are cut
into slices and ranks by ``(y, x)`` into bins of some square root of the points each. What lies below and left of a point are
the whole cells of earlier slices and earlier bins, the points of its own slice, and the points of earlier slices in its own
bin. A bin's task counts the last and, for every slice, how much of the bin lies before it; a slice's task sums these up and
counts the second. The work is ``n log n``, a task holds a slice or a bin.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import spool
from .ordering import numbered

#: Points of a slice or bin, at least.
LEAST = 4_096


def smaller_before(ranks: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each place the sum of the rows of ``weights`` at earlier places with smaller ``ranks``, all of them different.

    Halves of ever larger stretches are compared, each level at once.
    """
    out, by, level = np.zeros_like(weights), np.argsort(ranks, kind="stable"), 0
    while 1 << level < len(ranks):
        seq = by[np.argsort(by >> (level + 1), kind="stable")]
        first = (seq >> level & 1) == 0
        sums = np.concatenate((np.zeros_like(weights[:1]), np.cumsum(np.where(first[:, None], weights[seq], 0), axis=0)))
        at = np.flatnonzero(~first)
        out[seq[at]] += sums[at] - sums[seq[at] >> (level + 1) << (level + 1)]
        level += 1
    return out


def below_left(points: DataFrame, x: str, y: str, weights: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """``points`` with ``below_<weight>``: sums of the whole-number ``weights`` over the points with no greater ``x`` and no
    greater ``y``, the point itself included, within its group.

    ``points`` has each ``(groups, x, y)`` once; other columns than these and the weights go. Nothing is null.
    """
    keys, w = list(groups), list(weights)
    ranked = numbered(numbered(points.select(*keys, x, y, *w), [x, y], "rx", keys), [y, x], "ry", keys)
    ranked = spool(ranked)
    many = ranked.groupBy(*keys).agg((F.max("rx") + 1).alias("many"))
    most = many.agg(F.max("many")).first()[0] or 1
    size = max(LEAST, math.isqrt(most) + 1)
    counted = ranked.join(many, keys) if keys else ranked.withColumn("many", F.lit(most).cast("long"))
    placed = counted.select(
        *keys, x, y, *(F.col(c).cast("long").alias(c) for c in w), "rx", "ry", F.floor(F.col("rx") / size).alias("slice"), F.floor(F.col("ry") / size).alias("bin"),
        F.ceil(F.col("many") / size).alias("slices"), *(F.lit(0).cast("long").alias(f"below_{c}") for c in w), F.lit(False).alias("total"),
    )
    below = [f"below_{c}" for c in w]

    def in_bin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["slice", "ry"], ascending=[True, False], ignore_index=True)
        weight, slices = pdf[w].to_numpy(np.int64), int(pdf["slices"].iloc[0])
        pdf[below] = smaller_before(pdf["ry"].to_numpy(), weight)
        # For every slice, what of this bin lies in the slices before.
        sums = np.zeros((slices, len(w)), np.int64)
        np.add.at(sums, pdf["slice"].to_numpy(), weight)
        before = np.cumsum(sums, axis=0) - sums
        row = pdf.iloc[[0] * slices].reset_index(drop=True).assign(slice=np.arange(slices), rx=-1, ry=-1, total=True)
        row[below] = before
        return pd.concat([pdf, row[before.any(axis=1)]])

    def in_slice(pdf: pd.DataFrame) -> pd.DataFrame:
        totals = pdf[pdf["total"]].sort_values("bin")
        pdf = pdf[~pdf["total"]].sort_values("rx", ignore_index=True)
        weight = pdf[w].to_numpy(np.int64)
        sums = np.concatenate((np.zeros((1, len(w)), np.int64), np.cumsum(totals[below].to_numpy(np.int64), axis=0)))
        earlier = sums[np.searchsorted(totals["bin"].to_numpy(), pdf["bin"].to_numpy())]
        pdf[below] = pdf[below].to_numpy(np.int64) + earlier + smaller_before(pdf["ry"].to_numpy(), weight) + weight
        return pdf

    # The bins' frames hold points and totals; a slice without points has none.
    found = placed.groupBy(*keys, "bin").applyInPandas(in_bin, placed.schema).groupBy(*keys, "slice").applyInPandas(in_slice, placed.schema)
    return found.select(*keys, x, y, *w, *below)
