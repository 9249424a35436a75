"""Running sums and numbers over a whole table, or over groups of any size, without one task that holds a group.

Rows are dealt out by ranges of the order, so a task has a stretch of it. Totals of the stretches are summed over the
stretches before, and what a row lacks is the running sum within its own. A group that has many rows lies in many stretches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import spool


def running(df: DataFrame, order: Sequence[Column | str], sums: dict[str, Column | str], groups: Sequence[str] = ()) -> DataFrame:
    """``df`` with the running sums ``sums`` (name to column) in ``order``, each row's own value included, in each group.

    ``order`` has to tell rows apart: values that repeat are counted first. Group columns hold no nulls; a null value counts
    as 0. An empty table stays empty.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    added = {n: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)) for n, c in sums.items()}
    dealt = spool(df.withColumns({f"_{n}": c for n, c in added.items()}).repartitionByRange(*groups, *order).withColumn("_stretch", F.spark_partition_id()))
    totals = dealt.groupBy("_stretch", *groups).agg(*(F.sum(f"_{n}").alias(n) for n in sums))
    before = Window.partitionBy(*groups).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_stretch", *groups, *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in sums))
    inside = Window.partitionBy("_stretch", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = dealt.withColumns({f"_{n}": F.sum(f"_{n}").over(inside) for n in sums}).join(starts, ["_stretch", *groups])
    return summed.select(*df.columns, *((F.col(f"_{n}") + F.col(f"_before_{n}")).alias(n) for n in sums))


def numbered(df: DataFrame, order: Sequence[Column | str], name: str, groups: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``name``: each row's place in ``order``, from 0, in each group."""
    found = running(df, order, {name: F.lit(1).cast("long")}, groups)
    return found.withColumn(name, F.col(name) - 1)
