"""A training mix of sources by target weights, in DataFrame functions alone.

Targets are found by capped water-filling. Sources share the mix by weight; one that would be read more than ``EPOCHS``
times is clamped at that, and what it leaves over is shared again by weight until nobody is above. The order in which
sources clamp is that of cap over weight, so one sweep over the sources in that order, with running sums of caps and
weights, finds where it ends; the comparison is made in whole numbers.

A source's target is so many whole repetitions of all its documents and a rest. The rest is filled with documents in the
order of a seeded hash of their ids until it is used up; the document at the end is taken in part. So a source's taken
words are its target but for rounding. Places in that order are prefix sums: documents fall into slices of the hash, and a
slice's start is the sum of the slices before it, so a source that holds most rows is spread over all slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spool

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in the order of their names, over and over.
WEIGHTS = (3, 1, 2)
#: The mix's size as a part of all words: 150 %.
SHARE = (3, 2)
#: Times that a source is repeated at most.
EPOCHS = 2
SEED = 12
#: Hexadecimal digits of the hash, and how many of them name a slice: each source has up to 4,096.
_DIGITS, _SLICE = 15, 3


def words(text: Column) -> Column:
    """Words of a text; none if it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _place(key: Column, seed: int) -> Column:
    """A document's place in the seeded order: 60 bits of a hash."""
    x = F.md5(F.concat(F.lit(f"{seed}:"), key))
    return F.conv(F.substring(x, 1, _DIGITS), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """``sizes`` ``(none, name, source_size)``, a row for each source, with ``target``.

    Sources without words have target 0. If all caps together are below the share, each source is at its cap. The windows
    here go over one row for each source, however many documents there are.
    """
    whole = lambda c: c.cast("decimal(38,0)")
    turn = F.pmod(F.row_number().over(Window.orderBy("none", "name")) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long")
    s = sizes.withColumn("weight", w).withColumn("cap", epochs * F.col("source_size"))
    # From the source that clamps first: what is clamped before it, and the weights from it on.
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "none", "name")
    before, on = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumns({"total": F.sum("source_size").over(Window.partitionBy()), "clamped": F.coalesce(F.sum("cap").over(before), F.lit(0)), "open": F.sum("weight").over(on)})
    top, bottom = share
    left = whole(top * F.col("total") - bottom * F.col("clamped"))
    s = s.withColumn("fits", left * whole(F.col("weight")) <= whole(bottom * F.col("cap")) * whole(F.col("open")))
    level = F.min(F.when(F.col("fits"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "none", "name", (left.cast("double") / (bottom * F.col("open"))).alias("level"))))
    s = s.withColumn("level", level.over(Window.partitionBy())["level"])
    return s.select("none", "name", "source_size", F.coalesce(F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")), F.col("cap").cast("double")).alias("target"))


def plan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, epochs: int = EPOCHS, seed: int = SEED,
) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``, a row for each row of ``docs``: how many of its words the mix takes.

    ``taken`` is whole repetitions of ``size`` and, for the documents first in the seeded order, one more or a part of one.
    A null text has size 0 and gives nothing; a null source is a source of its own, the last. A document without an id is
    placed by its text. Repeated rows each count, next to each other. An empty table gives no rows, and a table without
    words takes none. The same rows give the same result on any partitions.
    """
    key = F.coalesce(F.col(id_col).cast("long").cast("string"), F.concat(F.lit("text:"), F.coalesce(F.col(text_col), F.lit(""))))
    read = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).isNull().alias("none"), F.coalesce(F.col(source_col), F.lit("")).alias("name"),
        words(F.col(text_col)).alias("size"), _place(key, seed).alias("place"),
    )
    sized = spool(read.withColumn("slice", F.shiftright("place", 4 * (_DIGITS - _SLICE)).cast("int")))
    slices = spool(sized.groupBy("none", "name", "slice").agg(F.sum("size").alias("words")))
    goal = targets(slices.groupBy("none", "name").agg(F.sum("words").alias("source_size")), weights, share, epochs)
    # Whole repetitions and the rest, in whole numbers.
    goal = goal.withColumn("quota", F.floor(F.col("target") + 0.5))
    goal = goal.withColumn("times", F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(0))
    goal = goal.withColumn("rest", F.col("quota") - F.col("times") * F.col("source_size")).drop("quota")
    start = F.coalesce(F.sum("words").over(Window.partitionBy("none", "name").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = slices.withColumn("start", start).drop("words").join(goal, ["none", "name"])
    inside = Window.partitionBy("none", "name", "slice").orderBy("place", F.col("doc_id").asc_nulls_last(), "size")
    placed = sized.withColumn("before", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rest = F.col("rest") - F.col("start") - F.col("before")
    taken = F.col("times") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return placed.join(starts, ["none", "name", "slice"]).select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix(planned: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, repetition, text)``: the mix itself, a row for each repetition of a document, from 1 on.

    ``planned`` is :func:`plan`'s result. A whole repetition has the whole text, a part its text up to the end of the last
    word taken. Documents of which nothing is taken, or without an id, give no row; ids are expected to be different, rows
    that repeat one are taken as often as its first row.
    """
    p = planned.where("taken > 0 and doc_id is not null").groupBy(F.col("doc_id").alias("planned_id")).agg(F.max("size").alias("size"), F.max("taken").alias("taken"))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(p, F.col("doc_id") == F.col("planned_id"))
    each = d.withColumn("repetition", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size")))))
    part = F.col("taken") - (F.col("repetition") - 1) * F.col("size")
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), part.cast("int")), "")
    return each.select("doc_id", "repetition", F.when(part < F.col("size"), cut).otherwise(F.col("text")).alias("text"))
