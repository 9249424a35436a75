"""SimHash fingerprints and exact near-duplicate groups by a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits and mapped to the vector of its segments' bit counts. Flipping a
bit changes one count by one, so the Manhattan distance of two vectors is a lower bound of the Hamming distance. Pairs
within Manhattan distance 2 are found by a grid join: the vector is cut into eight blocks of four counts, and a distance
of 2 can touch two blocks at most, so such a pair agrees in six blocks; each of the 28 sets of six blocks is a grid whose
cells are the counts in them. Of unrelated fingerprints one pair in 10^10 or so shares a cell of a grid, so pairs stay few
even among 10^9 different fingerprints; with half as many blocks it would be one in 10^7. Pairs that share a cell are filtered by the Manhattan distance and then verified on the
fingerprints. Nothing is lost and nothing is linked wrongly.

Counts are kept in unary form (0, 1, 2 as 00, 01, 11), where the Manhattan distance is the bit count of an exclusive or.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .common import spool
from .components import connected_components

SHINGLE = 3
SEED = 42
DISTANCE = 2
_ODD = 0x5555555555555555
_BLOCKS = 8


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The signed 64-bit fingerprint of one text; null and texts without words have 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(x, seed) for x in parts], dtype=">u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` of every row of ``docs``, over whole texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "fp": [fingerprint(t) for t in b["text"]]})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        run, "doc_id long, fp long"
    )


def _unary(fp: F.Column) -> F.Column:
    """The segments' bit counts in unary form."""
    high = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(high).bitwiseAND(F.lit(_ODD))
    both = fp.bitwiseAND(high).bitwiseAND(F.lit(_ODD))
    return some.bitwiseOR(F.shiftleft(both, 1))


def near_pairs(fps: DataFrame) -> DataFrame:
    """``(u, v)``: all pairs of different fingerprints ``fp`` in ``fps`` that differ in two bits or fewer.

    ``fps`` holds each fingerprint once, so copies of a text meet nowhere.
    """
    width = 64 // _BLOCKS
    masks = []
    for blocks in combinations(range(_BLOCKS), _BLOCKS - DISTANCE):
        mask = sum(((1 << width) - 1) << (width * b) for b in blocks)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    cells = F.array(
        *(
            F.struct(F.lit(i).alias("grid"), F.col("counts").bitwiseAND(F.lit(m)).alias("cell"))
            for i, m in enumerate(masks)
        )
    )
    placed = fps.select("fp", _unary(F.col("fp")).alias("counts")).select(
        "fp", "counts", F.explode(cells).alias("c")
    )
    a = placed.select("c.grid", "c.cell", F.col("fp").alias("u"), F.col("counts").alias("cu"))
    b = placed.select("c.grid", "c.cell", F.col("fp").alias("v"), F.col("counts").alias("cv"))
    near = (
        (F.col("u") < F.col("v"))
        & (F.bit_count(F.col("cu").bitwiseXOR(F.col("cv"))) <= DISTANCE)
        & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE)
    )
    # Spark takes a table for as small as its files, even after an explode, and would send all 28 cells of each to the driver.
    joined = a.alias("a").join(
        b.alias("b").hint("merge"), (F.col("a.grid") == F.col("b.grid")) & (F.col("a.cell") == F.col("b.cell")) & near
    )
    return joined.select("u", "v")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per row of ``docs``.

    ``component_id`` is the smallest id reachable over links. A null or empty text has fingerprint 0 and is linked like
    any other. Repeated rows each give a row. A row with a null id has the group's smallest id, or null if none of the
    group has an id. An empty table gives an empty result.
    """
    fps = spool(fingerprints(docs, id_col, text_col))
    classes = spool(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = connected_components(near_pairs(classes))
    groups = (
        classes.join(linked.hint("merge"), classes["fp"] == linked["node"], "left")
        .select(classes["fp"], "least", F.coalesce("component", classes["fp"]).alias("root"))
    )
    roots = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = groups.join(roots.hint("merge"), "root").select(F.col("fp").alias("key"), "component_id")
    return fps.join(of_fp.hint("merge"), F.col("fp") == F.col("key")).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one document of each near-duplicate group is kept: that of the smallest id.

    Fingerprints that :func:`near_pairs` links give candidates, each of which is verified on its sets of five-word shingles: a
    similarity of 0.8 or more. What fingerprints miss at that similarity :func:`jaccard.groups` finds, so no link is lost. Of several rows of a group with
    that id one stays; where rows of different groups share an id, each group keeps its own. Rows without an id stay only if no row of
    their group has an id, and then one of them does.
    """
    found = spool(jaccard.groups(docs, id_col, text_col, fingerprint=fingerprint, near=near_pairs))
    # A group's row is named by its id, and by its set of shingles where rows of other texts have that id too.
    kept = found.where("doc_id = component_id").groupBy("root").agg(F.first("doc_id").alias("kept_id"), F.min("fp").alias("kept_fp"))
    often = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("kept_id"))
    once, named = kept.join(often, "kept_id", "left_anti").select("kept_id"), spool(kept.join(often, "kept_id", "left_semi").select("kept_id", "kept_fp"))
    # The row travels as one column, so no name of it meets a name used here.
    boxed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("row_text"))
    rows = boxed.join(once, F.col("row_id") == F.col("kept_id"))
    again = boxed.withColumn("row_text", F.coalesce("row_text", F.lit(""))).join(named.select("kept_id").distinct(), F.col("row_id") == F.col("kept_id"), "left_semi")
    told = fingerprints_with_text(again, "row_text").distinct()
    again = again.join(told, F.col("row_text") == F.col("text")).join(named, (F.col("row_id") == F.col("kept_id")) & (F.col("fp") == F.col("kept_fp")))
    again = again.dropDuplicates(["row_id", "kept_fp"])
    no_id = boxed.where("row_id is null").withColumn("row_text", F.coalesce("row_text", F.lit("")))
    lone = found.where("component_id is null").groupBy("root").agg(F.min("fp").alias("fp")).select("fp")
    texts = fingerprints_with_text(no_id, "row_text").join(lone, "fp").groupBy("fp").agg(F.min("text").alias("kept_text")).select("kept_text")
    extra = no_id.join(texts, F.col("row_text") == F.col("kept_text"), "left_semi").dropDuplicates(["row_text"])
    out = rows.select("row").union(again.select("row")).union(extra.select("row"))
    return out.select("row.*")


def fingerprints_with_text(docs: DataFrame, text_col: str) -> DataFrame:
    """``(text, fp)`` of rows that have no id to join on; ``fp`` names the text's set of shingles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"text": b["text"], "fp": [jaccard.set_key(jaccard.shingles(t)) for t in b["text"]]})

    return docs.select(F.col(text_col).alias("text")).mapInPandas(run, "text string, fp long")
