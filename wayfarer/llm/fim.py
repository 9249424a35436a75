"""Fill-in-middle documents: an indexable skip list over a text's lines finds where it is cut.

The units of a text are its lines, each with its line break. The list's lowest lane has a link for every unit; a unit
stands in the next lane with probability 1 / 4. A link of any lane carries two widths: how many units and how many code
points it passes. A descent from the sparsest lane adds up unit widths without passing the rank wanted, and the code-point
widths added on the way are where the text is cut, exactly. Towers are drawn from a hash of the unit's number, so a list is
the same wherever it is built.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Of 100 texts, how many are rearranged, and of 100 of those, how many have their suffix first.
RATE, SPM_RATE = 100, 50


@dataclass(frozen=True)
class Lane:
    """The nodes of one lane, the head first: where each stands in the lane below and the widths of the link that leaves it."""

    below: np.ndarray
    units: np.ndarray
    points: np.ndarray


class SkipList:
    """Ranks of units to places in code points. ``widths`` are the units' code points, in order."""

    def __init__(self, widths: np.ndarray) -> None:
        n = len(widths)
        self.n, self.lanes = n, []
        # The head, then the units; a node's end is the place behind its unit.
        ends = np.concatenate(([0], np.cumsum(widths, dtype=np.int64)))
        ranks = np.arange(n + 1, dtype=np.int64)
        below = ranks
        while True:
            self.lanes.append(Lane(below, np.diff(ranks), np.diff(ends)))
            if len(ranks) == 1:
                break
            tall = _promoted(ranks, len(self.lanes))
            tall[0] = True
            below, ranks, ends = np.flatnonzero(tall), ranks[tall], ends[tall]

    def place(self, rank: int) -> int:
        """Code points of the first ``rank`` units."""
        node, units, points = 0, 0, 0
        for k in range(len(self.lanes) - 1, -1, -1):
            lane = self.lanes[k]
            while node < len(lane.units) and units + lane.units[node] <= rank:
                units, points, node = units + int(lane.units[node]), points + int(lane.points[node]), node + 1
            if k:
                node = int(lane.below[node])
        if units != rank:
            raise IndexError(f"rank {rank} of {self.n} units")
        return points


def _promoted(ranks: np.ndarray, lane: int) -> np.ndarray:
    """Which nodes of a lane stand in the next one: a quarter of them, by a multiplicative hash of their ranks."""
    x = ranks.astype(np.uint64) + np.uint64(lane * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(62)) == 0


def line_widths(raw: bytes) -> np.ndarray:
    """Code points of each line of a UTF-8 text; a line has its line break, the last one may lack it."""
    b = np.frombuffer(raw, np.uint8)
    starts = np.concatenate(([0], np.flatnonzero(b == 10) + 1)).astype(np.int64)
    starts = starts[starts < len(b)]
    if not len(starts):
        return np.zeros(0, np.int64)
    return np.add.reduceat((b & 0xC0) != 0x80, starts, dtype=np.int64)


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """The four 32-bit numbers that decide about a document; a null id is an empty one."""
    x = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(x[i : i + 8], 16) for i in (0, 8, 16, 24))


def arrange(text: str, raw: bytes, doc_id: int | None, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> tuple[int, str, int | None, int | None, str]:
    """``(n, form, prefix_chars, middle_chars, output)`` of one text."""
    widths = line_widths(raw)
    n = len(widths)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    units = SkipList(widths)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = units.place(low), units.place(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str | None, form: str | None) -> str | None:
    """The text that an output of :func:`arrange` was made of, from the output and its form alone."""
    if output is None or form not in ("psm", "spm"):
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    head, _, middle = output[len(first) :].partition(MIDDLE)
    one, _, two = head.partition(second)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def _boxed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))


def _rows(b: pa.RecordBatch, **how) -> Iterator[tuple]:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)``; bytes that are no UTF-8 are carried through as they are."""
    for doc_id, raw in zip(b.column("doc_id").to_pylist(), b.column("raw"), strict=True):
        raw = raw.as_py()
        yield (doc_id, *arrange(raw.decode("utf-8", "surrogateescape"), raw, doc_id, **how))


FIELDS = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)``: every whole text cut at two line ends and put in the order
    in which a model is to learn it.

    A null text counts as empty. Empty texts and texts that hold one of the three marks stay as they are, in the form
    ``plain``, with null widths. Repeated rows each give a row, and the same one, as an id decides the cuts; all null ids
    have the same draws. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*FIELDS, ("output", pa.binary())])
        for b in batches:
            for r in _rows(b, rate=rate, spm_rate=spm_rate, seed=seed):
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*r[:-1], r[-1].encode("utf-8", "surrogateescape")), strict=True))], schema)

    found = _boxed(docs, id_col, text_col).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return found.withColumn("output", F.col("output").cast("string"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)``: :func:`transform`'s rows with the
    digests of the output and of the text that is restored from it. Null, empty and repeated rows are as there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*FIELDS, ("output_sha256", pa.string()), ("restored_sha256", pa.string())])
        sha = lambda t: hashlib.sha256(t.encode("utf-8", "surrogateescape")).hexdigest()
        for b in batches:
            rows = [(*r[:-1], sha(r[-1]), sha(restore(r[-1], r[2]))) for r in _rows(b, rate=rate, spm_rate=spm_rate, seed=seed)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    kind = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return _boxed(docs, id_col, text_col).mapInArrow(run, kind)
