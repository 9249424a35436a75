"""Exact-substring dedup: every byte that lies in a long string which also stands elsewhere is found and removed.

Two equal strings of ``LENGTH`` bytes are at the same place of some order of all suffixes, so sorting suffixes and
comparing neighbours finds them; sorting all suffixes of a corpus, though, moves many times its size. Three steps keep it
small, and lose nothing:

* Each string of ``LENGTH`` bytes has an anchor, the least hashed gram in it, which equal strings share at the same
  place. Consecutive strings with one anchor form a block. Blocks are counted, never positions: all strings of a block
  that stands twice are repeated, and a block whose anchor stands nowhere else holds none.
* What is left are different blocks that share an anchor. Equal strings have equal anchors, so these groups are dealt out
  by anchor, and each task sorts the suffixes of its groups by the difference-cover algorithm: it sorts the triples at
  two of three places, recurses on their names, and merges the remaining suffixes. Neighbours in that order are compared
  byte by byte over ``LENGTH`` bytes.
* A group that doesn't fit in a task is cut up until its parts do. The strings of a block differ in how far before the
  anchor they begin; cut in two by that, each half shares a longer gram around the anchor, and equal strings fall into
  the same half with the same gram. Halves with an equal gram are counted and, where they differ, sorted like blocks, or
  cut again, until a gram is the string itself. Each cut makes two rows of one at most, and a hot passage's rows end as
  soon as their grams reach out of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spool

#: Bytes of a repeated string, and of the grams that anchors are chosen from.
LENGTH, GRAM = 400, 160
#: Bytes of blocks that a task sorts at once; groups of more are cut up.
SORTED = 1 << 20
#: Bytes of a text that are read at once; pieces overlap by a string less a byte.
PIECE = 1 << 20
_WINDOW = LENGTH - GRAM + 1
_PLACE = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, base, np.uint64))))


class Anchors:
    """Cuts texts into blocks."""

    def __init__(self) -> None:
        self.up, self.down = _powers(_BASE, PIECE + LENGTH), _powers(pow(_BASE, -1, 1 << 64), PIECE + LENGTH)

    def grams(self, raw: np.ndarray, size: int) -> np.ndarray:
        """A hash of the ``size`` bytes from each place of ``raw`` on."""
        with np.errstate(over="ignore"):
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], out=sums[1:])
            h = (sums[size:] - sums[:-size]) * self.down[: len(raw) - size + 1]
            for shift in (32, 29):
                h ^= h >> np.uint64(shift)
                h *= np.uint64(0xD6E8FEB86659FD93)
            return h ^ (h >> np.uint64(32))

    def blocks(self, data: bytes) -> Iterator[tuple[int, int, int, int]]:
        """``(first string, strings, anchor's offset from the first string, anchor)`` of each block of a text."""
        for at in range(0, max(0, len(data) - LENGTH + 1), PIECE):
            raw = np.frombuffer(data, np.uint8)[at : at + PIECE + LENGTH - 1]
            h = self.grams(raw, GRAM)
            n = len(h)
            # Least gram of each window, the last one of equals: minima over runs of a window's length meet in the middle.
            mark = (h & ~_PLACE) | (_PLACE - np.arange(n, dtype=np.uint64))
            runs = np.concatenate([mark, np.full(-n % _WINDOW, ~np.uint64(0))]).reshape(-1, _WINDOW)
            fore = np.minimum.accumulate(runs, 1).ravel()
            back = np.minimum.accumulate(runs[:, ::-1], 1)[:, ::-1].ravel()
            least = np.minimum(back[: n - _WINDOW + 1], fore[_WINDOW - 1 : n])
            anchor = (_PLACE - (least & _PLACE)).astype(np.int64)
            first = np.flatnonzero(np.diff(anchor, prepend=-1))
            count = np.diff(first, append=len(anchor))
            place = anchor[first]
            yield from zip((first + at).tolist(), count.tolist(), (place - first).tolist(), h[place].view(np.int64).tolist(), strict=True)


# --- suffixes ----------------------------------------------------------------------------------------------------------


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffixes of ``s`` in order, by difference covers. Values are from 1 to 2^21 - 1, and so is the length."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s, np.zeros(3, np.int64)]).astype(np.int64)
    one = np.arange(1, n + (n % 3 == 1), 3)
    sample = np.concatenate([one, np.arange(2, n, 3)])
    triple = t[sample] << 42 | t[sample + 1] << 21 | t[sample + 2]
    order = np.argsort(triple, kind="stable")
    fresh = np.diff(triple[order], prepend=-1) != 0
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(fresh)
    if not fresh.all():
        order = suffix_array(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    ordered = sample[order]
    ordered = ordered[ordered < n]
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(t[rest] << 22 | rank[rest + 1], kind="stable")]
    # A remaining suffix is one symbol before a sampled one, and two before another: enough to compare it with either.
    near = lambda i: t[i] << 22 | rank[i + 1]
    far = lambda i: t[i] << 42 | t[i + 1] << 21 | rank[i + 2]
    ones, twos = ordered[ordered % 3 == 1], ordered[ordered % 3 == 2]
    before = np.searchsorted(near(ones), near(rest)) + np.searchsorted(far(twos), far(rest))
    out = np.empty(n, np.int64)
    mine = np.arange(len(rest)) + before
    other = np.ones(n, bool)
    other[mine] = False
    out[mine], out[other] = rest, ordered
    return out


def repeated(blocks: list[tuple[bytes, int]]) -> list[np.ndarray]:
    """For each block, ``(bytes, strings)``, which of its strings stand twice among the strings of all these blocks."""
    sizes = np.array([len(b) for b, _ in blocks])
    starts = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"".join(b for b, _ in blocks), np.uint8)
    counts = np.array([n for _, n in blocks])
    valid = np.zeros(len(raw), bool)
    places = np.repeat(starts, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    valid[places] = True
    order = suffix_array(raw.astype(np.int64) + 1)
    order = order[valid[order]]
    strings = np.lib.stride_tricks.sliding_window_view(raw, LENGTH)
    same = np.empty(max(0, len(order) - 1), bool)
    for i in range(0, len(same), 4096):
        part = order[i : i + 4097]
        same[i : i + 4096] = (strings[part[1:]] == strings[part[:-1]]).all(1)
    twice = np.zeros(len(raw), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return [twice[a : a + n] for a, n in zip(starts.tolist(), counts.tolist(), strict=True)]


def _runs(on: np.ndarray) -> list[tuple[int, int]]:
    """The bytes from the first string of each run to the end of its last one."""
    edge = np.diff(on.astype(np.int8), prepend=0, append=0)
    return [(int(a), int(b) + LENGTH - 1) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans joined where they overlap or touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


# --- the job -----------------------------------------------------------------------------------------------------------

#: A row of documents is known by its id (null: -1) and a hash of its text; rows equal in both have the same result.
_TEXT = "doc long, print long, data binary"


def _texts(docs: DataFrame, id_col: str, text_col: str, *others: str) -> DataFrame:
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(
        *others,
        F.coalesce(F.col(id_col).cast("long"), F.lit(-1).cast("long")).alias("doc"), F.xxhash64(data).alias("print"), data.alias("data")
    )


def _occurrences(texts: DataFrame) -> DataFrame:
    """``(anchor, block, doc, print, place)`` of every block; ``place`` has first string, strings and offset in one number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cutter = Anchors()
        for b in batches:
            rows = []
            for doc, print_, data in zip(b["doc"].tolist(), b["print"].tolist(), b["data"].tolist(), strict=True):
                view = memoryview(data)
                for first, count, offset, anchor in cutter.blocks(data):
                    block = xxhash.xxh3_128_digest(view[first : first + count + LENGTH - 1], offset)
                    rows.append((anchor, block, doc, print_, first << 20 | count << 10 | offset))
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=["anchor", "block", "doc", "print", "place"])
                    rows = []
            yield pd.DataFrame(rows, columns=["anchor", "block", "doc", "print", "place"])

    return texts.where(F.length("data") >= LENGTH).mapInPandas(run, "anchor long, block binary, doc long, print long, place long")


#: A piece of a text: ``strings`` from ``first`` on whose bytes are ``data``, all with one anchor, which the first of
#: them has ``offset`` bytes after its start. ``cell`` numbers the range of offsets it was cut to, and the pieces of a
#: cell with an equal ``gram`` are a group. Strings of a piece that isn't ``open`` are known to be repeated.
_PIECE = "cell int, gram long, kind binary, doc long, print long, first long, strings int, offset int, open boolean, data binary"
_COLUMNS = [c.split()[0] for c in _PIECE.split(", ")]
_GROUP = ["cell", "gram"]


def _block_bytes(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The pieces of ``wanted`` blocks ``(doc, print, anchor, block, place, open)``: each block once, in cell 1."""
    lists = wanted.groupBy("doc", "print").agg(F.collect_list(F.struct("anchor", "block", "place", "open")).alias("blocks"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, print_, data, blocks in zip(b["doc"].tolist(), b["print"].tolist(), b["data"].tolist(), b["blocks"].tolist(), strict=True):
                for x in blocks:
                    first, count, offset = x["place"] >> 20, x["place"] >> 10 & 1023, x["place"] & 1023
                    rows.append((1, x["anchor"], x["block"], doc, print_, first, count, offset, x["open"], data[first : first + count + LENGTH - 1]))
            yield pd.DataFrame(rows, columns=_COLUMNS)

    # A text that stands under its id several times gives its blocks as often.
    return texts.join(lists, ["doc", "print"]).mapInPandas(run, _PIECE).dropDuplicates(["cell", "gram", "kind"])


def _range(cell: int) -> tuple[int, int]:
    """The offsets of a cell: 1 has all, and the halves of ``c`` are ``2 c`` and ``2 c + 1``."""
    lo, hi = 0, _WINDOW - 1
    for bit in bin(cell)[3:]:
        middle = (lo + hi) // 2
        lo, hi = (middle + 1, hi) if bit == "1" else (lo, middle)
    return lo, hi


def _halves(pieces: DataFrame) -> DataFrame:
    """Each piece cut in two by the offsets of its strings; a half's gram is what all strings of its cell have in common."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                for cell in (2 * r.cell, 2 * r.cell + 1):
                    lo, hi = _range(cell)
                    a, z = max(0, r.offset - hi), min(r.strings, r.offset - lo + 1)
                    if lo <= hi and a < z:
                        data, offset = r.data[a : z + LENGTH - 1], r.offset - a
                        gram = xxhash.xxh3_64_intdigest(r.data[r.offset - lo : r.offset - hi + LENGTH])
                        gram -= (gram >> 63) << 64
                        rows.append((cell, gram, xxhash.xxh3_128_digest(data, offset), r.doc, r[4], r.first + a, z - a, offset, r.open, data))
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return pieces.mapInPandas(run, _PIECE)


_SPAN = "doc long, print long, from long, to long"


def _sorted_spans(pieces: DataFrame, buckets: int) -> DataFrame:
    """Spans of open pieces by sorting suffixes, a bounded number of groups in a task."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        out = []
        b = b.sort_values([*_GROUP, "kind"])
        group = ((b["gram"] != b["gram"].shift()) | (b["cell"] != b["cell"].shift())).cumsum().to_numpy()
        ends = np.cumsum(b["data"].str.len().to_numpy())
        at = 0
        while at < len(b):  # whole groups, as many as can be sorted at once
            base = ends[at - 1] if at else 0
            z = int(np.searchsorted(ends, base + SORTED, "right"))
            if z < len(b):
                while z > at and group[z] == group[z - 1]:
                    z -= 1
                if z == at:
                    z = int(np.searchsorted(group, group[at], "right"))
            part = b.iloc[at:z]
            found = repeated(list(zip(part["data"], part["strings"], strict=True)))
            for doc, print_, first, is_open, on in zip(part["doc"], part["print"], part["first"], part["open"], found, strict=True):
                if is_open:
                    out += [(doc, print_, first + a, first + z_) for a, z_ in _runs(on)]
            at = z
        return pd.DataFrame(out, columns=["doc", "print", "from", "to"])

    bucket = F.pmod(F.xxhash64(*_GROUP), F.lit(buckets)).alias("bucket")
    return pieces.select("*", bucket).groupBy("bucket").applyInPandas(run, _SPAN)


def _spans(pieces: DataFrame) -> list[DataFrame]:
    """Tables of spans that together cover the repeated strings of the open ones among ``pieces``, each a different one."""
    size, found = F.sum(F.length("data")), []
    while True:
        sizes = spool(pieces.groupBy(*_GROUP).agg(size.alias("bytes")))
        total, most = sizes.agg(F.sum("bytes"), F.max("bytes")).first()
        if not total:
            return found
        fit = sizes.where(F.col("bytes") <= SORTED).select(*_GROUP)
        found.append(_sorted_spans(pieces.join(fit, _GROUP, "left_semi"), 1 + total // SORTED))
        if most <= SORTED:
            return found
        halves = spool(_halves(pieces.join(fit, _GROUP, "left_anti")))
        kinds = halves.groupBy(*_GROUP, "kind").agg(F.count("*").alias("times"), F.max("open").alias("open"))
        # A half that stands twice is repeated as a whole; one is kept for what differs from it in part.
        twice = kinds.where("times > 1").select(*_GROUP, "kind")
        end = F.col("first") + F.col("strings") + LENGTH - 1
        found.append(halves.where("open").join(twice, [*_GROUP, "kind"], "left_semi").select("doc", "print", F.col("first").alias("from"), end.alias("to")))
        undecided = kinds.groupBy(*_GROUP).agg(F.count("*").alias("n"), F.max(F.col("open") & (F.col("times") == 1)).alias("open"))
        undecided = undecided.where("n > 1 and open").select(*_GROUP)
        one = halves.join(undecided, _GROUP, "left_semi").dropDuplicates([*_GROUP, "kind"])
        one = one.join(twice.withColumn("done", F.lit(True)), [*_GROUP, "kind"], "left")
        pieces = spool(one.withColumn("open", F.col("open") & F.col("done").isNull()).select(*_COLUMNS))


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, print, spans)``: of each text with repeated bytes, known by id and text hash, spans that cover them."""
    texts = _texts(docs, id_col, text_col)
    places = spool(_occurrences(texts))
    blocks = places.groupBy("anchor", "block").agg(
        F.count("*").alias("times"), F.min(F.struct("doc", "print", "place")).alias("at")
    )
    once = F.col("times") == 1
    shared = blocks.groupBy("anchor").agg(F.count("*").alias("kinds"), F.max(once).alias("some_open"))
    known = spool(
        blocks.join(shared, "anchor")
        .where("times > 1 or kinds > 1")
        .select("anchor", "block", "at.*", ((F.col("kinds") > 1) & F.col("some_open")).alias("mixed"), once.alias("open"))
    )
    whole = (
        places.join(known.where("not open").select("anchor", "block"), ["anchor", "block"])
        .select("doc", "print", F.shiftright("place", 20).alias("from"), F.shiftright("place", 10).bitwiseAND(F.lit(1023).cast("long")).alias("n"))
        .select("doc", "print", "from", (F.col("from") + F.col("n") + LENGTH - 1).alias("to"))
    )
    pieces = spool(_block_bytes(texts, known.where("mixed").drop("mixed")))
    for found in _spans(pieces):
        whole = whole.union(found)
    # The spans of a text are of one row each piece at most, so their number follows the text's length.
    return spool(whole.groupBy("doc", "print").agg(F.collect_set(F.struct("from", "to")).alias("spans")))


def _kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def _rest(data: bytes, spans: list[dict] | None) -> tuple[int, int, bytes]:
    """``(bytes removed, runs removed, bytes left)`` of a text."""
    joined = merged([(x["from"], x["to"]) for x in spans or ()])
    return sum(z - a for a, z in joined), len(joined), _kept(data, joined)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text)`` of every row; ``n_bytes`` is what the row came with, ``text`` what
    is left of it, where bytes that no longer form a character are U+FFFD.

    A null text counts as empty. Repeated rows each give a row and are repeated strings of each other. A text shorter
    than a string keeps all its bytes. A null id stays null. An empty table gives no rows.
    """
    found = find_repeats(docs, id_col, text_col)
    joined = _texts(docs, id_col, text_col, F.col(id_col).cast("long").alias("doc_id")).join(found, ["doc", "print"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data, spans in zip(b.column("data").to_pylist(), b.column("spans").to_pylist(), strict=True):
                removed, runs, left = _rest(data, spans)
                rows.append((len(data), removed, runs, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace")))
            columns = zip(*rows, strict=True) if rows else ((),) * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *arrays], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"
    return joined.select("doc_id", "data", "spans").mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes taken out of the text; bytes that no longer form a character become U+FFFD."""
    found = find_repeats(docs, id_col, text_col)
    # The row travels as one column, so no name of it meets a name used here.
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    boxed = _texts(docs.select(row.alias("row"), F.col(id_col).alias("row_id"), F.col(text_col).alias("row_text")), "row_id", "row_text", "row", "row_text")
    joined = boxed.join(found, ["doc", "print"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rest = []
            for text, data, spans in zip(*(b.column(c).to_pylist() for c in ("row_text", "data", "spans")), strict=True):
                rest.append(text if spans is None else _rest(data, spans)[2].decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(rest, pa.string())], ["row", "rest"])

    kept = joined.select("row", "row_text", "data", "spans").mapInArrow(run, T.StructType([joined.schema["row"], T.StructField("rest", T.StringType())]))
    return kept.select(*(F.col("rest").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
