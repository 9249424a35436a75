"""Benchmark decontamination: passages of a corpus within a small edit distance of a benchmark item.

Texts are sequences of words. The CGK embedding walks a window word by word: at step ``j`` it writes the word under its
pointer and moves the pointer on by a random bit that depends on ``j`` and that word alone. Two windows at edit distance
``k`` end up, with good probability, at a Hamming distance of the order of ``k`` squared, because a walk that has come
apart at an edit falls into step again. Hashing some randomly sampled places of the embedding (bit sampling) therefore
makes windows collide that differ by few edits; several walks with several samples each reach the target recall. What
collides is verified by an exact edit distance between the item and the passage around the window.

Windows are of the size of the items: a passage within the edits allowed is at least as long as its item less those
edits, so items are put into classes of window sizes up to that, and windows of that size begin at every word of an item
and of a document. Samples are spread over the whole walk. Some sampled places of each repetition are among the first steps,
which all classes share: a walk is only carried on while the words sampled so far are the beginning of some item's
sample. The result is that of hashing every window in full, but most windows are left after a word or two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import pieces

#: Edits of words that a passage may have, as a share of the item's words.
EDITS = 0.2
#: Repetitions of walk and sample, and sampled places in each: some in the first steps, one of the late ones in those up to
#: ``NEAR``, the others in equal parts of the rest. Of passages with as many edits as allowed over nine in ten are found so.
REPEATS, EARLY, LATE, FIRST, NEAR = 9, 3, 3, 5, 16
#: Window sizes grow by this factor from class to class.
GROWTH = 1.15
#: Items that one pass over the documents looks for; a larger benchmark takes several passes.
ITEMS_A_PASS = 10_000
#: Bytes of rows that a task takes through several passes together, so that a pass's tables are built once for so many.
HELD = 64_000_000
#: Bits of a lookup table for each key in it, so that few windows go on by chance.
_BITS = 64
_EDGE = np.array([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Words:
    """Cuts texts into hashed words: runs of letters and digits of any script, lower-cased in A-Z."""

    def __init__(self) -> None:
        self.inside = np.zeros(256, bool)
        self.inside[_EDGE] = True
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[0x41:0x5B] += 32
        self.powers = np.ones(1, np.uint64)

    def hashes(self, data: bytes) -> np.ndarray:
        """The 64-bit hash of each word of ``data`` in order; equal words have equal hashes."""
        raw = np.frombuffer(data, np.uint8)
        if not len(raw):
            return np.zeros(0, np.uint64)
        inside = self.inside[raw]
        step = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        if not len(start):
            return np.zeros(0, np.uint64)
        # A word's hash is a polynomial in its bytes, summed from the word's start.
        last = np.zeros(len(raw), np.int64)
        last[start] = start
        place = np.arange(len(raw)) - np.maximum.accumulate(last)
        most = int(place.max()) + 1
        if most > len(self.powers):
            with np.errstate(over="ignore"):
                self.powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(2 * most, _BASE, np.uint64))))
        with np.errstate(over="ignore"):
            value = (self.lower[raw].astype(np.uint64) + np.uint64(1)) * self.powers[place]
            value[~inside] = 0
            sums = np.add.reduceat(value, start)
            return _mixed(sums * _MIX + (end - start).astype(np.uint64))


class Table:
    """A set of keys with false hits, as bits."""

    def __init__(self, keys: np.ndarray):
        self.mask = np.uint64((1 << int(max(8, len(keys) * _BITS)).bit_length()) - 1)
        at = (keys & self.mask).astype(np.int64)
        self.bits = np.zeros(int(self.mask) // 8 + 1, np.uint8)
        np.bitwise_or.at(self.bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))

    def on(self, keys: np.ndarray) -> np.ndarray:
        at = (keys & self.mask).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1) > 0


def _salt(r: int, step: int) -> np.uint64:
    return _mixed(np.array([(r << 32) + step + 1], np.uint64))[0] | np.uint64(1)


def _joined(key: np.ndarray, word: np.ndarray, step: int) -> np.ndarray:
    return _mixed((key ^ word) * _MIX + np.uint64(step + 1))


def early_places(r: int) -> list[int]:
    """The sampled places of a repetition in the first steps, which all window sizes share."""
    return sorted(np.random.default_rng([7, r]).choice(FIRST, EARLY, replace=False).tolist())


def late_places(r: int, reach: int) -> list[int]:
    """The other sampled places of windows of ``reach`` words, whose walks have twice as many steps."""
    rng, steps = np.random.default_rng([7, r, reach]), 2 * reach
    near = min(NEAR, steps)
    edges = [FIRST, near, *np.linspace(near, steps, LATE).astype(int)[1:].tolist()]
    return sorted({int(rng.integers(a, z)) for a, z in zip(edges[:-1], edges[1:], strict=True) if z > a})


def start_walks(flat: np.ndarray, begin: np.ndarray, r: int, tables: list[Table] | None = None):
    """``(begin, pointer, keys)`` of windows after the first steps of a repetition, with the keys after each early place.

    With ``tables`` of those keys, only the windows that go on, and their last key.
    """
    at, key, keys, places = begin, np.zeros(len(begin), np.uint64), [], early_places(r)
    with np.errstate(over="ignore"):
        for j in range(FIRST):
            word = flat[at]
            if j in places:
                key = _joined(key, word, j)
                keys.append(key)
                if tables is not None:
                    on = tables[places.index(j)].on(key)
                    begin, at, key, word = begin[on], at[on], key[on], word[on]
            at = at + ((word * _salt(r, j)) >> np.uint64(63)).astype(np.int64)
    return begin, at, keys if tables is None else key


def walk_on(flat: np.ndarray, begin: np.ndarray, at: np.ndarray, key: np.ndarray, r: int, reach: int, tables: list[Table] | None = None):
    """``(begin, keys)``: the keys after each later place, or with ``tables`` only the last one's of the windows that go on.

    A walk that has come to its window's end reads the same nothing from there on.
    """
    keys, places = [], late_places(r, reach)
    with np.errstate(over="ignore"):
        for j in range(FIRST, (places or [0])[-1] + 1):
            if not len(begin):
                break
            inside = at < begin + reach
            word = np.where(inside, flat[np.minimum(at, len(flat) - 1)], np.uint64(0))
            if j in places:
                key = _joined(key, word, j)
                if tables is None:
                    keys.append(key)
                else:
                    on = tables[places.index(j)].on(key)
                    begin, at, key, word = begin[on], at[on], key[on], word[on]
            at = at + ((word * _salt(r, j)) >> np.uint64(63)).astype(np.int64)
    return begin, keys if tables is None else key


def _matches(keys: np.ndarray, order: np.ndarray, windows: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows and the item windows whose key is theirs; ``keys`` are sorted, ``order`` is where they were."""
    low = np.searchsorted(keys, key, "left")
    n = np.searchsorted(keys, key, "right") - low
    return np.repeat(windows, n), order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]


class Items:
    """Benchmark items with windows of ``reach`` words, and the tables in which a document's windows are looked up."""

    def __init__(self, numbers: np.ndarray, words: list[np.ndarray], reach: int):
        self.reach = reach
        sizes = np.array([len(w) for w in words])
        flat = np.concatenate(words)
        lead = np.concatenate([np.arange(n) for n in sizes])
        fits = lead + reach <= np.repeat(sizes, sizes)
        begin, self.lead, self.owner = np.flatnonzero(fits), lead[fits], np.repeat(numbers, sizes)[fits]
        self.early, self.tables, self.keys = [], [], []
        for r in range(REPEATS):
            _, at, early = start_walks(flat, begin, r)
            late = walk_on(flat, begin, at, early[-1], r, reach)[1]
            last = late[-1] if late else early[-1]
            order = np.argsort(last, kind="stable")
            self.early.append(early)
            self.tables.append([Table(early[-1]), *(Table(k) for k in late)])
            self.keys.append((last[order], order))

    def collisions(self, flat: np.ndarray, end: np.ndarray, r: int, begin: np.ndarray, at: np.ndarray, key: np.ndarray) -> set:
        """``(window's first word, item, words of the item before the window)`` of windows that collide in repetition r."""
        on = (begin + self.reach <= end[begin]) & self.tables[r][0].on(key)
        begin, key = walk_on(flat, begin[on], at[on], key[on], r, self.reach, self.tables[r][1:])
        windows, hit = _matches(*self.keys[r], begin, key)
        return set(zip(windows.tolist(), self.owner[hit].tolist(), self.lead[hit].tolist(), strict=True))


class ShortItems:
    """Items so short that no edit is allowed: their words have to stand as they are."""

    def __init__(self, numbers: np.ndarray, words: list[np.ndarray], size: int):
        self.size, self.owner = size, numbers
        keys = self._keys(np.concatenate(words), np.arange(len(words)) * size)
        order = np.argsort(keys, kind="stable")
        self.table, self.keys = Table(keys), (keys[order], order)

    def _keys(self, flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
        key = np.zeros(len(begin), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(self.size):
                key = _joined(key, flat[begin + i], i)
        return key

    def collisions(self, flat: np.ndarray, end: np.ndarray) -> set:
        begin = np.flatnonzero(np.arange(len(flat)) + self.size <= end)
        key = self._keys(flat, begin)
        on = self.table.on(key)
        windows, hit = _matches(*self.keys, begin[on], key[on])
        return {(w, k, 0) for w, k in zip(windows.tolist(), self.owner[hit].tolist(), strict=True)}


def window_size(words: int) -> int:
    """The window size of items of so many words: of the classes the largest that no passage allowed falls short of, 5 at least."""
    least, size = words - int(EDITS * words), float(FIRST)
    while int(size * GROWTH + 1) <= least:
        size = int(size * GROWTH + 1)
    return int(size)


def passage_distance(item: list, words: list) -> tuple[int, int]:
    """The least edit distance between ``item`` and any run of ``words``, and where that run ends.

    Bit-parallel dynamic programming over the whole item, one step for each of ``words``.
    """
    n = len(item)
    where: dict = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, now, best, at = full, 0, n, n, 0
    for j, w in enumerate(words):
        eq = where.get(w, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (~(x | up) & full), up & x
        if plus & top:
            now += 1
        elif minus & top:
            now -= 1
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (~((eq | down) | plus) & full), plus & (eq | down)
        if now < best:
            best, at = now, j + 1
    return best, at


class Finder:
    """Finds the items of one pass in batches of texts."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.ids = [k for k, _ in items]
        self.words = [w.tolist() for _, w in items]
        self.cutter = Words()
        size = np.array([len(w) for w in self.words])
        short = int(1 / EDITS)  # below this many words no edit is allowed
        sizes = np.array([window_size(n) if n >= short else -n for n in size])
        part = lambda n: (np.flatnonzero(sizes == n), [items[i][1] for i in np.flatnonzero(sizes == n)], abs(int(n)))
        self.short = [ShortItems(*part(n)) for n in np.unique(sizes) if n < 0]
        self.groups = [Items(*part(n)) for n in np.unique(sizes) if n > 0]
        self.early = [[Table(np.concatenate(k)) for k in zip(*(g.early[r] for g in self.groups), strict=True)] for r in range(REPEATS if self.groups else 0)]

    def _collisions(self, flat: np.ndarray, end: np.ndarray) -> list[set]:
        """For each class of items what collides, over all repetitions."""
        found = [g.collisions(flat, end) for g in self.short] + [set() for _ in self.groups]
        every = np.flatnonzero(np.arange(len(flat)) + FIRST <= end)
        for r in range(REPEATS if self.groups else 0):
            begin, at, key = start_walks(flat, every, r, self.early[r])
            for n, g in enumerate(self.groups, len(self.short)):
                found[n] |= g.collisions(flat, end, r, begin, at, key)
        return found

    def __call__(self, texts: list[str | None]) -> dict[tuple[int, int], tuple[int, int]]:
        """``(row, item): (least edits, the passage's last word)`` of all that is found in ``texts``."""
        found: dict[tuple[int, int], tuple[int, int]] = {}
        data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        for s in pieces([len(d) for d in data], 4_000_000):
            cut = [self.cutter.hashes(d) for d in data[s]]
            ends = np.cumsum([len(c) for c in cut])
            flat = np.concatenate(cut)
            if not len(flat):
                continue
            end = np.repeat(ends, np.diff(ends, prepend=0))
            for collisions in self._collisions(flat, end):
                tried: set[tuple[int, int]] = set()
                for start, k, lead in sorted(collisions):
                    item = self.words[k]
                    most = int(EDITS * len(item))
                    row = int(np.searchsorted(ends, start, "right"))
                    first = int(ends[row - 1]) if row else 0
                    low = max(first, start - lead - most)
                    if (low, k) in tried:
                        continue
                    tried.add((low, k))
                    high = min(int(ends[row]), low + len(item) + 3 * most + 1)
                    edits, stop = passage_distance(item, flat[low:high].tolist())
                    if edits <= most:
                        at = (s.start + row, k)
                        found[at] = min(found.get(at, (edits, low + stop - 1 - first)), (edits, low + stop - 1 - first))
        return found


SCHEMA = "doc_id long, item_id long, edits long, last_word long, item_words long"


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    held: int = HELD,
) -> DataFrame:
    """``(doc_id, item_id, edits, last_word, item_words)``: a row for each document and item that it holds a passage of.

    ``edits`` is the least number of words to insert, remove or replace between the item and a passage found, at most a
    fifth of ``item_words``; ``last_word`` is where that passage ends (words from 0). Items without words and null items
    are found nowhere; a null or empty text holds nothing. Repeated rows each give rows. Null ids stay null. The documents
    are read once, and about ``held`` bytes of rows go through the passes of items together, as in :func:`drop_leaks`.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    passes = list(_passes(benchmark, item_col, item_text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = Finder(passes[0]) if len(passes) == 1 else None
        for held_rows in _runs(batches, 0 if only else held):
            for items in passes:
                finder = only or Finder(items)
                for b in held_rows:
                    found = sorted(finder(b.column("text").to_pylist()).items())
                    yield pa.record_batch(
                        {
                            "doc_id": b.column("doc_id").take(pa.array([r for (r, _), _ in found], pa.int64())),
                            "item_id": pa.array([finder.ids[k] for (_, k), _ in found], pa.int64()),
                            "edits": pa.array([e for _, (e, _) in found], pa.int64()),
                            "last_word": pa.array([w for _, (_, w) in found], pa.int64()),
                            "item_words": pa.array([len(finder.words[k]) for (_, k), _ in found], pa.int64()),
                        }
                    )

    return texts.mapInArrow(run, SCHEMA)


def _passes(benchmark: DataFrame, item_col: str, item_text_col: str) -> Iterator[list]:
    """Runs of up to ``ITEMS_A_PASS`` items or so with their words, dealt by a hash."""
    cutter = Words()
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("item"))
    items = items.where("item is not null").distinct()
    passes = max(1, -(-items.count() // ITEMS_A_PASS))
    for i in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(passes)) == i).collect()
        pairs = [(r["item_id"], cutter.hashes(r["item"].encode("utf-8", "surrogatepass"))) for r in part]
        pairs = sorted(((k, w) for k, w in pairs if len(w)), key=lambda x: (x[0] is None, x[0] or 0, x[1].tolist()))
        if pairs:
            yield pairs


def _runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of ``size`` bytes or little more."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.nbytes
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def drop_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    held: int = HELD,
) -> DataFrame:
    """The rows of ``docs`` that hold no passage of a benchmark item, judged where they are read, without a shuffle.

    A row with a null or empty text stays, and so do repeated rows, each for itself; null ids don't matter. Without items all
    rows stay; an empty table stays empty. Other columns, whatever their names, travel along.

    The documents are read once, by one worker a task, however many passes the items take: it holds about ``held`` bytes of rows
    and takes them through the passes one by one, with the tables of one pass at a time. What grows with the benchmark is
    the list of its hashed words, 8 bytes each, in every worker.
    """
    passes = list(_passes(benchmark, item_col, item_text_col))
    if not passes:
        return docs

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = Finder(passes[0]) if len(passes) == 1 else None
        for run in _runs(batches, 0 if only else held):
            stays = [np.ones(b.num_rows, bool) for b in run]
            for items in passes:
                finder = only or Finder(items)
                for b, stay in zip(run, stays, strict=True):
                    rows = np.flatnonzero(stay)
                    hit = {r for r, _ in finder(b.column(text_col).take(pa.array(rows)).to_pylist())}
                    stay[rows[sorted(hit)]] = False
            for b, stay in zip(run, stays, strict=True):
                yield b.filter(pa.array(stay))

    return docs.mapInArrow(clean, docs.schema)
