"""Near-duplicate vectors by a subspace pigeonhole join.

For unit vectors a cosine of at least ``c`` is a squared distance of at most ``2 - 2c``. Vectors are rotated at random and
cut into blocks of dimensions; the squared distance is the sum of the blocks' distances, so a near pair is within its
proportional share of that budget in one block at least. Each block is a range join: where two chunks of vectors meet, both
are put in order of the block's first coordinate, and those that are within the block's reach on it are held against the
block's budget. A pair is verified in the first block that lets it through, so the union over blocks holds each pair once.

Vectors travel rotated and in single precision, each rotated once, so every block judges the same numbers. A cosine that
is farther from the threshold than the rounding of single precision is decided by that; the few pairs in doubt are joined
with their vectors and decided in double precision.

Each different vector is shuffled once and written once, into a chunk of bounded size. Any two chunks meet in the task that
reads both from where they were written, so what is shuffled and written grows with the table, though the pairs grow with
its square. A task returns how many links it found for each vector and a spanning forest of them, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spool
from .components import connected_components

COSINE = 0.9
BLOCKS = 4
#: How far from the threshold single precision may be off (twice the bound of 64 roundings), and from a block's budget.
DOUBT, SLACK = 2e-5, 2e-5
#: Vectors in a chunk, at most, chunks in a file, about, and files that there are at least where vectors are enough for it.
CHUNK, ROUND, FEW_FILES = 1024, 16, 12
#: Vectors in a row in order of a coordinate that are held at once against those within reach of them.
RUN = 256
#: Edges that a task holds before it takes a spanning forest of them.
EDGES = 1 << 17
#: Bits by which vectors that no pair in doubt needs are left where they are read: of a size that doesn't follow the table.
SLOTS = 1 << 22


def rotation(size: int, seed: int = 0) -> np.ndarray:
    """A random rotation, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def _unit(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and which rows are vectors that can link."""
    size = max((len(r) for r in rows if r is not None), default=0)
    x = np.zeros((len(rows), size))
    good = np.zeros(len(rows), bool)
    for i, r in enumerate(rows):
        if r is not None and len(r) == size and size:
            v = np.array([np.nan if a is None else a for a in r], float) if r.dtype == object else np.asarray(r, float)
            if np.isfinite(v).all() and (m := np.abs(v).max()) > 0:
                v = v / m  # else squares of tiny or huge components leave the range
                x[i] = v / np.sqrt((v * v).sum())
                good[i] = True
    return x, good


def _bounds(size: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, size, min(BLOCKS, size) + 1).astype(int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def _name(unit: np.ndarray) -> int:
    """A signed 64-bit name of a unit vector."""
    x = xxhash.xxh3_64_intdigest(np.ascontiguousarray(unit).tobytes())
    return x - (1 << 64) if x >> 63 else x


def _linked(a: np.ndarray, b: np.ndarray, block: int, same: bool, cosine: float):
    """``(rows of a, rows of b, sure)`` of the pairs that are found in this block and in none before it.

    ``sure`` pairs are links; the others are too near the threshold for single precision to tell.
    """
    size = a.shape[1]
    bounds = _bounds(size)
    reach = [(2 - 2 * cosine) * (hi - lo) / size + SLACK for lo, hi in bounds]
    distance = lambda x, y, k: ((x[:, slice(*bounds[k])] - y[:, slice(*bounds[k])]) ** 2).sum(1)
    lo, hi = bounds[block]
    of_a, of_b = np.argsort(a[:, lo], kind="stable"), np.argsort(b[:, lo], kind="stable")
    p, q = a[of_a, lo:hi], b[of_b, lo:hi]
    pp, qq = 0.5 * ((p * p).sum(1) - reach[block]) - SLACK, 0.5 * (q * q).sum(1)
    wide, found = reach[block] ** 0.5 + 1e-5, []
    for at in range(0, len(p), RUN):
        run = slice(at, at + RUN)
        first, last = np.searchsorted(q[:, 0], (float(p[run][0, 0]) - wide, float(p[run][-1, 0]) + wide))
        if first < last:
            met = slice(first, last)
            i, j = np.divmod(np.flatnonzero(p[run] @ q[met].T >= pp[run, None] + qq[met]), last - first)
            found.append((of_a[i + at], of_b[j + first]))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (of_a[:0], of_b[:0])
    if same:
        i, j = i[i < j], j[i < j]
    cos = (a[i] * b[j]).sum(1)
    i, j, cos = (x[cos >= cosine - DOUBT] for x in (i, j, cos))
    for k in range(block + 1):
        near = distance(a[i], b[j], k) <= reach[k]
        i, j, cos = (x[near if k == block else ~near] for x in (i, j, cos))  # else counted in the earlier block
    return i, j, cos >= cosine + DOUBT


def _forest(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Edges that connect what the given edges connect, fewer than there are vertices."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int | None = None, cosine: float = COSINE
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row: rows are linked at a cosine of ``cosine`` or more.

    ``size`` is the vectors' number of components, by default that of most vectors (of several such the largest). Vectors that are null, of
    another size, zero, or hold a null or non-finite component link with nothing. Rows with the same id are one vector if
    they are equal, and else each a vector of its own whose links count together. A row with a null id links with nothing
    and has a null component. An empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    if size is None:
        sizes = rows.where("v is not null and size(v) > 0").groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"))
        size = sizes.agg(F.max(F.struct("rows", "n"))["n"]).first()[0] or 0
    ids = rows.select("id")
    if not size:
        return ids.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))

    def units(b: pd.DataFrame) -> tuple[pd.Series, np.ndarray, list[int]]:
        x, good = _unit([None if r is None or len(r) != size else r for r in b["v"]])
        return b["id"][good], x[good], [_name(u) for u in x[good]]

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, _, names = units(b)
            if not names:
                continue
            yield pd.DataFrame({"id": ids.to_numpy(), "name": names})

    # Equal vectors are one class: its members link with each other and have the same links otherwise.
    rows = rows.where("id is not null")
    named = spool(rows.mapInPandas(name, "id long, name long").distinct())
    classes = spool(named.groupBy("name").agg(F.min("id").alias("least"), F.count("*").alias("members")))
    n = classes.count()
    files = max(-(-n // (CHUNK * ROUND)), min(FEW_FILES, -(-n // CHUNK)), 1)

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = rotation(size)
        for b in batches:
            ids, x, names = units(b)
            if not names:
                continue
            yield pd.DataFrame({"id": ids.to_numpy(), "name": names, "unit": [r.tobytes() for r in (x @ by).astype(np.float32)]})

    # A class's vector is that of its least row, so a vector that very many rows have is still dealt out by their ids.
    turned = rows.mapInPandas(turn, "id long, name long, unit binary").repartition(files, "id", "name").groupBy("id", "name").agg(F.first("unit").alias("unit"))
    least = classes.select(F.col("least").alias("id"), "name", "members").repartition(files, "id", "name")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("chunk", pa.int64()), ("names", pa.binary()), ("members", pa.binary()), ("units", pa.binary())])
        number, held = TaskContext.get().partitionId() << 32, pa.table({"name": pa.array([], pa.int64()), "members": pa.array([], pa.int64()), "unit": pa.array([], pa.binary())})

        def packed(t: pa.Table) -> pa.RecordBatch:
            columns = [t.column(c).to_numpy().astype(np.int64).tobytes() for c in ("name", "members")] + [b"".join(t.column("unit").to_pylist())]
            return pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([c], pa.binary()) for c in columns)], schema=schema)

        for b in batches:
            held = pa.concat_tables([held, pa.table({c: b.column(c) for c in held.column_names})])
            while held.num_rows >= CHUNK:
                yield packed(held.slice(0, CHUNK))
                number, held = number + 1, held.slice(CHUNK)
        if held.num_rows:
            yield packed(held)

    placed = turned.join(least.hint("merge"), ["id", "name"]).select("name", "members", "unit")
    chunks = spool(placed.mapInArrow(pack, "chunk long, names binary, members binary, units binary"))

    # Of two chunks the one or the other comes first, by turns, so that tasks have about the same to do.
    a, b = (chunks.select(*(F.col(c).alias(f"{c}_{x}") for c in chunks.columns)) for x in "ab")
    first = F.col("chunk_a") < F.col("chunk_b")
    turns = F.col("chunk_a").bitwiseXOR(F.shiftright("chunk_a", 32)).bitwiseXOR(F.col("chunk_b")).bitwiseXOR(F.shiftright("chunk_b", 32)) % 2 == 0
    pairs = a.join(b.hint("shuffle_replicate_nl"), (F.col("chunk_a") == F.col("chunk_b")) | ((F.col("chunk_a") != F.col("chunk_b")) & (turns == first)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(what: str, u: np.ndarray, v: np.ndarray | None, n: np.ndarray | None) -> pa.RecordBatch:
            v = pa.nulls(len(u), pa.int64()) if v is None else pa.array(v)
            n = pa.array(np.zeros(len(u), np.int64) if n is None else n)
            return pa.RecordBatch.from_arrays([pa.array(u), v, n, pa.array([what] * len(u), pa.string())], ["u", "v", "n", "what"])

        forest = np.zeros((0, 2), np.int64)  # of all that the task has met
        for batch in batches:  # chunks are read where they lie in the batch
            part = lambda c, i: np.frombuffer(batch.column(c)[i].as_buffer(), np.float32 if c[0] == "u" else np.int64)  # noqa: B023, E731
            for row, (one, other) in enumerate(zip(batch.column("chunk_a").to_pylist(), batch.column("chunk_b").to_pylist(), strict=True)):
                x, y = part("units_a", row).reshape(-1, size), part("units_b", row).reshape(-1, size)
                found = [_linked(x, y, k, one == other, cosine) for k in range(len(_bounds(size)))]
                i, j, sure = (np.concatenate(c) for c in zip(*found, strict=True))
                if not len(i):
                    continue
                ca, cb, ma, mb = (part(c, row) for c in ("names_a", "names_b", "members_a", "members_b"))
                if not sure.all():
                    yield told("doubt", ca[i[~sure]], cb[j[~sure]], None)
                i, j = i[sure], j[sure]
                na, nb = np.bincount(i, mb[j], len(ca)).astype(np.int64), np.bincount(j, ma[i], len(cb)).astype(np.int64)
                yield told("count", np.concatenate([ca[na > 0], cb[nb > 0]]), None, np.concatenate([na[na > 0], nb[nb > 0]]))
                forest = np.concatenate([forest, _forest(ca[i], cb[j])])
                if len(forest) > EDGES:
                    forest = _forest(*forest.T)
        forest = _forest(*forest.T)
        yield told("edge", forest[:, 0], forest[:, 1], None)

    # A task's counts of a vector are summed up before they are shuffled.
    met = spool(pairs.mapInArrow(meet, "u long, v long, n long, what string").groupBy("what", "u", "v").agg(F.sum("n").alias("n")))
    told = _told(met.where("what = 'doubt'").select("u", "v"), rows, units, cosine)
    members = classes.select(F.col("name").alias("of"), "members")
    counts = met.where("what = 'count'").select("u", "n")
    for one, other in (("u", "v"), ("v", "u")):
        counts = counts.union(told.join(members, F.col(other) == F.col("of")).select(one, "members"))
    links = counts.groupBy(F.col("u").alias("linked")).agg(F.sum("n").alias("outer_links"))
    linked = connected_components(met.where("what = 'edge'").select("u", "v").union(told))
    of_class = spool(
        classes.join(links, F.col("name") == F.col("linked"), "left")
        .join(linked, F.col("name") == F.col("node"), "left")
        .select("name", "least", (F.col("members") - 1 + F.coalesce("outer_links", F.lit(0))).alias("n"), F.coalesce("component", "name").alias("root"))
    )
    roots = of_class.groupBy("root").agg(F.min("least").alias("c"))
    of_class = of_class.join(roots.hint("merge"), "root").select("name", "n", "c")
    found = named.join(of_class.hint("merge"), "name").groupBy(F.col("id").alias("found_id")).agg(F.sum("n").alias("n"), F.min("c").alias("c"))
    out = ids.join(found.hint("merge"), F.col("id") == F.col("found_id"), "left")
    component = F.coalesce("c", "id")
    return out.select(
        F.col("id").alias("vec_id"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _told(doubt: DataFrame, rows: DataFrame, units: Callable[[pd.DataFrame], tuple[pd.Series, np.ndarray, list[int]]], cosine: float) -> DataFrame:
    """Those of the pairs ``doubt`` ``(u, v)`` of names that are linked in double precision, by the vectors of ``rows``."""
    wanted = spool(doubt.select(F.explode(F.array("u", "v")).alias("wanted")).distinct())
    slots = wanted.select(F.pmod("wanted", F.lit(SLOTS)).cast("int").alias("slot")).distinct().toArrow()
    if not slots.num_rows:
        return doubt
    bits = np.zeros(SLOTS, bool)
    bits[slots.column(0).to_numpy()] = True
    packed = np.packbits(bits)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.unpackbits(packed).astype(bool)
        for b in batches:
            _, x, names = units(b)
            if not names:
                continue
            keep = np.flatnonzero(bits[np.array(names, np.int64) % SLOTS])
            yield pd.DataFrame({"name": [names[i] for i in keep], "unit": [x[i].tobytes() for i in keep]}).drop_duplicates("name")

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            on = [float(np.frombuffer(x) @ np.frombuffer(y)) >= cosine for x, y in zip(b["a"], b["b"], strict=True)]
            yield b.loc[on, ["u", "v"]]

    held = rows.mapInPandas(read, "name long, unit binary")
    held = spool(held.join(wanted, F.col("name") == F.col("wanted"), "left_semi").groupBy("name").agg(F.first("unit").alias("unit")))
    of = lambda c, x: held.select(F.col("name").alias(c), F.col("unit").alias(x))
    pairs = doubt.join(of("u", "a"), "u").join(of("v", "b"), "v").select("u", "v", "a", "b")
    return spool(pairs.mapInPandas(exact, "u long, v long"))
