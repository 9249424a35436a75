"""How far the sources of a language differ in their terms, by factorizing texts into chunks.

A text is a sequence of chunks between white space, and terms never cross white space, so a text's terms follow from its
chunks. Documents are read in blocks: a block's chunks are numbered, and which document holds which chunk how often is
packed into arrays. Each distinct chunk of the corpus is then cut into terms once. The documents of all chunks with a term
bound those of the term, so terms below the bound go, without loss; the others are joined back to the blocks that hold
their chunks: a chunk meets the join once for each block, not for each document. A block's arrays turn terms of chunks into
documents and occurrences by source; what is left are sums.

All shares are whole numbers (parts of 10^9, rounded down), computed in decimals where longs could overflow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import pieces
from .common import spool

#: Characters of text that end a block; a longer text is a block by itself.
BLOCK = 16_000_000
#: Documents of a language that a kept term is in, at least.
LEAST = 30
#: Parts of one, and what each count is raised by.
PARTS, RAISE = 1_000_000_000, 5
#: Ranks of the terms that a source uses more than its language.
TOP = 50
#: Kept terms of a language that one task holds of all its sources.
BUCKET = 1_000
#: Bits by which chunks that no join needs are left in their blocks: of a size that doesn't follow the corpus.
SLOTS = 1 << 24
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

_BLOCKS = "block long, chunks array<string>, holders array<int>, pairs binary, times binary, kinds binary, langs array<string>, sources array<string>"


def _pack(numbers: np.ndarray) -> bytes:
    """32-bit numbers, bytes of one weight next to each other, compressed."""
    return zstandard.ZstdCompressor(1).compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<u4")[:, 0].astype(np.int64)


def _block(number: int, texts: pa.Array, langs: pa.Array, sources: pa.Array, schema: pa.Schema) -> pa.RecordBatch:
    """One block: its distinct chunks, and for each how many documents hold it; the numbers ``chunk * documents + document``
    in order, as differences, and how often that chunk is in that document; each document's kind, a language and a source."""
    parts = pc.ascii_split_whitespace(texts)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(parts.offsets.to_numpy()))
    flat = parts.flatten().dictionary_encode()
    both = flat.indices.to_numpy(zero_copy_only=False) * np.int64(len(texts)) + doc
    del parts, doc
    both, times = np.unique(both, return_counts=True)
    holders = np.bincount(both // len(texts), minlength=len(flat.dictionary)).astype(np.int32)
    kinds, which = {}, []
    for p in zip(langs.to_pylist(), sources.to_pylist(), strict=True):
        which.append(kinds.setdefault(p, len(kinds)))
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    columns = [pa.array([number], pa.int64()), one(flat.dictionary), one(pa.array(holders))]
    columns += [pa.array([_pack(x)], pa.binary()) for x in (np.diff(both, prepend=0), times, np.array(which))]
    columns += [one(pa.array([k[i] for k in kinds], pa.string())) for i in (0, 1)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _blocks(read: DataFrame, size: int) -> DataFrame:
    """The blocks of ``read`` ``(text, lang, source)``, numbered by partition and place in it."""
    names = pa.list_(pa.string())
    schema = pa.schema(
        [("block", pa.int64()), ("chunks", names), ("holders", pa.list_(pa.int32())), *((c, pa.binary()) for c in ("pairs", "times", "kinds")), ("langs", names), ("sources", names)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, chars = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> pa.RecordBatch:
            text, lang, source = (pa.concat_arrays([b.column(c) for b in held]) for c in ("text", "lang", "source"))
            return _block(number, text, lang, source, schema)

        for b in batches:
            lengths = pc.binary_length(b.column("text")).to_pylist()
            for part in pieces(lengths, size):
                held.append(b.slice(part.start, part.stop - part.start))
                chars += sum(lengths[part])
                if chars >= size:
                    yield flush()
                    number, held, chars = number + 1, [], 0
        if held:
            yield flush()

    return read.mapInArrow(run, _BLOCKS)


def terms(chunk: Column) -> Column:
    """A chunk's terms, in order and with repeats: runs of letters and of characters beyond ASCII, A to Z lower-cased."""
    return F.regexp_extract_all(F.translate(chunk, UPPER, LOWER), F.lit(TERM), F.lit(0))


def _count(key: tuple, found: pa.Table, blocks: pa.Table) -> pa.Table:
    """A block's ``(lang, source, term, docs, times)`` from ``(at, term)``, terms of its chunks."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("times", pa.int64())])
    if not found.num_rows or not blocks.num_rows:
        return schema.empty_table()
    pairs, times, kinds = (_unpack(blocks.column(c)[0].as_py()) for c in ("pairs", "times", "kinds"))
    langs, sources = (blocks.column(c)[0].values for c in ("langs", "sources"))
    n = len(kinds)
    chunk, doc = np.divmod(np.cumsum(pairs), n)
    at = found.column("at").to_numpy().astype(np.int64)
    flat = pa.concat_arrays(found.column("term").chunks).dictionary_encode()
    term = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # Each (chunk, term) is spread over the documents of the chunk.
    first = np.searchsorted(chunk, at)
    many = np.searchsorted(chunk, at, "right") - first
    where = np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many)
    both, times = _summed(np.repeat(term, many) * n + doc[where], times[where])
    term, doc = np.divmod(both, n)
    group = term * len(langs) + kinds[doc]
    _, docs = _summed(group, np.ones(len(group), np.int64))
    group, times = _summed(group, times)
    term, kind = np.divmod(group, len(langs))
    columns = [langs.take(pa.array(kind)), sources.take(pa.array(kind)), flat.dictionary.take(pa.array(term)), pa.array(docs), pa.array(times)]
    return pa.table(columns, schema=schema)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, in order, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(values[order], first)


def _held(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(block, at, chunk)`` of all chunks in ``wanted``, and of few others."""
    slot = F.xxhash64("chunk").bitwiseAND(F.lit(SLOTS - 1))
    bits = wanted.select(F.floor(slot / 64).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    got, words = bits.toArrow(), np.zeros(SLOTS // 64, np.int64)
    words[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    packed = zstandard.compress(words.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(zstandard.decompress(packed), np.uint8), bitorder="little")
        for b in batches:
            for block, chunks in zip(b.column("block").to_pylist(), b.column("chunks"), strict=True):
                chunks = chunks.values
                slots = np.fromiter((xxhash.xxh64_intdigest(x, 42) & SLOTS - 1 for x in chunks.cast(pa.binary()).to_pylist()), np.int64, len(chunks))
                at = np.flatnonzero(bits[slots])
                for i in range(0, len(at), 1 << 16):
                    part = at[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(part.astype(np.int32)), chunks.take(pa.array(part))], ["block", "at", "chunk"])

    return blocks.select("block", "chunks").mapInArrow(run, "block long, at int, chunk string")


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """``(lang, source, term, docs, times)``: in how many documents of a language and source a term is, and how often.

    All terms that at least ``least`` documents of a language hold are there; others may be. Null texts, languages and
    sources are empty strings. Every row counts as a document, repeated or not.
    """
    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    blocks = spool(_blocks(read, block))
    each = blocks.select(F.explode(F.arrays_zip("chunks", "holders")).alias("x")).select(F.col("x.chunks").alias("chunk"), F.col("x.holders").alias("docs"))
    cut = spool(each.groupBy("chunk").agg(F.sum("docs").alias("docs")).withColumn("terms", terms(F.col("chunk"))).where(F.size("terms") > 0))
    most = cut.select(F.explode(F.array_distinct("terms")).alias("term"), "docs").groupBy("term").agg(F.sum("docs").alias("most"))
    # Terms compress well: a table of them whose files are small enough to broadcast takes many times that in the driver.
    known = spool(cut.select("chunk", F.explode("terms").alias("term")).join(spool(most.where(F.col("most") >= least).select("term")).hint("merge"), "term", "left_semi"))
    back = _held(blocks, known).join(known.hint("merge"), "chunk").select("block", "at", "term")
    arrays = blocks.drop("chunks", "holders").withColumnRenamed("block", "of")
    found = back.groupBy("block").cogroup(arrays.groupBy("of")).applyInArrow(_count, "lang string, source string, term string, docs long, times long")
    # By language and term: a term's sources stay side by side, where they compress, and what asks for a term's sums finds them.
    return found.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("times").alias("times"))


def _share(count: Column, total: Column, kept: Column) -> Column:
    """Parts of ``PARTS``, from 1: ``1 + floor(PARTS * (count + RAISE) / (total + RAISE * kept))``; null if nothing is kept."""
    top = (count + RAISE).cast("decimal(26,0)") * F.lit(PARTS).cast("decimal(11,0)")
    return F.when(kept > 0, 1 + F.call_function("div", top, (total + RAISE * kept).cast("decimal(38,0)")))


def _distances(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums of differences between all sources of a language over one bucket's terms."""
    pdf = pdf.sort_values("source", ignore_index=True)
    sizes = np.array([len(x) for x in pdf["terms"]])
    code, names = pd.factorize(np.concatenate([np.asarray(x, object) for x in pdf["terms"]]) if sizes.sum() else np.zeros(0, object))
    p = np.repeat(pdf["least"].to_numpy(np.int64)[:, None], len(names), 1)
    p[np.repeat(np.arange(len(pdf)), sizes), code] = np.concatenate([np.asarray(x, np.int64) for x in pdf["shares"]]) if sizes.sum() else []
    name, out = pdf["source"].to_numpy(object), []
    for i in range(len(pdf)):
        away = np.abs(p - p[i]).sum(1)
        out.append(pd.DataFrame({"lang": key[0], "source": name[i], "item": np.delete(name, i), "value": np.delete(away, i)}))
    return pd.concat(out) if out else pd.DataFrame({"lang": [], "source": [], "item": [], "value": []})


def audit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    least: int = LEAST, top: int = TOP, block: int = BLOCK,
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``.

    Part ``pair`` has, for each two sources of a language, the sum of the differences between their shares of all kept terms;
    part ``term`` the ``top`` terms of which a source has a greater share than its language. A source without terms takes
    part, with the shares of no occurrences; where a language keeps no terms its sources are 0 apart. Equal values are in the
    order of their items. Null texts, languages and sources are empty strings; an empty table gives no rows.
    """
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source")))).distinct()
    of_term = Window.partitionBy("lang", "term")
    kept = counts(docs, text_col, lang_col, source_col, least, block).withColumns({"lang_docs": F.sum("docs").over(of_term), "lang_times": F.sum("times").over(of_term)})
    kept = kept.where(F.col("lang_docs") >= least).withColumn("new", (F.row_number().over(of_term.orderBy("source")) == 1).cast("long"))
    kept = spool(kept.select("lang", "source", "term", "times", "lang_times", "new"))
    # One row for each source of a language, however many terms it has.
    sums = kept.groupBy("lang", "source").agg(F.sum("times").alias("n"), F.sum("new").alias("new"))
    every, zero = Window.partitionBy("lang"), F.lit(0).cast("long")
    each = groups.join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", zero).alias("n"), F.coalesce("new", zero).alias("new"))
    each = each.select("lang", "source", "n", F.sum("n").over(every).alias("lang_n"), F.sum("new").over(every).alias("v"))
    each = spool(each.withColumn("none", _share(zero, F.col("n"), F.col("v"))))
    # Terms are dealt out to buckets, and so is each source's row, so no source's terms meet in one task.
    most = each.agg(F.max("v")).first()[0] or 0
    buckets = -(-most // BUCKET) or 1
    dealt = kept.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)))
    frame = each.withColumn("bucket", F.explode(F.sequence(zero, F.lit(buckets - 1).cast("long"))))
    shares = frame.join(dealt.hint("merge"), ["lang", "source", "bucket"], "left").select(
        "lang", "source", "bucket", "none", "term", _share(F.col("times"), F.col("n"), F.col("v")).alias("p"), _share(F.col("lang_times"), F.col("lang_n"), F.col("v")).alias("q")
    )
    rank = lambda: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    above = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    above = above.withColumn("rank", rank()).where(F.col("rank") <= top)
    cells = shares.groupBy("lang", "source", "bucket", "none").agg(F.collect_list("term").alias("terms"), F.collect_list("p").alias("shares"))
    cells = cells.select("lang", "source", "bucket", F.coalesce("none", zero).alias("least"), "terms", "shares")
    apart = cells.groupBy("lang", "bucket").applyInPandas(_distances, "lang string, source string, item string, value long")
    pairs = apart.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", rank())
    return pairs.union(above)
