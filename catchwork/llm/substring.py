"""Substring deduplication by content-defined chunks.

A gear hash rolls over the text's UTF-8 bytes (16 bits wide, so it depends on the last 16 bytes); a chunk ends where it falls
below a threshold, with a least and a greatest length, and always between characters. Cuts depend on content
alone, so an insertion shifts them only nearby. Chunks meet by their 128-bit digest: those that occur in two or
more documents are repeats, their occurrence in the smallest document stays, the others go. Neighbouring repeats are merged into
spans, and spans of under ``SPAN`` characters (common short phrases) are no repeats.

The counts per digest are combined map-side, so that a passage of a third of all documents is no hot group, and the join of
the repeated digests back to the chunks can be split by adaptive execution. First the digests' halves are counted alone, by
hash; a bounded filter of those that occur twice spares chunks that cannot be repeats the sort by place and the shuffles.

Cases: null and empty texts have no chunks. Rows that repeat a document (same id, same text) are one document. A null id is an id
before all others. Texts of any length are chunked whole. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.stage import checkpointed
from .arrow import steps, utf8

LEAST, USUAL, MOST = 12, 24, 96
SPAN = 96
#: Bits of the filter of repeated digests: 16 for each of them, within these bounds (16 MB at the most).
LEAST_FILTER, MOST_FILTER = 1 << 16, 1 << 27
_GEAR = np.array([(xxhash.xxh64_intdigest(bytes([b]), 1) & 0xFFFF) for b in range(256)], np.uint16)


def chunk_ends(text: bytes, least: int = LEAST, usual: int = USUAL, most: int = MOST) -> list[int]:
    """Byte offsets at which chunks end; the last is the text's length."""
    n = len(text)
    x = np.frombuffer(text, np.uint8)
    h = _GEAR[x]
    for back in (1, 2, 4, 8):  # sums over 2, 4, 8 and 16 bytes, each shifted by its distance
        h[back:] += h[:-back] << np.uint16(back)
    cuts = (np.flatnonzero(h < (1 << 16) // usual) + 1).tolist()
    ends, last, k = [], 0, 0
    while n - last > least:
        k = bisect_left(cuts, last + least, k)
        end = min(cuts[k] if k < len(cuts) else n, last + most, n)
        while end < n and text[end] & 0xC0 == 0x80:
            end += 1
        ends.append(end)
        last = end
    if last < n:
        ends.append(n)
    return ends


def one_row_each(docs: DataFrame) -> DataFrame:
    """(doc_id, text, digest) of every document with a text; rows that repeat a document are one."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("digest")).where("text <> ''")
    twice = rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    twice = checkpointed(twice)
    if twice.isEmpty():
        return rows
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    again = rows.join(twice, same, "left_semi").groupBy("doc_id", "digest").agg(F.min("text").alias("text"))
    return rows.join(twice, same, "left_anti").unionByName(again)


def _cut(text: bytes) -> tuple[list[int], list[bytes]]:
    """The ends of a text's chunks, and their digests."""
    cuts = chunk_ends(text)
    return cuts, [xxhash.xxh3_128_digest(text[a:b]) for a, b in zip([0, *cuts], cuts, strict=False)]


def halves(rows: DataFrame) -> DataFrame:
    """(d1): the first half of every digest of a text, once."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            own = b"".join(chain.from_iterable(set(_cut(text)[1]) for text in utf8(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(own, "<i8")[::2])], names=["d1"])

    return rows.select("text").mapInArrow(kernel, "d1 bigint")


def chunks(rows: DataFrame, repeated: Broadcast, once: bool = False) -> DataFrame:
    """(doc_id, digest of the text, d1, d2, start, end) of the chunks whose digest may be in the filter ``repeated``, in code points.

    ``once``: each digest of a text at its first place alone.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "digest", "d1", "d2", "start", "end"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            at, starts, ends, found = [], [], [], []
            for k, text in enumerate(utf8(batch.column("text"))):
                cuts, own = _cut(text)
                both = np.frombuffer(b"".join(own), "<i8").reshape(-1, 2)
                bit = both[:, 0].view(np.uint64) & np.uint64(len(repeated.value) * 8 - 1)
                hit = np.flatnonzero(repeated.value[(bit >> np.uint64(3)).astype(np.intp)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
                if once:
                    hit = np.fromiter({own[j]: j for j in reversed(hit.tolist())}.values(), np.int64)
                if text.isascii():
                    points = np.array([0, *cuts])
                else:
                    points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])[[0, *cuts]]
                at.append(np.full(len(hit), k, np.int32))
                found.append(both[hit])
                starts.append(points[:-1][hit])
                ends.append(points[1:][hit])
            both, take = np.concatenate(found), pa.array(np.concatenate(at))
            columns = [batch.column("doc_id").take(take), batch.column("digest").take(take), pa.array(both[:, 0]), pa.array(both[:, 1])]
            columns += [pa.array(np.concatenate(x).astype(np.int32)) for x in (starts, ends)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.select("doc_id", "text", "digest").mapInArrow(kernel, f"doc_id {kind}, digest bigint, d1 bigint, d2 bigint, start int, end int")


def digest_filter(twice: DataFrame) -> np.ndarray:
    """A bit for each half of a digest (s1) of ``twice``; it only spares rows that cannot meet, whatever its size.

    Bits are joined to words and words to blocks of 64 KB by grouping, so that the driver gets a few hundred rows at the most.
    """
    n = twice.count()
    bits = min(MOST_FILTER, max(LEAST_FILTER, 1 << (16 * n).bit_length()))
    place = F.col("s1").bitwiseAND(F.lit(bits - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(31)).cast("int"))
    words = twice.groupBy(F.shiftright(place, 5).alias("word")).agg(F.bit_or(bit).alias("bits"))
    size = min(bits >> 5, 1 << 14)

    def packed(group: pa.Table) -> pa.Table:
        own, at = np.zeros(size, "<u4"), group.column("word").to_numpy()
        own[at % size] = group.column("bits").to_numpy().astype("<u4")
        return pa.table({"block": pa.array([at[0] // size], pa.int64()), "bits": pa.array([own.tobytes()], pa.binary())})

    out = np.zeros(bits >> 3, np.uint8)
    for r in words.groupBy(F.floor(F.col("word") / size).alias("part")).applyInArrow(packed, "block bigint, bits binary").toLocalIterator():
        out[r["block"] * size * 4 : (r["block"] + 1) * size * 4] = np.frombuffer(r["bits"], np.uint8)
    return out


def repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """Repeated spans: doc_id, digest, start, end, n_chars, n_chunks, n_docs, first_doc_id, stays."""
    rows = one_row_each(docs)
    place = F.struct("doc_id", "digest", "start")
    twice = checkpointed(halves(rows).groupBy(F.col("d1").alias("s1")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("s1"))
    repeated = docs.sparkSession.sparkContext.broadcast(digest_filter(twice))
    counted = chunks(rows, repeated, once=True).groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n_docs"), F.min(place).alias("first"))
    shared = checkpointed(counted.where("n_docs > 1").select(F.col("d1").alias("s1"), F.col("d2").alias("s2"), "n_docs", "first"))
    hit = chunks(rows, repeated).join(shared, (F.col("d1") == F.col("s1")) & (F.col("d2") == F.col("s2")))
    stays = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.digest") == F.col("digest")) & (F.col("first.start") == F.col("start"))
    hit = hit.select("doc_id", "digest", "start", "end", "n_docs", F.col("first.doc_id").alias("first_doc_id"), stays.alias("stays"))
    inside = Window.partitionBy("doc_id", "digest").orderBy("start")
    begins = F.coalesce((F.lag("end").over(inside) != F.col("start")) | (F.lag("stays").over(inside) != F.col("stays")), F.lit(True))
    runs = hit.withColumn("begins", begins).withColumn("run", F.sum(F.col("begins").cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy("doc_id", "digest", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_chunks"), F.max("n_docs").alias("n_docs"), F.min("first_doc_id").alias("first_doc_id"), F.first("stays").alias("stays")
    )
    # a span that stays in part and goes in part is still one passage: its length is that of the joined runs
    near = Window.partitionBy("doc_id", "digest").orderBy("start")
    joined = merged.withColumn("island", F.sum((F.coalesce(F.lag("end").over(near), F.lit(-1)) != F.col("start")).cast("int")).over(near.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("doc_id", "digest", "island")
    joined = joined.withColumn("whole", F.max("end").over(whole) - F.min("start").over(whole)).where(F.col("whole") >= span)
    return joined.select("doc_id", "digest", "start", "end", (F.col("end") - F.col("start")).alias("n_chars"), "n_chunks", "n_docs", "first_doc_id", "stays")


def without_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """``docs`` with the repeated spans that don't stay cut out of their texts; rows that repeat a document are cut alike."""
    gone = repeats(docs, span).where(~F.col("stays")).groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_spans"))
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64(docs["text"].cast("string")) == gone["_digest"]), "left")
    rows = joined.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("rest") if len(docs.columns) > 1 else F.lit(0).alias("rest"), joined["text"].cast("string").alias("text"), "_spans")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("_spans").to_pylist(), strict=True):
                if spans:
                    ends = [0, *(x["end"] for x in spans)]
                    text = "".join(text[a:b] for a, b in zip(ends, [*(x["start"] for x in spans), len(text)], strict=True))
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(out, pa.string())], names=["rest", "text"])

    cut = rows.mapInArrow(kernel, T.StructType([rows.schema["rest"], T.StructField("text", T.StringType())]))
    return cut.select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
