"""Content-anchored segments that occur more than once: the candidates of both substring deduplications.

Every window of a text lies in exactly one segment, chosen by the window's content alone (kernels.segments), so
two equal windows always lie in segments with equal anchors. A first pass over the texts counts anchors and keeps
those seen twice, as a Bloom filter of bounded size; a second pass lets out only segments with such an anchor.
No window is lost: the filter prunes, and exact grouping of what it lets out decides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bloom, Scratch
from .kernels import chunks

#: cut(data, at) -> row, start, windows, anchor of each segment and told(which) -> codes, payload(which) -> list of bytes.
Cut = Callable[[np.ndarray, np.ndarray], tuple]

SEGMENTS = "doc_id long, th long, a long, s long, start int, n int, payload binary"


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and th, a hash that tells apart rows which share a doc_id but not the text."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def repeated_segments(scratch: Scratch, rows: DataFrame, cut: Cut) -> DataFrame:
    """Written table of all segments of `rows` (as numbered() gives them) whose anchor occurs at least twice,
    and of a few more that the filter lets through. payload is null where the segment has one further up in the same
    stretch of text, so that a hot segment brings few."""
    spark = rows.sparkSession
    rows = rows.filter(F.col("text") != "")

    def count(batches):
        for batch in batches:
            found = [cut(data, at)[3] for _, _, data, at in chunks(batch.column("text"))]
            keys, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([_signed(keys), pa.array(counts, pa.int64())], ["key", "c"])

    anchors = rows.select("text").mapInArrow(count, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")).filter("c > 1").select("key")
    anchors = scratch.put("anchors", anchors)
    bloom = spark.sparkContext.broadcast(Bloom.build(anchors, anchors.count()))
    scratch.drop("anchors")
    scratch.sweep()

    def let_out(batches):
        for batch in batches:
            ids, hashes = batch.column("doc_id"), batch.column("th")
            for first, _, data, at in chunks(batch.column("text")):
                row, start, n, anchor, told_of = cut(data, at)
                keep = np.flatnonzero(bloom.value.might_hold(anchor))
                take = pa.array(row[keep] + first)
                code, payload = told_of(keep)
                told = np.unique(code, return_index=True)[1]  # the first of each segment here has its payload
                held: list = [None] * len(keep)
                for k, x in zip(told.tolist(), payload(keep[told]), strict=True):
                    held[k] = x
                yield pa.RecordBatch.from_arrays([ids.take(take), hashes.take(take), _signed(anchor[keep]), _signed(code), pa.array(start[keep], pa.int32()), pa.array(n[keep], pa.int32()), pa.array(held, pa.binary())], ["doc_id", "th", "a", "s", "start", "n", "payload"])

    return scratch.put("segments", rows.mapInArrow(let_out, SEGMENTS))


def segment_keys(segments: DataFrame, most: int, extra: int = 0) -> DataFrame:
    """Per distinct segment: occurrences, smallest doc_id, windows, whether its anchor has other segments too (several),
    and whether those are too many for one task (hot): more than `most` windows, with `extra` more a segment."""
    keys = segments.groupBy("a", "s").agg(F.count(F.lit(1)).alias("c"), F.min("doc_id").alias("owner"), F.first("n").alias("n"))
    several, hot = F.count(F.lit(1)) > 1, F.sum(F.col("n") + extra) > most
    anchors = keys.groupBy("a").agg(several.alias("several"), (several & hot).alias("hot"), F.sum("c").alias("total")).filter("total > 1").select("a", "several", "hot")
    return keys.join(anchors, "a")  # with n, so that both sides are one exchange


def runs_of(windows: DataFrame) -> DataFrame:
    """windows: a, s, off. a, s, off, n: runs of neighbours (a segment has as many windows as its width at most)."""

    def run(batches):
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for a, s, offs in zip(*(batch.column(c).to_pylist() for c in ("a", "s", "offs")), strict=True):
                at = np.sort(np.array(offs, np.int64))
                first = np.flatnonzero(np.diff(at, prepend=at[0] - 2) != 1)
                out += [(a, s, int(at[k]), int(n)) for k, n in zip(first, np.diff(np.append(first, len(at))), strict=True)]
            yield pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in out], t) for k, (n, t) in enumerate((("a", pa.int64()), ("s", pa.int64()), ("off", pa.int32()), ("n", pa.int32())))})

    return windows.groupBy("a", "s").agg(F.collect_set("off").alias("offs")).mapInArrow(run, "a long, s long, off int, n int")


def spans_by_document(spans: DataFrame) -> DataFrame:
    """spans: doc_id, th, start, length. One row per document, its spans packed into longs (a document's own
    spans only, so as many as the document is long at most)."""
    packed = F.shiftleft(F.col("start").cast("long"), 32) + F.col("length").cast("long")
    return spans.groupBy("doc_id", "th").agg(F.collect_set(packed).alias("spans"))


def unpack(spans: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    if not spans[k].is_valid:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = spans[k].values.to_numpy(zero_copy_only=False)
    return x >> 32, x & 0xFFFFFFFF
