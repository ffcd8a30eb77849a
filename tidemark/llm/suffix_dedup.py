"""Suffix-array deduplication on bytes by external induced sorting.

Repeated strings meet through content-anchored segments: equal strings of the full width lie in segments of one anchor.
Copies of a segment collapse before they travel. The distinct segments of anchors that have several are laid out in
shards (a shard holds whole anchors), each shard's suffixes are sorted by induction with their common prefixes
(suffix_sort), and a suffix whose common prefix with a neighbour is the full width starts a repeated string.

A shard may be far larger than the memory that its sort is given. Yet no task takes an unbounded group: an anchor with
more than `anchor_bytes` of different segments is not sorted; its windows are dealt out by hashes of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .anchored import numbered, repeated_segments, runs_of, segment_keys, spans_by_document, unpack
from .common import Scratch, strings
from .kernels import BYTE_CODE, Prefix, covered, mix, segments, window_codes
from .suffix_sort import STORE_BYTES, Store, repeated_starts

WIDTH, GRAM = 200, 32
#: Bytes of segments at which a shard ends, and of one anchor that a task sorts at most.
SHARD_BYTES, ANCHOR_BYTES = 16 << 20, 64 << 20


def byte_cutter(width: int = WIDTH, gram: int = GRAM):
    def cut(data: np.ndarray, at: np.ndarray):
        doc = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
        first, last, anchor, place = segments(Prefix(BYTE_CODE[data]), doc, width, gram)
        row = doc[first].astype(np.int64) if len(first) else first

        def told(keep: np.ndarray):
            raw = data.tobytes()

            def payload(some: np.ndarray) -> list[bytes]:
                """Two bytes for the place of the anchor, then the segment."""
                return [(p - a).to_bytes(2, "little") + raw[a : b + width] for a, b, p in zip(first[some].tolist(), last[some].tolist(), place[some].tolist(), strict=True)]

            return np.array([xxh3_64_intdigest(raw[a : b + width]) for a, b in zip(first[keep].tolist(), last[keep].tolist(), strict=True)], np.uint64), payload

        return row, first - at[row] if len(first) else first, last - first + 1, anchor, told

    return cut


def likely(blocks: list[tuple[int, bytes]], width: int, gram: int) -> list[tuple[int, int, int]]:
    """Which segments of one anchor (its place in each, the bytes) can share a string of the full width with another, and
    from where to where in them.

    The string holds the anchor and a few bytes less than the rest of its width around it, in one of twelve ways of parting
    them (or a few more): so much is compared. What none of the ways met twice reaches is cut off."""
    whole = width - gram
    step = max(1, whole // 12)
    seen: dict[tuple[int, bytes], int] = {}
    sides = []
    for at, raw in blocks:
        keys = []
        for left in range(0, max(1, whole), step):
            right = max(0, whole - step - left)
            if at >= left and at + gram + right <= len(raw):
                keys.append((left, raw[at - left : at + gram + right]))
        for key in keys:
            seen[key] = seen.get(key, 0) + 1
        sides.append(keys)
    out = []
    for k, ((at, raw), keys) in enumerate(zip(blocks, sides, strict=True)):
        if met := [key[0] for key in keys if seen[key] > 1]:
            first, end = max(0, at - met[-1] - step), min(len(raw), at + width - met[0])
            if end - first >= width:
                out.append((k, first, end))
    return out


def sort_shards(width: int, gram: int, shard_bytes: int, store_bytes: int):
    """Rows a, s, payload with equal a together; gives a, s, off, n: runs of starts of strings that occur again."""

    def runs(keys: list[tuple[int, int, int]], blocks: list[bytes]) -> pa.RecordBatch:
        block, at = repeated_starts(blocks, width, Store(store_bytes))
        fresh = np.ones(len(at), bool)
        fresh[1:] = (block[1:] != block[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(fresh)
        n = np.diff(np.append(first, len(at)))
        a, s, cut = np.array(keys, np.int64).reshape(-1, 3)[block[first]].T
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(s), pa.array((at[first] + cut).astype(np.int32)), pa.array(n.astype(np.int32))], ["a", "s", "off", "n"])

    def run(batches):
        keys, blocks, size = [], [], 0
        anchor, group = None, []

        def take() -> int:
            mine = likely([(at, raw) for _, at, raw in group], width, gram)
            keys.extend((anchor, group[k][0], first) for k, first, _ in mine)
            blocks.extend(group[k][2][first:end] for k, first, end in mine)
            return sum(end - first for _, first, end in mine)

        for batch in batches:
            for a, s, payload in zip(*(batch.column(c).to_pylist() for c in ("a", "s", "payload")), strict=True):
                if a != anchor:
                    size += take()
                    if size >= shard_bytes:
                        yield runs(keys, blocks)
                        keys, blocks, size = [], [], 0
                    anchor, group = a, []
                group.append((s, int.from_bytes(payload[:2], "little"), payload[2:]))
        take()
        if blocks:
            yield runs(keys, blocks)

    return run


#: Of one byte, for the second half of a window's hash.
OTHER_CODE = mix(BYTE_CODE)


def dealt_windows(blocks: DataFrame, width: int) -> DataFrame:
    """a, s, off, n: runs of starts of strings that occur again in the segments of one anchor, by hashes of each string."""

    def each(batches):
        for batch in batches:
            raw = [x[2:] for x in batch.column("payload").to_pylist()]
            size = np.array([len(x) for x in raw], np.int64) - (width - 1)
            data = np.frombuffer(b"".join(raw), np.uint8)
            base = np.cumsum(size + width - 1) - (size + width - 1)
            take, off = np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            at = base[take] + off
            h, g = (pa.array(window_codes(code[data], width)[at].view(np.int64)) for code in (BYTE_CODE, OTHER_CODE))
            take = pa.array(take)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("s").take(take), pa.array(off.astype(np.int32)), h, g], ["a", "s", "off", "h", "g"])

    windows = blocks.select("a", "s", "payload").mapInArrow(each, "a long, s long, off int, h long, g long")
    again = windows.groupBy("a", "h", "g").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("a", "h", "g")
    # A join of its own, so that partitions with a hot window can be split.
    return runs_of(windows.join(again.hint("merge"), ["a", "h", "g"]).select("a", "s", "off"))


def repeated_spans(scratch: Scratch, rows: DataFrame, width: int, gram: int, shard_bytes: int, store_bytes: int, anchor_bytes: int) -> DataFrame:
    found = repeated_segments(scratch, rows, byte_cutter(width, gram))
    keys = scratch.put("keys", segment_keys(found, anchor_bytes, width - 1).drop("owner"))
    several = keys.filter("several").select("a", "s", "hot")
    blocks = found.filter("payload IS NOT NULL").select("a", "s", "payload").join(several, ["a", "s"]).groupBy("a", "s", "hot").agg(F.first("payload").alias("payload"))
    runs = blocks.filter("not hot").drop("hot").repartition("a").sortWithinPartitions("a").mapInArrow(sort_shards(width, gram, shard_bytes, store_bytes), "a long, s long, off int, n int")
    if not keys.filter("hot").isEmpty():
        runs = runs.unionByName(dealt_windows(scratch.put("hot", blocks.filter("hot")), width))
    once = keys.filter("c = 1 AND several").select("a", "s")
    runs = scratch.put("runs", runs.join(once, ["a", "s"]))
    scratch.drop(*{"hot"} & set(scratch.paths))
    # Each is one join of two tables that are dealt for it, so that partitions with a hot segment can be split.
    places = found.drop("payload")
    whole = places.join(keys.filter("c > 1").select("a", "s"), ["a", "s"])
    whole = whole.select("doc_id", "th", "start", (F.col("n") + (width - 1)).alias("length"))
    parts = places.drop("n").join(runs, ["a", "s"])
    parts = parts.select("doc_id", "th", (F.col("start") + F.col("off")).alias("start"), (F.col("n") + (width - 1)).alias("length"))
    spans = scratch.put("spans", spans_by_document(whole.unionByName(parts)))
    scratch.drop("segments", "keys", "runs")
    scratch.sweep()
    return spans


def suffix_dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, store_bytes: int = STORE_BYTES, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (BINARY, may not be valid UTF-8).

    Removes every byte covered by a string of `width` bytes that also starts anywhere else, in the same or another
    row (a repeated row counts as another). Strings never cross rows. Null text counts as empty; shorter texts stay
    as they are; null doc_ids are rows like any other. An empty table gives no rows; extra columns are not read.
    """
    rows = numbered(docs)
    spans = repeated_spans(Scratch(docs.sparkSession, "suffix_dedup"), rows, width, gram, shard_bytes, store_bytes, anchor_bytes)

    def keep(batches):
        for batch in batches:
            sizes, removed, counts, kept = [], [], [], []
            spans = batch.column("spans")
            for k, text in enumerate(strings(batch.column("text"))):
                raw = text.encode("utf-8", "surrogatepass")
                sizes.append(len(raw))
                starts, lengths = unpack(spans, k)
                gone = covered(starts, lengths, len(raw))
                removed.append(int(gone.sum()))
                counts.append(int((gone[1:] & ~gone[:-1]).sum()) + int(len(gone) > 0 and gone[0]))
                kept.append(raw if not removed[-1] else np.frombuffer(raw, np.uint8)[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    met = rows.join(spans, rows["doc_id"].eqNullSafe(spans["doc_id"]) & (rows["th"] == spans["th"]), "left")
    met = met.select(rows["doc_id"], rows["text"], spans["spans"])
    return met.mapInArrow(keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
