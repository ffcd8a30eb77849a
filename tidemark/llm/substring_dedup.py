"""Substring deduplication on words by relative Lempel-Ziv parsing.

Reference blocks are the distinct content-anchored segments of the corpus, owned by their smallest doc_id. Where an
anchor has several blocks, each block is factored greedily, in order of owner, against the index of every earlier
block with that anchor; factors of at least one whole window are duplicates, and the window at each factor boundary
is looked up again. A block that occurs again in a later document is one factor as a whole.

The index of one anchor holds a bounded number of windows. Where an anchor has more, its windows are dealt out anew by
their own hashes, and each is held against its least owner.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchored import numbered, repeated_segments, runs_of, segment_keys, spans_by_document, unpack
from .common import Scratch, strings
from .kernels import Prefix, covered, run_codes, segments, window_codes, word_codes, words

WINDOW, GRAM = 13, 4
#: Windows of an anchor that one task indexes, at some 250 bytes each.
ANCHOR_WINDOWS = 1 << 15


def word_cutter(window: int = WINDOW, gram: int = GRAM):
    def cut(data: np.ndarray, at: np.ndarray):
        begin, end, doc = words(data, at)
        codes = word_codes(data, begin, end)
        letters = np.concatenate(([0], np.cumsum(end - begin)))
        size = letters[gram:] - letters[:-gram] if len(begin) >= gram else np.zeros(0, np.int64)
        first, last, anchor, _ = segments(Prefix(codes), doc, window, gram, 63 - np.minimum(63, size))  # long grams are rare ones
        origin = np.searchsorted(doc, doc[first]) if len(first) else first

        def told(keep: np.ndarray):
            whole = window_codes(codes, window)

            def payload(some: np.ndarray) -> list[bytes]:
                return [whole[a : b + 1].tobytes() for a, b in zip(first[some].tolist(), last[some].tolist(), strict=True)]

            return run_codes(whole, first[keep], last[keep]), payload

        return doc[first] if len(first) else first, first - origin, last - first + 1, anchor, told

    return cut


def factor_blocks(batches):
    """Rows a, s, owner, payload sorted by a, owner; gives a, s, off, n: runs of windows that an earlier owner has."""
    anchor, index, block = None, {}, 0
    for batch in batches:
        out: list[tuple[int, int, int, int]] = []
        for a, s, owner, payload in zip(*(batch.column(c).to_pylist() for c in ("a", "s", "owner", "payload")), strict=True):
            if a != anchor:
                anchor, index = a, {}
            block += 1
            own, i = np.frombuffer(payload, np.int64).tolist(), 0
            while i < len(own):
                hit = index.get(own[i])
                if hit is None or hit[0] == owner:  # a literal
                    i += 1
                    continue
                j = 1
                while i + j < len(own) and index.get(own[i + j]) == (hit[0], hit[1], hit[2] + j):
                    j += 1
                out.append((a, s, i, j))
                i += j
            for k, w in enumerate(own):
                index.setdefault(w, (owner, block, k))
        yield pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in out], t) for k, (n, t) in enumerate((("a", pa.int64()), ("s", pa.int64()), ("off", pa.int32()), ("n", pa.int32())))})


def dealt_windows(blocks: DataFrame) -> DataFrame:
    """As factor_blocks, with no order and no index: each window by its own hash, against its least owner."""

    def each(batches):
        for batch in batches:
            owns = [np.frombuffer(x, np.int64) for x in batch.column("payload").to_pylist()]
            size = np.array([len(x) for x in owns], np.int64)
            take, off = pa.array(np.repeat(np.arange(len(size)), size)), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("a", "s", "owner")), pa.array(off.astype(np.int32)), pa.array(np.concatenate(owns) if owns else off)], ["a", "s", "owner", "off", "w"])

    windows = blocks.select("a", "s", "owner", "payload").mapInArrow(each, "a long, s long, owner long, off int, w long")
    least = windows.groupBy("a", "w").agg(F.min("owner").alias("least"), F.max("owner").alias("last")).filter("least < last").select("a", "w", "least")
    # A join of its own, so that partitions with a hot window can be split.
    return runs_of(windows.join(least.hint("merge"), ["a", "w"]).filter("owner > least").select("a", "s", "off"))


def duplicate_spans(scratch: Scratch, rows: DataFrame, window: int, gram: int, anchor_windows: int) -> DataFrame:
    found = repeated_segments(scratch, rows.filter("doc_id IS NOT NULL"), word_cutter(window, gram))
    keys = scratch.put("keys", segment_keys(found, anchor_windows))
    several = keys.filter("several").select("a", "s", "owner", "hot")
    blocks = found.filter("payload IS NOT NULL").select("a", "s", "payload").join(several, ["a", "s"]).groupBy("a", "s", "owner", "hot").agg(F.first("payload").alias("payload"))
    factors = blocks.filter("not hot").drop("hot").repartition("a").sortWithinPartitions("a", "owner", "s").mapInArrow(factor_blocks, "a long, s long, off int, n int")
    if not keys.filter("hot").isEmpty():
        factors = factors.unionByName(dealt_windows(scratch.put("hot", blocks.filter("hot"))))
    factors = scratch.put("factors", factors.join(several.drop("hot"), ["a", "s"]))
    scratch.drop(*{"hot"} & set(scratch.paths))
    # Each is one join of two tables that are dealt for it, so that partitions with a hot segment can be split.
    places = found.drop("payload")
    later = places.join(keys.select("a", "s", "owner"), ["a", "s"]).filter("doc_id > owner")
    later = later.select("doc_id", "th", "start", (F.col("n") + (window - 1)).alias("length"))
    owners = places.drop("n").join(factors, ["a", "s"]).filter("doc_id = owner")
    owners = owners.select("doc_id", "th", (F.col("start") + F.col("off")).alias("start"), (F.col("n") + (window - 1)).alias("length"))
    spans = scratch.put("spans", spans_by_document(later.unionByName(owners)))
    scratch.drop("segments", "keys", "factors")
    scratch.sweep()
    return spans


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, anchor_windows: int = ANCHOR_WINDOWS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_text (kept words joined by one space).

    Removes every word of a window of `window` words whose sequence also starts in a document of smaller doc_id.
    Null text counts as empty; texts of fewer words than a window stay as they are. Rows that repeat a doc_id do not
    remove each other; rows with a null doc_id stay whole and serve no other row. An empty table gives no rows; extra
    columns are not read.
    """
    rows = numbered(docs)
    spans = duplicate_spans(Scratch(docs.sparkSession, "substring_dedup"), rows, window, gram, anchor_windows)

    def keep(batches):
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            spans = batch.column("spans")
            for k, text in enumerate(strings(batch.column("text"))):
                own = text.encode("utf-8", "surrogatepass").split()
                n_words.append(len(own))
                starts, lengths = unpack(spans, k)
                gone = covered(starts, lengths, len(own)) if len(starts) else None
                n_removed.append(0 if gone is None else int(gone.sum()))
                kept.append(b" ".join(own if gone is None else [w for w, x in zip(own, gone.tolist(), strict=True) if not x]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    met = rows.join(spans, ["doc_id", "th"], "left").select("doc_id", "text", "spans")
    return met.mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept_text string")
