"""Exact deduplication by two-pass Bloom filtering.

Pass one hashes every normalised text and finds, slice by slice, the filter bits that two or more rows set. Pass
two keeps a row out of any shuffle unless all its bits were set twice; only such possibly repeated rows meet.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchored import numbered
from .common import SPACE_BYTES, Bloom, Scratch, strings

KEYED = "doc_id long, th long, text_sha256 string, n_points long, h long"


def _keyed(batches):
    for batch in batches:
        ids, sha, points, keys = batch.column("doc_id"), [], [], []
        for text in strings(batch.column("text")):
            digest = hashlib.sha256(text.encode("utf-8", "surrogatepass").translate(None, SPACE_BYTES)).digest()
            sha.append(digest.hex())
            points.append(len(text))
            keys.append(int.from_bytes(digest[:8], "little", signed=True))
        yield pa.RecordBatch.from_pydict({"doc_id": ids, "th": batch.column("th"), "text_sha256": pa.array(sha, pa.string()), "n_points": pa.array(points, pa.int64()), "h": pa.array(keys, pa.int64())})


def repeated_bits(hashes: DataFrame, log_bits: int) -> Bloom:
    """The filter of bits set by at least two rows. hashes: one BIGINT column. Bits are counted where their slice
    is built, so what is gathered is 2**log_bits bits whatever the number of rows."""
    slices, size = Bloom.SLICES, (1 << log_bits) // Bloom.SLICES // 8

    def distinct(batches):
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            keys, counts = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "twice": pa.array(counts > 1, pa.bool_())})

    def fill(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        mask = np.uint64(size * 8 - 1)
        for batch in batches:
            key = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            twice = batch.column("twice").to_numpy(zero_copy_only=False)
            part = (key & np.uint64(slices - 1)).astype(np.int64)
            for s in np.unique(part):
                seen, again = held.setdefault(int(s), (np.zeros(size * 8, bool), np.zeros(size * 8, bool)))
                for place in Bloom._places(key[part == s], mask):
                    bits, counts = np.unique(place.astype(np.int64), return_counts=True)
                    again[bits] |= seen[bits] | (counts > 1)
                    seen[bits] = True
                for place in Bloom._places(key[(part == s) & twice], mask):
                    again[place.astype(np.int64)] = True
        if held:
            yield pa.RecordBatch.from_pydict({"slice": pa.array(list(held), pa.int32()), "bits": pa.array([np.packbits(b, bitorder="little").tobytes() for _, b in held.values()], pa.binary())})

    keys = hashes.toDF("key").mapInArrow(distinct, "key long, twice boolean").withColumn("slice", F.pmod("key", F.lit(slices)))
    rows = keys.repartition(Bloom.tasks(log_bits), "slice").select("key", "twice").mapInArrow(fill, "slice int, bits binary")
    bits = np.zeros((slices, size), np.uint8)
    for row in rows.collect():  # at most 64 MB
        bits[row.slice] |= np.frombuffer(row.bits, np.uint8)
    return Bloom(bits)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, and th, a hash of the original text.

    Texts are equal if they are the same bytes once `[\\x20\\x09-\\x0D]` is deleted; null counts as empty. The
    longest original text stays (code points), then the smallest doc_id; a null doc_id loses to any other. Of
    rows that agree in doc_id too, each is kept if its doc_id is keep_id. An empty table gives no rows. Extra
    columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact_dedup")
    keyed = scratch.put("keyed", numbered(docs).mapInArrow(_keyed, KEYED))
    bloom = spark.sparkContext.broadcast(repeated_bits(keyed.select("h"), Bloom.log_bits(2 * keyed.count())))

    def mark(batches):
        for batch in batches:
            again = bloom.value.might_hold(batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "th", "text_sha256", "n_points")), pa.array(again, pa.bool_())], ["doc_id", "th", "text_sha256", "n_points", "again"])

    marked = keyed.mapInArrow(mark, "doc_id long, th long, text_sha256 string, n_points long, again boolean")
    alone = marked.filter("not again").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "th")
    met = marked.filter("again").select("doc_id", "th", "text_sha256", "n_points")
    best = F.max(F.struct("n_points", (-F.col("doc_id")).alias("low")))
    groups = met.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), (-best["low"]).alias("keep_id"))
    # With a part of the key beside it, the join deals both sides anew, and a partition with a hot group can be split.
    met, groups = (x.withColumn("lead", F.substring("text_sha256", 1, 8)) for x in (met, groups))
    met = met.join(groups, ["lead", "text_sha256"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "th")
    return alone.unionByName(met)


def keep_unique(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, all columns as they are.

    Null texts count as empty, so one document without text stays; a null doc_id loses to any other; of rows that agree
    in doc_id (null too) and text, one stays whatever else they hold. An empty table gives none; extra columns go along,
    those that begin with __ must not be there.
    """
    return keep_marked(docs, exact_dedup(docs))


def keep_marked(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs whose (doc_id, th) `found` has as kept, once each: of rows that agree in doc_id (null too) and text,
    one stays. Only doc_ids and hashes of rows that go are dealt beside the texts; texts are compared only where a kept
    (doc_id, th) occurs twice."""
    hashed = F.xxhash64(F.coalesce(docs["text"], F.lit("")))

    def of(keys: DataFrame, kind: str, df: DataFrame) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"))
        return df.join(keys, df["doc_id"].eqNullSafe(keys["__id"]) & (hashed == keys["__th"]), kind)

    gone = found.filter("NOT kept").select("doc_id", "th").distinct()
    left = of(gone, "left_anti", docs)
    twice = found.filter("kept").groupBy("doc_id", "th").count().filter("count > 1")
    if twice.isEmpty():
        return left
    return of(twice, "left_anti", left).unionByName(of(twice, "left_semi", left).dropDuplicates(["doc_id", "text"]))
