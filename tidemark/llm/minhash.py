"""Near-duplicate documents by b-bit MinHash.

Texts become sets of word shingles; equal sets form classes. Each class keeps the low bits of its minima, packed, and
band keys of whole minima. Classes that share a band are candidates; bit counts of the packed signatures, corrected
for chance collisions, discard those far below the threshold, and full sets confirm the rest.

No bucket is expanded into pairs. Each bucket first links its members to its best connected member. Only where that
leaves a bucket in several components are its members compared across components, in blocks, with links found so
far merging components as they go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchored import numbered
from .common import Bloom, Scratch
from .components import connected_components
from .exact_dedup import keep_marked
from .kernels import chunks, mix, run_codes, window_codes, word_codes, words

SHINGLE, BANDS, ROWS, BITS = 5, 30, 5, 2
#: How far below the threshold an estimate may lie before a pair is discarded: five standard deviations.
MARGIN = 0.2
#: Members of a bucket that are compared in one task, a side; parts that a hot bucket is dealt in before that.
BLOCK, SALTS = 1000, 16

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(97))
_LOW, _HIGH = (_rng.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1) for _ in range(2))
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each document, and the bounds of each document's own."""
    data = _lower[data]
    begin, end, doc = words(data, at)
    codes, n = word_codes(data, begin, end), len(at) - 1
    sliding = window_codes(codes, width)
    whole = np.flatnonzero(doc[: len(sliding)] == doc[width - 1 :]) if len(sliding) else np.zeros(0, np.int64)
    first = np.searchsorted(doc, np.arange(n + 1))
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < width))
    key = np.concatenate((sliding[whole], run_codes(codes, first[short], first[short + 1] - 1)))
    own = np.concatenate((doc[whole], short))
    order = np.lexsort((key, own))
    key, own = key[order], own[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    key, own = key[fresh], own[fresh]
    return key, np.searchsorted(own, np.arange(n + 1))


def class_keys(key: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each document's whole set."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(key ^ np.uint64(0xA0761D6478BD642F)))))
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64))


def sketches(key: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed low bits of the minima and band keys of every document; its set must not be empty."""
    low, high, start = key.astype(np.uint32), (key >> np.uint64(32)).astype(np.uint32), bounds[:-1]
    minima = np.empty((len(start), BANDS * ROWS), np.uint32)
    for k in range(BANDS * ROWS):
        minima[:, k] = np.minimum.reduceat(low * _LOW[k] + high * _HIGH[k], start)
    bits = np.concatenate([(minima >> np.uint32(b)) & np.uint32(1) for b in range(BITS)], axis=1).astype(np.uint8)
    packed = np.packbits(bits.reshape(len(start), BITS, -1), axis=2).reshape(len(start), -1)
    bands = np.zeros((len(start), BANDS), np.uint64)
    for r in range(ROWS):
        bands = mix(bands * np.uint64(31) + minima[:, r::ROWS].astype(np.uint64) + np.uint64(1))
    return packed, mix(bands + np.arange(BANDS, dtype=np.uint64))


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity of a packed signature to each of many, corrected for minima whose low bits agree by chance."""
    half = one.shape[-1] // BITS
    unequal = np.zeros((len(many), half), np.uint8)
    for b in range(BITS):
        unequal |= many[:, b * half : (b + 1) * half] ^ one[..., b * half : (b + 1) * half]
    agree = 1 - _ONES[unequal].sum(axis=1) / (BANDS * ROWS)
    chance = 0.5**BITS
    return (agree - chance) / (1 - chance)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sketch(width: int):
    def run(batches):
        for batch in batches:
            for first, stop, data, at in chunks(batch.column("text")):
                key, bounds = shingle_sets(data, at, width)
                n, full = np.diff(bounds), np.flatnonzero(np.diff(bounds))
                v, sig, bands = class_keys(key, bounds), [None] * (stop - first), [None] * (stop - first)
                if len(full):
                    packed, keys = sketches(key, np.append(bounds[:-1][full], len(key)))
                    for k, row in enumerate(full.tolist()):
                        sig[row], bands[row] = packed[k].tobytes(), keys[k].view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, stop - first), batch.column("th").slice(first, stop - first), pa.array(n, pa.int64()), pa.array(v.view(np.int64)), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "th", "n", "v", "sig", "bands"])

    return run


def _sets(width: int, wanted):
    """v, members: the sets of the documents that stand for a class; wanted holds hash(class, doc_id)."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for first, stop, data, at in chunks(batch.column("text")):
                key, bounds = shingle_sets(data, at, width)
                v = class_keys(key, bounds)
                hit = np.flatnonzero(wanted.value.might_hold(standing(v, ids[first:stop])))
                yield pa.RecordBatch.from_arrays([pa.array(v[hit].view(np.int64)), pa.array(ids[first:stop][hit].view(np.int64)), pa.array([key[bounds[k] : bounds[k + 1]].tobytes() for k in hit.tolist()], pa.binary())], ["v", "doc_id", "members"])

    return run


def standing(v: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    return mix(v + mix(doc_id))


def _standing_keys(batches):
    for batch in batches:
        v, ids = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("v", "label"))
        yield pa.RecordBatch.from_arrays([pa.array(standing(v, ids).view(np.int64))], ["key"])


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            keep = [similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("w")], ["u", "w"]).filter(pa.array(keep, pa.bool_()))

    return run


def _likely(percent: int):
    """Keeps pairs whose sizes and signatures allow the similarity."""

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sig_u", "sig_w"))
            n, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_u", "n_w"))
            keep = (estimate(a, b) >= percent / 100 - MARGIN) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) if batch.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("w")], ["u", "w"]).filter(pa.array(keep))

    return run


def _standing_out(percent: int):
    """Rows of one block pair of one bucket together, without sets: part and v of members whose signature is near that of a
    member of another component. Only their sets are fetched."""

    def near(rows: list[tuple]) -> list[int]:
        sig, comp = np.stack([np.frombuffer(r[2], np.uint8) for r in rows]), np.array([r[1] for r in rows])
        hit = np.zeros(len(rows), bool)
        for i in range(1, len(rows)):
            same = (estimate(sig[i], sig[:i]) >= percent / 100 - MARGIN) & (comp[:i] != comp[i])
            if same.any():
                hit[:i] |= same
                hit[i] = True
        return [r[0] for r, h in zip(rows, hit.tolist(), strict=True) if h]

    def told(part: int, found: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part] * len(found), pa.int64()), pa.array(found, pa.int64())], ["part", "v"])

    def run(batches):
        part, rows = None, []
        for batch in batches:
            for key, *rest in zip(*(batch.column(c).to_pylist() for c in ("part", "v", "comp", "sig")), strict=True):
                if key != part:
                    if len(rows) > 1:
                        yield told(part, near(rows))
                    part, rows = key, []
                rows.append(tuple(rest))
        if len(rows) > 1:
            yield told(part, near(rows))

    return run


def _across(percent: int):
    """Rows of one block pair of one bucket together: links between members of different components."""

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        sig = np.stack([np.frombuffer(r[4], np.uint8) for r in rows])
        sets = [np.frombuffer(r[5], np.uint64) for r in rows]
        root = {r[2]: r[2] for r in rows}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        found = []
        for i in range(1, len(rows)):
            near = np.flatnonzero(estimate(sig[i], sig[:i]) >= percent / 100 - MARGIN)
            for j in near.tolist():
                a, b = find(rows[i][2]), find(rows[j][2])
                if a != b and similar(sets[i], sets[j], percent):
                    root[max(a, b)] = min(a, b)
                    found.append((rows[i][1], rows[j][1]))
        return found

    def run(batches):
        group, rows = None, []
        for batch in batches:
            out = []
            for key, *rest in zip(*(batch.column(c).to_pylist() for c in ("part", "v", "comp", "n", "sig", "members")), strict=True):
                if key != group:
                    out += links(rows) if len(rows) > 1 else []
                    group, rows = key, []
                rows.append((key, *rest))
            yield _pairs(out)
        if len(rows) > 1:
            yield _pairs(links(rows))

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["u", "w"])


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = SHINGLE) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept, and th, a hash of the text.

    A document's set: distinct shingles of `width` words (A-Z lower-cased); of fewer words, the whole sequence as one.
    Documents with 100 * intersection >= percent * union are linked; component_id is the smallest doc_id that links
    reach, and the document of that id is kept. Null or empty texts are linked with nothing. Rows with a null doc_id
    are linked with nothing, get a null component_id and are kept. Repeated rows are linked with each other. An empty
    table gives no rows; extra columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    rows = numbered(docs)
    sketch = scratch.put("sketch", rows.mapInArrow(_sketch(width), "doc_id long, th long, n long, v long, sig binary, bands array<long>"))
    lone = "doc_id IS NULL OR n = 0"
    classes = sketch.filter(f"NOT ({lone})").groupBy("v").agg(F.min("doc_id").alias("label"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = scratch.put("classes", classes)

    # Buckets of two or more classes, and in each the member that shares most.
    # With a part of the key beside it, a join deals both sides anew, and a partition with a hot bucket can be split.
    lead = F.pmod("band", F.lit(1024)).alias("lead")
    spread = classes.select("v", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    crowd = spread.select("v", "band", lead).join(shared.select("band", "size", lead), ["band", "lead"]).drop("lead")
    crowd = scratch.put("crowd", crowd)
    weight = crowd.groupBy("v").agg(F.sum("size").alias("weight"))
    hub = crowd.join(weight, "v").groupBy("band").agg(F.max(F.struct("weight", "v")).alias("best")).select("band", lead, F.col("best.v").alias("w"))
    stars = crowd.select("band", lead, F.col("v").alias("u")).join(hub, ["band", "lead"]).filter("u <> w").select("u", "w").distinct()
    side = lambda c: classes.select(F.col("v").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"))
    stars = stars.join(side("u"), "u").join(side("w"), "w").mapInArrow(_likely(percent), "u long, w long")
    stars = scratch.put("stars", stars)

    # Full sets of the classes that stand in any bucket with another.
    met = scratch.put("met", classes.join(weight.select("v"), "v").select("v", "label"))
    bloom = spark.sparkContext.broadcast(Bloom.build(met.mapInArrow(_standing_keys, "key long"), met.count()))
    sets = rows.filter("doc_id IS NOT NULL AND text <> ''").mapInArrow(_sets(width, bloom), "v long, doc_id long, members binary")
    sets = sets.join(met.withColumnRenamed("label", "doc_id"), ["v", "doc_id"]).dropDuplicates(["v"]).select("v", "members")
    sets = scratch.put("sets", sets)
    part = lambda c, x: sets.select(F.col("v").alias(c), F.col("members").alias(x))
    links = scratch.put("links", stars.join(part("u", "a"), "u").join(part("w", "b"), "w").mapInArrow(_confirm(percent), "u long, w long"))
    scratch.drop("met", "stars")
    scratch.sweep()

    # Buckets that are still in several components, compared across them.
    member = connected_components(scratch, links, "first")
    placed = crowd.join(member, "v", "left").select("band", "v", "size", F.coalesce("root", "v").alias("comp"))
    split = placed.filter("size > 2").groupBy("band").agg((F.min("comp") < F.max("comp")).alias("split")).filter("split").select("band")
    # Dealt by a part of the member too, so that no task meets a whole hot bucket.
    salted = split.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(salted, ["band", "salt"])
    placed = placed.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("v", "band"), F.col("blocks").cast("long")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("v", "comp", F.xxhash64("band", F.least("own", "other"), F.greatest("own", "other")).alias("part"))
    placed = scratch.put("placed", placed)
    signed = placed.join(classes.select("v", "sig"), "v").repartition("part").sortWithinPartitions("part", "v")
    out = scratch.put("out", signed.mapInArrow(_standing_out(percent), "part long, v long"))
    placed = placed.join(out, ["part", "v"]).join(classes.select("v", "n", "sig"), "v").join(sets, "v")
    more = placed.repartition("part").sortWithinPartitions("part", F.col("n").desc(), "v").mapInArrow(_across(percent), "u long, w long")
    more = scratch.put("more", more)
    if not more.isEmpty():
        member = connected_components(scratch, links.union(more), "second")
    scratch.drop("crowd", "sets", "links", "more", "placed", "out")
    scratch.sweep()

    labels = classes.select("v", "label").join(member, "v", "left").withColumn("root", F.coalesce("root", "v"))
    least = labels.groupBy("root").agg(F.min("label").alias("component_id"))
    named = scratch.put("named", labels.join(least, "root").select("v", "component_id"))
    linked = sketch.filter(f"NOT ({lone})").select("doc_id", "th", "n", "v").join(named, "v").select("doc_id", "th", "n", "component_id")
    alone = sketch.filter(lone).select("doc_id", "th", "n", F.col("doc_id").alias("component_id"))
    both = linked.unionByName(alone)
    return both.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "th")


def keep_representatives(docs: DataFrame, percent: int = 80, width: int = SHINGLE) -> DataFrame:
    """The rows of docs, all columns as they are, that near_duplicates keeps.

    Null and empty texts and rows with a null doc_id are linked with nothing and stay; of rows that agree in doc_id (null
    too) and text, one stays. An empty table gives none; extra columns go along, those that begin with __ must not be
    there."""
    return keep_marked(docs, near_duplicates(docs, percent, width))
