"""Mixing sources to target weights.

Each source's documents, in order of doc_id, are packed end to end into blocks of a fixed number of words. The output is
a run of shards of a fixed number of slots. Multinomial draws give each shard's slots per source: they run down a binary
tree over the shards, where a node draws how much of each source's quota goes to its left half, and its right half has
the rest, so that totals meet the targets. Nodes are seeded by place, so any executor finds any shard's draws on its
own. A source's slots run through pseudorandom permutations of its block numbers, one per epoch, and blocks are joined
by number.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .kernels import chunks, mix, words

BLOCK, SHARD, MOST = 128, 1024, 3
ROUNDS = np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
#: Sources whose sizes the driver holds; a mix of more is refused.
MAX_SOURCES = 1_000_000


def targets(sizes: np.ndarray, weights: np.ndarray, most: int = MOST) -> np.ndarray:
    """Shares of the sum of sizes by weight, none above `most` times its size; what is cut is shared out again."""
    total, out = float(sizes.sum()), np.zeros(len(sizes))
    cap, open_ = most * sizes.astype(float), np.ones(len(sizes), bool)
    while total > 0:
        share = (total - cap[~open_].sum()) * weights / max(weights[open_].sum(), 1e-300)
        over = open_ & (share > cap)
        if not over.any():
            out = np.where(open_, share, cap)
            break
        open_ &= ~over
        if not open_.any():
            return cap
    return out


@dataclass(frozen=True)
class Plan:
    """Blocks to draw and blocks there are, by source number; the seed that all draws follow."""

    quota: np.ndarray
    blocks: np.ndarray
    seed: int

    @property
    def slots(self) -> int:
        return int(self.quota.sum())

    @property
    def shards(self) -> int:
        return -(-self.slots // SHARD)

    def split(self, low: int, high: int, quota: np.ndarray) -> np.ndarray:
        """Slots per source in the left half of a node of shards [low, high)."""
        middle = (low + high) // 2
        left = min(middle * SHARD, self.slots) - low * SHARD
        rng = np.random.Generator(np.random.PCG64([self.seed, low, high]))
        return multinomial(rng, quota, left)

    def draws(self, shards: np.ndarray):
        """(shard, first slot of each source, slots of each source) of every shard asked for."""
        want = set(shards.tolist())
        stack = [(0, max(1, self.shards), self.quota, np.zeros_like(self.quota), shards)] if len(shards) else []
        while stack:
            low, high, quota, first, mine = stack.pop()
            if high - low == 1:
                if low in want:
                    yield low, first, quota
                continue
            middle, left = (low + high) // 2, self.split(low, high, quota)
            for a, b, q, f in ((low, middle, left, first), (middle, high, quota - left, first + left)):
                own = mine[(mine >= a) & (mine < b)]
                if len(own):
                    stack.append((a, b, q, f, own))


def multinomial(rng: np.random.Generator, quota: np.ndarray, n: int) -> np.ndarray:
    """A multinomial draw of n slots by quota; what falls to a source beyond its quota is drawn again among the others."""
    out, room, n = np.zeros_like(quota), quota.copy(), int(n)
    while n > 0:
        total = int(room.sum())
        if n >= total:
            return out + room
        got = np.minimum(rng.multinomial(n, room / total), room)
        out, room, n = out + got, room - got, n - int(got.sum())
    return out


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of [0, size) at index: a four-round Feistel network, walked until it falls inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask, out, todo = (np.uint64(1) << half) - np.uint64(1), index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        x, m, h = out[todo], mask[todo], half[todo]
        left, right = x >> h, x & m
        for turn in ROUNDS:
            left, right = right, left ^ (mix(right + key[todo] + turn) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _sizes(batches):
    for batch in batches:
        n = np.zeros(batch.num_rows, np.int64)
        for first, stop, data, at in chunks(batch.column("text")):
            n[first:stop] = np.bincount(words(data, at)[2], minlength=stop - first)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("th"), pa.array(n)], ["doc_id", "source", "th", "size"])


def _slots(plan: Plan):
    def run(batches):
        for batch in batches:
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for _, first, quota in plan.draws(batch.column(0).to_numpy(zero_copy_only=False)):
                s = np.repeat(np.arange(len(quota)), quota)
                slot = np.arange(len(s)) - np.repeat(np.cumsum(quota) - quota, quota) + np.repeat(first, quota)
                size = plan.blocks[s]
                key = mix((slot // size * len(quota) + s).astype(np.uint64) + np.uint64(plan.seed))
                out.append((s, permuted(slot % size, size, key)))
            s, b = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), pa.array(b.astype(np.int64))], ["s", "block"])

    return run


def sizes_of(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Written table of doc_id, source, th (a hash of the text) and size of every row."""
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), F.xxhash64(text).alias("th"), text.alias("text"))
    return scratch.put("sized", rows.mapInArrow(_sizes, "doc_id long, source string, th long, size long"))


def mixed(sized: DataFrame, scratch: Scratch, seed: int = 1, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """doc_id, th, source, s, size, source_size, target, first (word of its source), of every row that sizes_of gives, and
    the blocks drawn as a second table: s, block, times."""
    spark = sized.sparkSession
    order = [F.col("source").asc_nulls_last(), "doc_id", "th"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.put("dealt", sized.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    own = Window.partitionBy("part", "source").orderBy("doc_id", "th").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("source", "part").agg(F.sum("size").alias("sum"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("sum").over(before), F.lit(0)))

    sources = dealt.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(sources) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sources = sorted(sources, key=lambda r: (r.source is None, r.source or ""))
    size = np.array([r["size"] for r in sources], np.int64)
    goal = targets(size, np.arange(len(size)) % 3 + 1.0)
    blocks = -(-size // block)
    quota = np.minimum(np.rint(np.divide(goal * blocks, size, out=np.zeros(len(size)), where=size > 0)).astype(np.int64), MOST * blocks)
    plan = Plan(quota, np.maximum(1, blocks), seed)
    named = spark.createDataFrame([(r.source, k, int(n), float(g)) for k, (r, n, g) in enumerate(zip(sources, size, goal, strict=True))], "source string, s int, source_size long, target double")

    placed = dealt.withColumn("first", F.coalesce(F.sum("size").over(own), F.lit(0)))
    # A row per range partition and source, a few more than partitions: small whatever the input.
    starts = sums.join(named, sums["source"].eqNullSafe(named["source"])).select(sums["source"].alias("of"), sums["part"].alias("at"), "base", "s", "source_size", "target")
    placed = placed.join(starts, (placed["part"] == starts["at"]) & placed["source"].eqNullSafe(starts["of"]))
    placed = placed.select("doc_id", "th", "source", "s", "size", "source_size", "target", (F.col("first") + F.col("base")).alias("first"))
    drawn = spark.range(0, plan.shards).mapInArrow(_slots(plan), "s int, block long").groupBy("s", "block").agg(F.count(F.lit(1)).alias("times"))
    return scratch.put("placed", placed), drawn


def taken_pieces(placed: DataFrame, drawn: DataFrame, block: int) -> DataFrame:
    """Each document's overlap with each drawn block: doc_id, th, source, at and n (words of the document), times."""
    spread = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("first") + F.col("size") - 1) / block))))
    start = F.greatest(F.col("first"), F.col("block") * block)
    spread = spread.select("doc_id", "th", "source", "s", "block", (start - F.col("first")).alias("at"), (F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * block) - start).alias("n"), "first")
    return spread.join(drawn.hint("merge"), ["s", "block"])  # as many draws as blocks: never to be broadcast


def mix_report(docs: DataFrame, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken.

    Sources in code point order, null last, weigh 1, 2, 3, repeating, and share all sizes; a target stops at three
    times its source's size. taken: words of the document in drawn blocks, repeats counted, at most three times its
    size. Null or empty texts have size 0 and take 0. Rows that repeat a document are each packed; which of two
    identical rows a block holds is arbitrary, as is the order of rows that agree in source, doc_id (null: first) and
    text. The same input and seed give the same draws. An empty table gives no rows; extra columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    placed, drawn = mixed(sizes_of(docs, scratch), scratch, seed, block)
    pieces = taken_pieces(placed, drawn, block)
    taken = pieces.groupBy("s", "first").agg(F.sum(F.col("n") * F.col("times")).alias("taken"))
    out = placed.join(taken, ["s", "first"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """The mix as rows with the columns of docs: copy k of a document (0, 1, 2) has its words whose block is drawn more
    than k times, with n_chars (where docs has it) set anew. A document whose words are all drawn stays as it is; a
    copy without words gives no row. Rows equal in source, doc_id and text count as one, whatever else they hold; null
    doc_ids and sources are values like any other, null or empty texts give no row, and an empty table gives none. Extra
    columns go along as they are; those that begin with __ must not be there. Texts are dealt once, to their pieces;
    what repeats is found on keys and hashes alone.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    key = ["doc_id", "source", "th"]
    once = scratch.put("once", sizes_of(docs, scratch).groupBy(*key).agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("copies")))
    repeated = once.filter("copies > 1").select(*(F.col(c).alias(f"__{c}") for c in key))
    keyed = docs.withColumn("__h", F.xxhash64(F.coalesce(docs["text"], F.lit(""))))
    if not repeated.isEmpty():
        same = keyed["doc_id"].eqNullSafe(repeated["__doc_id"]) & keyed["source"].eqNullSafe(repeated["__source"]) & (keyed["__h"] == repeated["__th"])
        single = keyed.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "source", "__h"])
        keyed = keyed.join(repeated, same, "left_anti").unionByName(single)
    placed, drawn = mixed(once.drop("copies"), scratch, seed, block)
    piece = F.struct("at", "n", "times")
    pieces = taken_pieces(placed, drawn, block).groupBy("doc_id", "th", "source").agg(F.sort_array(F.collect_list(piece)).alias("__pieces"))
    pieces = scratch.put("pieces", pieces)
    met = keyed.join(pieces, keyed["doc_id"].eqNullSafe(pieces["doc_id"]) & keyed["source"].eqNullSafe(pieces["source"]) & (keyed["__h"] == pieces["th"]))
    met = met.select(*(keyed[c] for c in docs.columns), "__pieces")
    names, schema = docs.columns, docs.schema

    def cut(batches):
        for batch in batches:
            at, out_text, out_row = batch.schema.get_field_index("__pieces"), [], []
            for row, (text, pieces) in enumerate(zip(batch.column("text").to_pylist(), batch.column(at).to_pylist(), strict=True)):
                raw = text.encode("utf-8", "surrogatepass")
                begin, end, _ = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                for k in range(MOST):
                    runs: list[list[int]] = []
                    for p in pieces:
                        if p["times"] > k:
                            if runs and runs[-1][1] == p["at"]:
                                runs[-1][1] += p["n"]
                            else:
                                runs.append([p["at"], p["at"] + p["n"]])
                    if runs == [[0, len(begin)]]:
                        out_text.append(text)
                    elif runs:
                        out_text.append(" ".join(raw[begin[a] : end[b - 1]].decode("utf-8", "surrogatepass") for a, b in runs))
                    else:
                        break
                    out_row.append(row)
            part = batch.take(pa.array(out_row, pa.int64()))
            columns = {n: part.column(n) for n in names}
            columns["text"] = pa.array(out_text, columns["text"].type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(t) for t in out_text], pa.int64()).cast(columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return met.mapInArrow(cut, schema)
