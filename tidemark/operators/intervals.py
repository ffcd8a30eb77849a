"""Joins and set operations on half-open microsecond intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timecode import overlap_us

KEY = "media_id"


#: Buckets are so many mean lengths wide, so that spreading adds a quarter of the rows at most on average.
LENGTHS = 4


def bucket_width(left: DataFrame, right: DataFrame, least_us: int = 1_000_000) -> DataFrame:
    """One row, __w: a bucket width for the intervals of both sides (start_us, end_us)."""
    both = left.select("start_us", "end_us").unionByName(right.select("start_us", "end_us")).filter("end_us > start_us")
    mean = F.coalesce(F.avg(F.col("end_us") - F.col("start_us")), F.lit(0.0))
    return both.agg(F.greatest(F.lit(least_us).cast("long"), F.ceil(mean * LENGTHS).cast("long")).alias("__w"))


def _spread(df: DataFrame, start: Column, end: Column, name: str, width: DataFrame | int) -> DataFrame:
    """A row per bucket that the interval touches (none where it is empty); the width goes along as __w."""
    df = df.withColumn("__w", F.lit(width).cast("long")) if isinstance(width, int) else df.crossJoin(F.broadcast(width))  # one row
    return df.filter(end > start).withColumn(name, F.explode(F.sequence(F.floor(start / F.col("__w")), F.floor((end - 1) / F.col("__w")))))


def overlap_join(left: DataFrame, right: DataFrame, how: str = "inner", bucket_us: int | None = None, pad_us: int = 0, key: str = KEY) -> DataFrame:
    """Pairs of left and right intervals of one key whose overlap is positive, with `overlap_us`.

    Columns start_us and end_us of each side become l_start_us, l_end_us, r_start_us, r_end_us; other columns must
    differ. pad_us widens the right side. Both sides are spread over time buckets (bucket_us wide; None: sized from the
    mean length; 0: none, for keys of few intervals), and each pair comes from the one bucket that holds its later start:
    a key that dominates is dealt over many tasks, and only neighbours in time meet. Zero-length intervals overlap
    nothing. how: inner, or left (left intervals without a pair come once, with nulls).
    """
    a = left.withColumnsRenamed({"start_us": "l_start_us", "end_us": "l_end_us"})
    b = right.withColumnsRenamed({"start_us": "r_start_us", "end_us": "r_end_us", key: "__key"})
    low, high = F.col("r_start_us") - pad_us, F.col("r_end_us") + pad_us
    shared = overlap_us("l_start_us", "l_end_us", low, high)
    on = F.col(key) == F.col("__key")
    if bucket_us == 0:
        met = a.join(b, on & (shared > 0), how)
        return met.withColumn("overlap_us", F.when(F.col("__key").isNotNull(), shared)).drop("__key")
    width = bucket_us or bucket_width(left, right)
    l_start, l_end = F.col("l_start_us"), F.col("l_end_us")
    near = _spread(a, l_start, l_end, "__a", width)
    far = _spread(b, low, high, "__b", width).drop("__w")
    later = F.floor(F.greatest(l_start, low) / F.col("__w"))
    met = near.join(far, on & (F.col("__a") == F.col("__b")) & (later == F.col("__a")) & (shared > 0)).withColumn("overlap_us", shared).drop("__key", "__a", "__b", "__w")
    if how == "inner":
        return met
    if how != "left":
        raise ValueError(how)
    paired = met.select(*[F.col(c).alias(f"__p{i}") for i, c in enumerate(a.columns)]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"__p{i}")) for i, c in enumerate(a.columns)]
    alone = a.join(paired, on=[F.col(key) == F.col(f"__p{a.columns.index(key)}"), *same], how="left_anti")
    return met.unionByName(alone, allowMissingColumns=True)


def containment_join(outer: DataFrame, inner: DataFrame, key: str = KEY, bucket_us: int | None = None) -> DataFrame:
    """Pairs whose inner interval lies inside the outer one, empty inner intervals included.

    The outer side is spread over time buckets as in overlap_join; an inner interval is looked up in the bucket of its start.
    """
    width = bucket_us or bucket_width(outer, inner)
    a = outer.withColumnsRenamed({"start_us": "l_start_us", "end_us": "l_end_us"})
    b = inner.withColumnsRenamed({"start_us": "r_start_us", "end_us": "r_end_us", key: "__key"})
    a = _spread(a, F.col("l_start_us"), F.col("l_end_us") + 1, "__a", width)
    inside = (F.col("r_start_us") >= F.col("l_start_us")) & (F.col("r_end_us") <= F.col("l_end_us")) & (F.col("r_start_us") <= F.col("l_end_us"))
    b = b.withColumn("__w", F.lit(width).cast("long")) if isinstance(width, int) else b.crossJoin(F.broadcast(width))
    b = b.withColumn("__b", F.floor(F.col("r_start_us") / F.col("__w"))).drop("__w")
    return a.join(b, (F.col(key) == F.col("__key")) & (F.col("__a") == F.col("__b")) & inside).drop("__key", "__a", "__b", "__w")


def uncovered(spans: DataFrame, whole: DataFrame, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """What the spans leave uncovered of [0, duration_us) of each row of `whole`: keys, start_us, end_us."""
    keys = list(keys)
    reach = Window.partitionBy(*keys).orderBy("start_us", "end_us").rowsBetween(Window.unboundedPreceding, -1)
    cursor = F.greatest(F.lit(0).cast("long"), F.coalesce(F.max("end_us").over(reach), F.lit(0).cast("long")))
    before = spans.select(*keys, cursor.alias("from_us"), F.col("start_us").alias("to_us")).filter("to_us > from_us")
    ends = spans.groupBy(*keys).agg(F.max("end_us").alias("reach_us"))
    tail = whole.join(ends, keys, "left").select(*keys, F.greatest(F.lit(0).cast("long"), F.coalesce("reach_us", F.lit(0).cast("long"))).alias("from_us"), F.col("duration_us").alias("to_us")).filter("to_us > from_us")
    return before.unionByName(tail).withColumnsRenamed({"from_us": "start_us", "to_us": "end_us"})


def filled(spans: DataFrame, whole: DataFrame, state: Column | str = "unextracted", keys: Sequence[str] = (KEY,)) -> DataFrame:
    """The spans (keys, start_us, end_us, state) and fillers of `state` wherever none lies."""
    state = F.lit(state) if isinstance(state, str) else state
    own = spans.select(*keys, "start_us", "end_us", "state")
    return own.unionByName(uncovered(spans, whole, keys).withColumn("state", state))


def clipped(df: DataFrame, start_us: int, end_us: int, duration: str = "duration_us") -> DataFrame:
    """The analysis range of each row: [max(0, start), min(duration, end)); rows where it is empty are left out."""
    out = df.withColumn("range_start_us", F.greatest(F.lit(0).cast("long"), F.lit(start_us).cast("long"))).withColumn("range_end_us", F.least(F.col(duration), F.lit(end_us).cast("long")))
    return out.filter("range_end_us > range_start_us")


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], breaks: Column, name: str = "island") -> DataFrame:
    """Numbers maximal runs of rows: a row for which `breaks` holds (or is null) begins a new one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("__break", F.when(~F.coalesce(breaks, F.lit(True)), 0).otherwise(1))
    return marked.withColumn(name, F.sum("__break").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__break")
