"""Display states: their kind, merging of equal neighbours, bursts, unextracted runs, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import islands

ORDER = ("start_us", "end_us", "occ_id")
#: States up to this long that follow each other, this many or more, are a transition. Fixed values.
BURST_US, BURST_RUN = 400_000, 4


def _timeline() -> Window:
    return Window.partitionBy("media_id").orderBy(*ORDER)


def state_kind(is_blank: Column, duration_us: Column, stable_us: int) -> Column:
    return F.when(is_blank, "blank").when(duration_us < stable_us, "short").otherwise("stable")


def should_extract(kind: Column, duration_us: Column, least_us: int) -> Column:
    return ~kind.isin("blank", "transition") & (duration_us >= least_us)


def merge_equal(occurrences: DataFrame) -> DataFrame:
    """Joins an interval to the one before it if both show the same content and it starts no later than that ends.

    Gives media_id, occ_id and start of the first member, end of the last, content_id, state_kind of the first,
    members and absorbed (members - 1: one change event each). Intervals without content are never merged.
    """
    w = _timeline()
    same = F.col("content_id") == F.lag("content_id").over(w)
    apart = ~(same & (F.col("start_us") <= F.lag("end_us").over(w)))
    numbered = islands(occurrences, ["media_id"], ORDER, apart)
    first, last = F.struct(*ORDER), F.max_by("end_us", F.struct(*ORDER))
    return numbered.groupBy("media_id", "island").agg(
        F.min_by("occ_id", first).alias("occ_id"),
        F.min("start_us").alias("start_us"),
        last.alias("end_us"),
        F.min_by("content_id", first).alias("content_id"),
        F.min_by("state_kind", first).alias("state_kind"),
        F.count(F.lit(1)).alias("members"),
    ).withColumn("absorbed", F.col("members") - 1).drop("island")


def change_events(occurrences: DataFrame) -> DataFrame:
    """One `nontext_change` event per interval that merge_equal absorbs, at its start."""
    w = _timeline()
    absorbed = (F.col("content_id") == F.lag("content_id").over(w)) & (F.col("start_us") <= F.lag("end_us").over(w))
    return occurrences.withColumn("__a", absorbed).filter("__a").select("media_id", "occ_id", "start_us", F.col("start_us").alias("end_us"), F.lit("nontext_change").alias("event_kind"))


def merge_deferred(occurrences: DataFrame) -> DataFrame:
    """Per media, contiguous neighbours of which only the earlier has content."""
    w = _timeline()
    hit = F.lead("content_id").over(w).isNull() & F.col("content_id").isNotNull() & (F.lead("start_us").over(w) <= F.col("end_us"))
    return occurrences.withColumn("__hit", hit).groupBy("media_id").agg(F.count_if(F.coalesce("__hit", F.lit(False))).alias("deferred"))


def unextracted_runs(occurrences: DataFrame) -> DataFrame:
    """Maximal runs of intervals without content: media_id, run, start_us, end_us (of the last member), members."""
    w = _timeline()
    numbered = islands(occurrences, ["media_id"], ORDER, F.col("content_id").isNotNull() | F.lag("content_id").over(w).isNotNull())
    runs = numbered.filter("content_id IS NULL").groupBy("media_id", "island").agg(
        F.min("start_us").alias("start_us"),
        F.max_by("end_us", F.struct(*ORDER)).alias("end_us"),
        F.count(F.lit(1)).alias("members"),
    )
    return runs.withColumn("run", F.row_number().over(Window.partitionBy("media_id").orderBy("island"))).drop("island")


def run_kinds(occurrences: DataFrame) -> DataFrame:
    """Histogram of state kinds over each media's unextracted intervals."""
    return occurrences.filter("content_id IS NULL").groupBy("media_id", "state_kind").agg(F.count(F.lit(1)).alias("n"))


def bursts(states: DataFrame, short_us: int = BURST_US, least: int = BURST_RUN) -> DataFrame:
    """Marks all but the last of a run of `least` or more short states as transition (blank ones too): adds
    new_kind and burst."""
    w = _timeline()
    short = (F.col("end_us") - F.col("start_us")) <= short_us
    marked = states.withColumn("__short", short)
    numbered = islands(marked, ["media_id"], ORDER, ~(F.col("__short") & F.lag("__short").over(w)))
    run = Window.partitionBy("media_id", "island")
    place = F.row_number().over(run.orderBy(*ORDER))
    size = F.count(F.lit(1)).over(run)
    burst = F.col("__short") & (size >= least) & (place < size)
    out = numbered.withColumn("burst", burst)
    return out.withColumn("new_kind", F.when(F.col("burst"), "transition").otherwise(F.col("state_kind"))).drop("__short", "island")


def versions(occurrences: DataFrame) -> DataFrame:
    """The sequence of contents: intervals without content are skipped, equal neighbours count once."""
    shown = occurrences.filter("content_id IS NOT NULL")
    before = F.lag("content_id").over(_timeline())
    return shown.withColumn("__b", before).filter("__b IS NULL OR __b <> content_id").drop("__b")


def flag_merge(a: Column, b: Column, dropped: str) -> Column:
    """Sorted union of two flag arrays; the dropped flag goes from the second only (the first keeps it)."""
    return F.sort_array(F.array_union(a, F.array_except(b, F.array(F.lit(dropped)))))


def coverage_state(content: Column, kind: Column, skipped: Column, failed: Column) -> Column:
    """How an interval counts in the coverage of the screen track."""
    return F.when(content.isNotNull(), "extracted").when(kind == "blank", "blank").when(skipped, "unextracted").when(failed, "failed").otherwise("unextracted")


def inherit_content(states: DataFrame, share: float = 0.15) -> DataFrame:
    """Lets a state keep the content of the one before it where only a small area has changed and that area reads the
    same in both frames. states: media_id, start_us, end_us, occ_id, content_id, change_share, area_before, area_after.

    Adds inherited. A chain of such states has the content of its first member."""
    same = (F.col("change_share") <= share) & F.col("area_before").eqNullSafe(F.col("area_after")) & F.col("area_after").isNotNull()
    chained = islands(states, ["media_id"], ORDER, ~same, "chain")
    first = Window.partitionBy("media_id", "chain").orderBy(*ORDER)
    place = F.row_number().over(first)
    out = chained.withColumn("inherited", place > 1).withColumn("content_id", F.first("content_id").over(first))
    return out.drop("chain")


def merge_unextracted(blocks: DataFrame) -> DataFrame:
    """Neighbouring unextracted blocks as one: media_id, block_index of the first, kind, start_us, end_us, blocks."""
    w = Window.partitionBy("media_id").orderBy("block_index")
    both = (F.col("kind") == "unextracted") & (F.lag("kind").over(w) == "unextracted")
    runs = islands(blocks, ["media_id"], ["block_index"], ~both, "run")
    return runs.groupBy("media_id", "run", "kind").agg(F.min("block_index").alias("block_index"), F.min("start_us").alias("start_us"), F.max_by("end_us", "block_index").alias("end_us"), F.count(F.lit(1)).alias("blocks")).drop("run")


def change_kind(flags: Column, content_id: Column) -> Column:
    """What the first change:* flag of an interval says, else unextracted without a content and first with one."""
    named = F.filter(F.coalesce(flags, F.array().cast("array<string>")), lambda x: x.startswith("change:"))
    return F.coalesce(F.regexp_replace(F.try_element_at(named, F.lit(1)), "^change:", ""), F.when(content_id.isNull(), "unextracted").otherwise("first"))
