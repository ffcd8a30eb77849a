"""Quality and coverage audits, cache priorities, resumable work."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coverage_by_state(spans: DataFrame) -> DataFrame:
    return spans.groupBy("track", "state").agg(F.sum(F.greatest(F.lit(0).cast("long"), F.col("end_us") - F.col("start_us"))).alias("covered_us"))


def time_anomalies(occurrences: DataFrame, utterances: DataFrame, media: DataFrame, slack_us: int = 1_000_000) -> DataFrame:
    """kind, id, problem: intervals that end before they start, or lie outside their media (utterances: by a second)."""
    def check(df: DataFrame, kind: str, key: str, slack: int) -> DataFrame:
        met = df.join(media, "media_id")
        inverted = met.filter("end_us < start_us").select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.lit("inverted").alias("problem"))
        outside = met.filter((F.col("start_us") < 0) | (F.col("end_us") > F.col("duration_us") + slack)).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.lit("outside").alias("problem"))
        return inverted.unionByName(outside)

    return check(occurrences, "occurrence", "occ_id", 0).unionByName(check(utterances, "utterance", "utt_id", slack_us))


def scorecard(occurrences: DataFrame, utterances: DataFrame, alignment: DataFrame, contents: DataFrame, reviews: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """measure, value: the counts of a quality report, one row each. With regions (content_id, and flags or unreadable if there
    are such), those that cannot be read are counted; with flags in contents, those that were cut."""
    n = F.count(F.lit(1))
    short = F.col("state_kind").isin("short", "transition")
    parts = (
        occurrences.agg(n.alias("occurrences"), F.count("content_id").alias("occurrences_extracted"), F.count_if(F.col("content_id").isNull()).alias("occurrences_unextracted"), F.count_if(short).alias("short_states"), F.count_if(short & F.col("content_id").isNull()).alias("short_states_unextracted")),
        contents.join(occurrences.select("content_id"), "content_id", "left_semi").agg(n.alias("unique_contents")),
        contents.join(occurrences.select("content_id"), "content_id", "left_anti").agg(n.alias("superseded_contents")),
        utterances.agg(n.alias("utterances")),
        utterances.join(alignment.select("utt_id"), "utt_id", "left_anti").agg(n.alias("utterances_unaligned")),
        alignment.agg(n.alias("alignments")),
        reviews.agg(n.alias("reviews_total"), F.count_if(F.col("review_status") == "open").alias("reviews_open")),
    )
    if regions is not None:
        signs = [F.coalesce(F.array_contains("flags", "unreadable"), F.lit(False))] if "flags" in regions.columns else []
        signs += [F.coalesce(F.size("unreadable") > 0, F.lit(False))] if "unreadable" in regions.columns else []
        parts += (regions.agg(F.count_if(F.greatest(F.lit(False), F.lit(False), *signs)).alias("unreadable_regions")),)
    if "flags" in contents.columns:
        parts += (contents.agg(F.count_if(F.coalesce(F.array_contains("flags", "truncated"), F.lit(False))).alias("truncated_contents")),)
    out = None
    for part in parts:
        rows = part.select(F.explode(F.create_map(*[x for c in part.columns for x in (F.lit(c), F.col(c).cast("long"))])).alias("measure", "value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def reviews_by_reason(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def provenance(attempts: DataFrame, keys: list[str]) -> DataFrame:
    return attempts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("created_us").alias("first_us"), F.max("created_us").alias("last_us"))


def timestamp_check(stamps: DataFrame, key: str = "media_id", at: str = "t_us") -> DataFrame:
    """Per key: stamps, non_monotonic (steps of 0 or back), the upper median of positive steps, gaps (steps over three
    medians). stamps: key, at, seq (the order they came in)."""
    step = stamps.withColumn("d", F.col(at) - F.lag(at).over(Window.partitionBy(key).orderBy("seq")))
    ranked = step.withColumn("up", F.when(F.col("d") > 0, F.col("d")))
    place = F.row_number().over(Window.partitionBy(key, F.col("up").isNull()).orderBy("up"))
    of = F.count("up").over(Window.partitionBy(key))
    ranked = ranked.withColumn("place", place).withColumn("of", of)
    middle = ranked.withColumn("median_us", F.max(F.when(F.col("up").isNotNull() & (F.col("place") == F.floor(F.col("of") / 2) + 1), F.col("up"))).over(Window.partitionBy(key)))
    return middle.groupBy(key).agg(F.count(F.lit(1)).alias("stamps"), F.count_if(F.col("d") <= 0).alias("non_monotonic"), F.max("median_us").alias("median_us"), F.count_if(F.col("d") > 3 * F.col("median_us")).alias("gaps"))


def cache_priority(occurrences: DataFrame, reviews: DataFrame, evidence: DataFrame) -> DataFrame:
    """frame_id, priority. evidence: occ_id, frame_id. Open reviews count 100, missing content 50, short states 20."""
    open_ = reviews.filter("review_status = 'open'").select(F.split(F.col("target_ref").cast("string"), ":")[0].alias("occ_ref"), F.lit(100).alias("open")).distinct()
    scored = occurrences.withColumn("occ_ref", F.col("occ_id").cast("string")).join(open_, "occ_ref", "left")
    score = F.coalesce("open", F.lit(0)) + F.when(F.col("content_id").isNull(), 50).otherwise(0) + F.when(F.col("state_kind").isin("short", "transition"), 20).otherwise(0)
    return scored.select("occ_id", score.alias("score")).join(evidence, "occ_id").groupBy("frame_id").agg(F.max("score").alias("priority"))


def evict(frames: DataFrame, excess: int, key: str = "media_id") -> DataFrame:
    """Frames to delete, cheapest first, until `excess` bytes of each key are freed. frames: key, frame_id, priority,
    t_us, bytes."""
    w = Window.partitionBy(key).orderBy("priority", "t_us", "frame_id").rowsBetween(Window.unboundedPreceding, -1)
    return frames.withColumn("freed_before", F.coalesce(F.sum("bytes").over(w), F.lit(0))).filter(F.col("freed_before") < excess)


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work whose key has no finished result."""
    return work.join(done.select(key), key, "left_anti")


def cache_misses(requests: DataFrame, cache: DataFrame, parts: list[str]) -> DataFrame:
    """Requests with cache_key, for which the cache has no entry."""
    keyed = requests.withColumn("cache_key", cache_key(parts))
    return keyed.join(cache.select("cache_key"), "cache_key", "left_anti")


def cache_key(parts: list[str]):
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(p).cast("string"), F.lit("\x00")) for p in parts]), 256)
