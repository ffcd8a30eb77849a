"""Gaps: unextracted runs ranked by how likely they hold content of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import islands, overlap_join
from .states import ORDER


def find_gaps(occurrences: DataFrame, utterances: DataFrame, failed: DataFrame, least_us: int = 2_000_000) -> DataFrame:
    """occurrences: media_id, occ_id, start_us, end_us, content_id (its text hash), state_kind, skipped. failed: occ_id.

    Gives media_id, start_us, end_us, duration_us, members, reason, utterances, speech_chars, neighbours_differ, score.
    A run is failed if any member failed, else not_attempted if any member was, else blank if all are, else skipped;
    short skipped runs are left out.
    """
    w = Window.partitionBy("media_id").orderBy(*ORDER)
    marked = occurrences.join(failed.select("occ_id", F.lit(True).alias("__failed")).distinct(), "occ_id", "left")
    marked = marked.withColumn("__before", F.lag("content_id").over(w)).withColumn("__after", F.lead("content_id").over(w))
    marked = islands(marked, ["media_id"], ORDER, F.col("content_id").isNotNull() | F.col("__before").isNotNull())
    why = F.when(F.col("__failed"), "failed").when(F.col("state_kind") == "blank", "blank").when(F.col("skipped"), "skipped_short").otherwise("not_attempted")
    first = F.struct(*ORDER)
    any_of = lambda reason: F.max((F.col("why") == reason).cast("int")) == 1
    runs = marked.filter("content_id IS NULL").withColumn("why", why).groupBy("media_id", "island").agg(
        F.min("start_us").alias("start_us"),
        F.max_by("end_us", first).alias("end_us"),
        F.count(F.lit(1)).alias("members"),
        F.min_by("__before", first).alias("before"),
        F.max_by("__after", first).alias("after"),
        F.when(any_of("failed"), "failed").when(any_of("not_attempted"), "not_attempted").when(~any_of("skipped_short"), "blank").otherwise("skipped_short").alias("reason"),
    )
    runs = runs.withColumn("duration_us", F.col("end_us") - F.col("start_us")).filter(f"NOT (duration_us < {least_us} AND reason = 'skipped_short')")
    said = overlap_join(runs.select("media_id", "island", "start_us", "end_us"), utterances.select("media_id", F.length("text").alias("chars"), "start_us", "end_us"))
    said = said.groupBy("media_id", "island").agg(F.count(F.lit(1)).alias("utterances"), F.sum("chars").alias("speech_chars"))
    out = runs.join(said, ["media_id", "island"], "left").fillna(0, ["utterances", "speech_chars"])
    out = out.withColumn("neighbours_differ", F.coalesce(F.col("before") != F.col("after"), F.lit(False)))
    score = (
        F.least(F.col("duration_us") / 10_000_000, F.lit(3.0))
        + F.least(F.col("speech_chars") / 500, F.lit(3.0))
        + F.when(F.col("neighbours_differ"), 2.0).otherwise(0.0)
        + F.when(F.col("reason") == "failed", 3.0).when(F.col("reason") == "not_attempted", 1.0).otherwise(0.0)
    )
    out = out.withColumn("score", F.when(F.col("reason") == "blank", 0.0).otherwise(score))
    return out.select("media_id", "start_us", "end_us", "duration_us", "members", "reason", "utterances", "speech_chars", "neighbours_differ", "score")


def gap_summary(gaps: DataFrame) -> DataFrame:
    """Per reason: gaps, their time, how many have speech, how many lie between different contents."""
    return gaps.groupBy("reason").agg(F.count(F.lit(1)).alias("gaps"), F.sum("duration_us").alias("duration_us"), F.count_if(F.col("utterances") > 0).alias("with_speech"), F.count_if("neighbours_differ").alias("neighbours_differ"))


def top_gaps(gaps: DataFrame, n: int = 20) -> DataFrame:
    return gaps.orderBy(F.desc("score"), "start_us", "media_id").limit(n)
