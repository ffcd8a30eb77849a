"""Alignment of display intervals and utterances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import overlap_join

ORDER = ("start_us", "end_us", "occ_id")


def align(occurrences: DataFrame, utterances: DataFrame, bucket_us: int | None = None) -> DataFrame:
    """media_id, occ_id, utt_id, overlap_us, is_primary: all overlapping pairs; an utterance's primary pair has the
    largest overlap, then the earliest interval, then the smallest occ_id."""
    pairs = overlap_join(
        occurrences.select("media_id", "occ_id", "start_us", "end_us"),
        utterances.select("media_id", "utt_id", "start_us", "end_us"),
        bucket_us=bucket_us,
    )
    best = Window.partitionBy("media_id", "utt_id").orderBy(F.desc("overlap_us"), "l_start_us", "l_end_us", "occ_id")
    return pairs.select("media_id", "occ_id", "utt_id", "overlap_us", (F.row_number().over(best) == 1).alias("is_primary"))


def orphans(utterances: DataFrame, alignment: DataFrame) -> DataFrame:
    """Utterances that overlap no display interval."""
    return utterances.join(alignment.select("media_id", "utt_id"), ["media_id", "utt_id"], "left_anti")


def silent(occurrences: DataFrame, alignment: DataFrame) -> DataFrame:
    """Display intervals without speech."""
    return occurrences.join(alignment.select("media_id", "occ_id"), ["media_id", "occ_id"], "left_anti")


def alignment_table(occurrences: DataFrame, alignment: DataFrame, utterances: DataFrame) -> DataFrame:
    """One row per pair, and one with null utterance columns per silent interval."""
    said = utterances.select("media_id", "utt_id", F.col("start_us").alias("utt_start_us"), F.col("end_us").alias("utt_end_us"), "text")
    pairs = alignment.join(said, ["media_id", "utt_id"])
    return occurrences.join(pairs, ["media_id", "occ_id"], "left")


def utterance_refs(utterances: DataFrame, alignment: DataFrame) -> DataFrame:
    """Every utterance with its intervals (sorted ids) and the primary one."""
    refs = alignment.groupBy("media_id", "utt_id").agg(
        F.sort_array(F.collect_list("occ_id")).alias("occ_ids"),
        F.max(F.when(F.col("is_primary"), F.col("occ_id"))).alias("primary_occ_id"),
    )
    return utterances.join(refs, ["media_id", "utt_id"], "left")


def align_stats(occurrences: DataFrame, utterances: DataFrame, alignment: DataFrame) -> DataFrame:
    """One row of counts."""
    pairs = alignment.agg(F.count(F.lit(1)).alias("alignments"), F.count_if("is_primary").alias("primaries"), F.count_distinct("utt_id").alias("aligned_utterances"), F.count_distinct("occ_id").alias("spoken_occurrences"))
    n_utt, n_occ = utterances.agg(F.count(F.lit(1)).alias("utterances")), occurrences.agg(F.count(F.lit(1)).alias("occurrences"))
    one = pairs.crossJoin(n_utt).crossJoin(n_occ)  # three tables of one row
    return one.select("occurrences", "utterances", "alignments", "primaries", (F.col("utterances") - F.col("aligned_utterances")).alias("orphans"), (F.col("occurrences") - F.col("spoken_occurrences")).alias("silent"))
