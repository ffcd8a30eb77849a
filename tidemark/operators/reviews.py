"""What a run leaves open: review items raised by readings, timelines, sound and terms.

Every function gives target_kind, target_ref, reason, detail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reasons by the flag of a region that raises them. Fixed values.
REGION_REASONS = {
    "unreadable": "vision:unreadable_text",
    "reread_differs_from_full_pass": "vision:reread_mismatch",
    "crop_reread_failed": "vision:crop_reread_failed",
    "crop_reread_empty": "vision:crop_reread_failed",
    "tile_join_unverified": "vision:tile_join_unverified",
}
#: A term said this often and never shown is asked about; so many terms at most. Fixed values.
TERM_TIMES, TERMS = 5, 30


def _item(df: DataFrame, kind: str, ref: Column, reason: Column | str, detail: Column | str = "") -> DataFrame:
    told = [F.lit(x) if isinstance(x, str) else x for x in (reason, detail)]
    return df.select(F.lit(kind).alias("target_kind"), ref.cast("string").alias("target_ref"), told[0].alias("reason"), F.coalesce(told[1].cast("string"), F.lit("")).alias("detail"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def reading_reviews(occurrences: DataFrame, contents: DataFrame, regions: DataFrame) -> DataFrame:
    """Of every display of a content: regions that cannot be read, that a second reading does not bear out or could not
    give, tiles whose seam is not certain; and displays whose reading was cut. regions: content_id, reading_order, flags and
    unreadable (arrays); contents: content_id, flags."""
    shown = occurrences.filter("content_id IS NOT NULL").select("occ_id", "content_id")
    flags = F.array_union(F.coalesce("flags", F.array().cast("array<string>")), F.when(F.size("unreadable") > 0, F.array(F.lit("unreadable"))).otherwise(F.array().cast("array<string>")))
    reasons = F.create_map(*[F.lit(x) for pair in REGION_REASONS.items() for x in pair])
    raised = regions.select("content_id", "reading_order", "unreadable", F.explode(flags).alias("flag")).withColumn("reason", F.try_element_at(reasons, F.col("flag")))
    raised = raised.filter("reason IS NOT NULL").groupBy("content_id", "reading_order", "reason").agg(F.first("unreadable").alias("unreadable"))
    parts = shown.join(raised, "content_id")
    detail = F.when(F.col("reason") == "vision:unreadable_text", F.substring(F.to_json("unreadable"), 1, 1000))
    of_regions = _item(parts, "region", F.concat_ws(":", "occ_id", "reading_order"), F.col("reason"), detail)
    cut = shown.join(contents.filter(F.array_contains("flags", "truncated")).select("content_id"), "content_id")
    return of_regions.unionByName(_item(cut, "occurrence", F.col("occ_id"), "vision:truncated_output"))


def timeline_reviews(checks: DataFrame, media: DataFrame) -> DataFrame:
    """checks: media_id, missing, non_monotonic, gaps (of time stamps). media: media_id, is_vfr."""
    out = [_item(checks.filter(F.col(c) > 0), "media", F.col("media_id"), f"timeline:{reason}", F.col(c)) for c, reason in (("missing", "missing_timestamps"), ("non_monotonic", "non_monotonic_pts"), ("gaps", "pts_gaps"))]
    return _union([*out, _item(media.filter("is_vfr"), "media", F.col("media_id"), "timeline:vfr_suspected")])


def speech_reviews(lengths: DataFrame, chunks: DataFrame, silent: DataFrame) -> DataFrame:
    """lengths: media_id, mismatch, diff_us. chunks: chunk_id, status, detail. silent: utt_id of utterances in silence."""
    late = _item(lengths.filter("mismatch"), "media", F.col("media_id"), "asr:audio_length_mismatch", F.col("diff_us"))
    failed = _item(chunks.filter("status <> 'ok'"), "audio_chunk", F.col("chunk_id"), "asr:chunk_failed", F.col("detail"))
    return _union([late, failed, _item(silent, "utterance", F.col("utt_id"), "asr:utterance_in_silence")])


def term_reviews(unverified: DataFrame) -> DataFrame:
    """unverified: term, n: how often terms are said that no screen shows."""
    top = unverified.orderBy(F.desc("n"), "term").limit(TERMS)  # a report of the most frequent ones
    return _item(top.filter(F.col("n") >= TERM_TIMES), "term", F.col("term"), "asr:terms_not_on_screen", F.col("n"))
