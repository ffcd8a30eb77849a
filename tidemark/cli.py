"""Commands over a folder of Parquet tables (occurrences, utterances, media, contents, reviews, regions; see README)."""

from __future__ import annotations

import argparse
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.timecode import format_timestamp
from .operators import alignment, blocks, contents, gaps, intervals, lecture, quality, render, states, store
from .session import ship
from .sources import readers


def tables(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{folder}/{n}") for n in names]


def run_gaps(spark: SparkSession, folder: str, top: int, least_s: float, out: str | None) -> list[dict]:
    occ, utt, reviews = tables(spark, folder, "occurrences", "utterances", "reviews")
    failed = reviews.filter("reason = 'vision:extraction_failed'").select(F.col("target_ref").cast("long").alias("occ_id"))
    found = gaps.find_gaps(occ.withColumn("skipped", F.coalesce(F.array_contains("flags", "short_or_transition"), F.lit(False))), utt, failed, round(least_s * 1_000_000))
    found = found.withColumn("start", format_timestamp("start_us")).withColumn("end", format_timestamp("end_us")).withColumn("score", F.bround("score", 3))
    if out:
        render.write_lines(found, out, ["start_us"])
    return [r.asDict() for r in gaps.top_gaps(found, top).collect()]


def run_export(spark: SparkSession, folder: str, out: str) -> None:
    """blocks, contents, occurrences, utterances, alignment as JSON lines; subtitles and reading documents as text."""
    occ, utt, body, media, region = tables(spark, folder, "occurrences", "utterances", "contents", "media", "regions")
    al = alignment.align(occ, utt)
    members = blocks.block_members(occ, body)
    block_rows = blocks.blocks(members).join(blocks.block_refs(members, al, occ), ["media_id", "block_index"], "left")
    for name, rows, order in (
        ("blocks", block_rows, ["block_index"]),
        ("screen_occurrences", occ, ["start_us", "end_us"]),
        ("utterances", render.utterance_rows(utt, al), ["start_us", "end_us"]),
        ("alignment_table", alignment.alignment_table(occ, al, utt), ["start_us", "end_us"]),
    ):
        render.write_lines(rows, f"{out}/{name}.jsonl", order)
    contents.referenced(body, occ).write.mode("overwrite").json(f"{out}/screen_contents.jsonl")
    coded = body.withColumn("is_code", F.col("screen_kind") == "code")
    record = lecture.lecture_lines(members, occ, body, region, utt, al, media)
    for name, texts in (("transcript.srt", render.srt(utt)), ("material.md", render.documents(lecture.material_lines(members, occ, coded, utt, al))), ("lecture.md", render.documents(record))):
        texts.select("media_id", F.col("text").alias("value")).write.mode("overwrite").partitionBy("media_id").text(f"{out}/{name}")


def run_report(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the quality report: counts, coverage, reviews, what lies outside its media, unextracted states, measures."""
    occ, utt, media, body, reviews, region = tables(spark, folder, "occurrences", "utterances", "media", "contents", "reviews", "regions")
    al = alignment.align(occ, utt)
    spans = occ.select("media_id", "start_us", "end_us", F.when(F.col("content_id").isNotNull(), "extracted").otherwise("unextracted").alias("state"))
    coverage = quality.coverage_by_state(intervals.filled(spans, media).withColumn("track", F.lit("screen")))
    sections = [
        ("Counts", quality.scorecard(occ, utt, al, body, reviews, region)),
        ("Coverage", coverage.select("track", "state", "covered_us")),
        ("Reviews", quality.reviews_by_reason(reviews).select("reason", "n")),
        ("Time anomalies", quality.time_anomalies(occ, utt, media)),
        ("Unextracted states", states.run_kinds(occ)),
    ]
    try:
        (metrics,) = tables(spark, folder, "metrics")
    except AnalysisException:
        return render.report_lines("Quality report", sections)
    return render.report_lines("Quality report", [*sections, ("Measures", store.shown_metrics(metrics))])


def run_correct(spark: SparkSession, folder: str, content_id: str, reading_order: int, text: str, out: str) -> None:
    """The corrected regions, the bodies that follow from them, and the log of corrections, as new tables under out."""
    (region,) = tables(spark, folder, "regions")
    log = spark.createDataFrame([], "content_id string, reading_order int, original string, corrected string")
    region = region.withColumn("flags", F.coalesce("flags", F.array().cast("array<string>"))) if "flags" in region.columns else region.withColumn("flags", F.array().cast("array<string>"))
    fixed, log = store.correct_region(region, log, content_id, reading_order, text)
    for name, df in (("regions", fixed), ("bodies", contents.bodies(fixed)), ("corrections", log)):
        df.write.mode("overwrite").parquet(f"{out}/{name}")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    top = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    p = commands.add_parser("gaps", help="spans most worth another reading")
    p.add_argument("folder")
    p.add_argument("--top", type=int, default=20)
    p.add_argument("--min-duration", type=float, default=2.0, metavar="SECONDS")
    p.add_argument("--jsonl")
    p = commands.add_parser("export", help="write all outputs again")
    p.add_argument("folder")
    p.add_argument("out")
    p = commands.add_parser("report", help="quality report as Markdown")
    p.add_argument("folder")
    p = commands.add_parser("resolve", help="set the status of a review; writes a new table")
    p.add_argument("folder")
    p.add_argument("review_id")
    p.add_argument("out")
    p.add_argument("--status", default="resolved", choices=["open", "resolved", "wontfix"])
    p = commands.add_parser("status", help="counts of a run")
    p.add_argument("folder")
    p = commands.add_parser("review", help="open reviews, by the start of their reason")
    p.add_argument("folder")
    p.add_argument("--reason", default="")
    p = commands.add_parser("correct", help="correct the text of a region; writes new tables")
    p.add_argument("folder")
    p.add_argument("content_id")
    p.add_argument("reading_order", type=int)
    p.add_argument("text")
    p.add_argument("out")
    p = commands.add_parser("cache", help="frames to delete, cheapest first, to free so many bytes of each media; writes a table")
    p.add_argument("folder")
    p.add_argument("excess", type=int)
    p.add_argument("out")
    p = commands.add_parser("probe", help="facts of media from a table of probe documents (column probe_json); writes a table")
    p.add_argument("folder")
    p.add_argument("out")
    a = top.parse_args(argv)
    spark = ship(spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate())
    if a.command == "gaps":
        for row in run_gaps(spark, a.folder, a.top, a.min_duration, a.jsonl):
            print(json.dumps(row, ensure_ascii=False))
    elif a.command == "export":
        run_export(spark, a.folder, a.out)
    elif a.command == "report":
        for row in run_report(spark, a.folder).toLocalIterator():
            print(row.line)
    elif a.command == "status":
        print(json.dumps(store.status_counts(*tables(spark, a.folder, "occurrences", "utterances", "reviews")).first().asDict()))
    elif a.command == "review":
        (reviews,) = tables(spark, a.folder, "reviews")
        for row in reviews.filter((F.col("review_status") == "open") & F.col("reason").startswith(a.reason)).orderBy("reason", "review_id").toLocalIterator():
            print(json.dumps(row.asDict(), ensure_ascii=False))
    elif a.command == "correct":
        run_correct(spark, a.folder, a.content_id, a.reading_order, a.text, a.out)
    elif a.command == "cache":
        (frames,) = tables(spark, a.folder, "frames")
        quality.evict(frames, a.excess).write.mode("overwrite").parquet(a.out)
    elif a.command == "probe":
        (documents,) = tables(spark, a.folder, "probes")
        readers.probe(documents).write.mode("overwrite").parquet(a.out)
    else:
        (reviews,) = tables(spark, a.folder, "reviews")
        store.resolve_review(reviews, a.review_id, a.status).write.mode("overwrite").parquet(a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
