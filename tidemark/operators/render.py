"""Outputs: cues, JSON rows, review rows, Markdown documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import escape_markdown, fence
from ..functions.timecode import format_srt, format_timestamp

#: Shortest time that a cue is shown. Fixed value.
CUE_US = 1000


def srt_cues(utterances: DataFrame) -> DataFrame:
    """media_id, cue (from 1), utt_id, block: one subtitle block per utterance in order of time."""
    w = Window.partitionBy("media_id").orderBy("start_us", "end_us", "utt_id")
    cue = F.row_number().over(w)
    end = F.greatest(F.col("end_us"), F.col("start_us") + CUE_US)
    said = F.trim(F.regexp_replace("text", r"\r\n|\r|\n", " "))
    return utterances.withColumn("cue", cue).select("media_id", "cue", "utt_id", F.concat(F.col("cue").cast("string"), F.lit("\n"), format_srt("start_us"), F.lit(" --> "), format_srt(end), F.lit("\n"), said, F.lit("\n")).alias("block"))


def documents(lines: DataFrame, key: str = "media_id") -> DataFrame:
    """lines: key, ord (array or struct that sorts), line. One text per key, its lines in order."""
    return lines.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ord", "line"))).alias("own")).select(key, F.array_join(F.transform("own", lambda x: x["line"]), "\n").alias("text"))


def srt(utterances: DataFrame) -> DataFrame:
    """media_id, text: the subtitle file of each media."""
    return documents(srt_cues(utterances).select("media_id", F.col("cue").alias("ord"), F.col("block").alias("line")))


def utterance_rows(utterances: DataFrame, alignment: DataFrame) -> DataFrame:
    refs = alignment.groupBy("utt_id").agg(F.sort_array(F.collect_list("occ_id")).alias("occ_ids"))
    out = utterances.join(refs, "utt_id", "left")
    return out.select("media_id", "utt_id", "start_us", "end_us", format_timestamp("start_us").alias("start"), format_timestamp("end_us").alias("end"), "text", F.coalesce("occ_ids", F.array().cast("array<bigint>")).alias("occ_ids"))


def json_lines(rows: DataFrame) -> DataFrame:
    """media_id, value: each row as a JSON object, nulls kept."""
    return rows.select("media_id", F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_lines(rows: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines under path, one folder per media, rows of a media in order."""
    dealt = rows.repartition("media_id").sortWithinPartitions("media_id", *order)
    json_lines(dealt).write.mode("overwrite").partitionBy("media_id").text(path)


def review_items(occurrences: DataFrame, utterances: DataFrame, media: DataFrame) -> DataFrame:
    """target_kind, target_ref, reason: open questions that the timeline itself raises."""
    occ = occurrences.join(media, "media_id")
    utt = utterances.join(media, "media_id")
    late = occ.filter("end_us > duration_us").select(F.lit("occurrence").alias("target_kind"), F.col("occ_id").cast("string").alias("target_ref"), F.lit("timeline:outside").alias("reason"))
    unread = occ.filter("content_id IS NULL AND state_kind = 'stable'").select(F.lit("occurrence"), F.col("occ_id").cast("string"), F.lit("vision:not_extracted"))
    empty = utt.filter("end_us <= start_us").select(F.lit("utterance"), F.col("utt_id").cast("string"), F.lit("asr:empty_interval"))
    return late.union(unread).union(empty)


def report_lines(title: str, sections: list[tuple[str, DataFrame]]) -> DataFrame:
    """ord, line: a Markdown report of whole tables, one row a line; written in order, none is left out. Rows of a table are
    in the order of its columns."""
    spark = sections[0][1].sparkSession
    out = spark.createDataFrame([([0, 0], f"# {title}", [""])], "ord array<bigint>, line string, row array<string>")
    for k, (name, rows) in enumerate(sections):
        head = f"\n## {name}\n\n| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
        cells = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns])
        table = rows.select(F.array(F.lit(k + 1), F.lit(1)).cast("array<bigint>").alias("ord"), F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |")).alias("line"), cells.alias("row"))
        out = out.unionByName(spark.createDataFrame([([k + 1, 0], head, [""])], out.schema)).unionByName(table)
    return out.orderBy("ord", "row").select("ord", "line")


def outline_lines(terms: DataFrame, versions: DataFrame, contents: DataFrame) -> DataFrame:
    """Lines of a study outline per media: each content version with its time and title, then the index of its own terms.
    Columns: media_id, ord, line. terms: as terms.index gives them; with a media_id, each media has its own."""
    shown = versions.join(contents.select("content_id", "title"), "content_id", "left")
    line = F.concat(F.lit("- "), format_timestamp("start_us"), F.lit(" "), escape_markdown(F.coalesce("title", F.lit(""))))
    rows = shown.select("media_id", F.array(F.lit(0).cast("long"), F.col("start_us"), F.col("occ_id").cast("long")).alias("ord"), line.alias("line"))
    own = "media_id" in terms.columns
    w = Window.partitionBy(*["media_id"] * own).orderBy(F.desc(F.col("shown") + F.col("said")), "term")  # without media, a bounded list
    term = F.concat(F.lit("- "), escape_markdown(F.col("surface")), F.lit(": "), F.col("shown").cast("string"), F.lit(" / "), F.col("said").cast("string"), F.lit(" ("), format_timestamp("first_us"), F.lit(")"))
    index = terms.withColumn("n", F.row_number().over(w).cast("long")).select(*["media_id"] * own, F.array(F.lit(1).cast("long"), F.col("n"), F.lit(0).cast("long")).alias("ord"), term.alias("line"))
    if not own:
        index = versions.select("media_id").distinct().crossJoin(F.broadcast(index))
    return rows.unionByName(index)


def structure_note(note: F.Column, source: F.Column, target: F.Column, direction: F.Column, group: F.Column) -> F.Column:
    """A reading of a figure as quoted lines; '' where the note is blank."""
    arrow = F.when(direction == "one_way", "→").when(direction == "two_way", "↔").when(direction == "none", "—").otherwise("-")
    parts = F.array(
        F.concat(F.lit("> "), escape_markdown(note)),
        F.when((source != "") & (target != ""), F.concat(F.lit("> "), escape_markdown(source), F.lit(" "), arrow, F.lit(" "), escape_markdown(target))),
        F.when(F.size(group) > 0, F.concat(F.lit("> "), escape_markdown(F.array_join(F.slice(group, 1, 8), ", ")))),
    )
    return F.when(F.trim(F.coalesce(note, F.lit(""))) == "", "").otherwise(F.array_join(F.filter(parts, lambda x: x.isNotNull()), "\n"))
