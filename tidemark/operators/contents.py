"""Screen contents: body, signature, heading, duplicates, quality notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT, RECORD, GROUP = "\x1f", "\x1e", "\x1d"
#: Flags that a reader is told of, in the words of the note.
FLAG_NOTES = {
    "truncated": "The model's output was cut at its length limit; the text may be incomplete.",
    "tile_join_unverified": "Parts that were read separately could not be matched where they meet.",
    "fallback_split_read": "The whole screen could not be read; this was read in parts.",
    "unreadable": "Some characters cannot be read. They are not guessed.",
    "possible_duplicate_regions": "Some regions are much alike; one area may have been read twice.",
    "low_resolution": "The resolution is too low to be sure of the characters.",
    "not_extracted": "Some regions have not been read.",
}


def bodies(regions: DataFrame) -> DataFrame:
    """Per content: body_text (body regions in reading order, a blank line between) and n_regions."""
    piece = F.when(F.col("role") == "material_body", F.struct("reading_order", "text"))
    packed = regions.groupBy("content_id").agg(F.sort_array(F.collect_list(piece)).alias("parts"), F.count(F.lit(1)).alias("n_regions"))
    return packed.select("content_id", F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n").alias("body_text"), "n_regions")


#: Roles of regions by the list that they are shown in. Fixed values.
ROLE_LISTS = {"body": ("material_body",), "context": ("material_context",), "other": ("application_ui", "other_screen_text"), "captions": ("burned_caption",)}


def role_lists(regions: DataFrame) -> DataFrame:
    """Per content the texts of its regions in reading order, by what they are for: body, context, other, captions."""
    own = F.sort_array(F.collect_list(F.struct("reading_order", "role", "text")))
    packed = regions.groupBy("content_id").agg(own.alias("own"))
    texts = lambda roles: F.transform(F.filter("own", lambda r: r["role"].isin(*roles)), lambda r: r["text"])
    return packed.select("content_id", *[texts(roles).alias(name) for name, roles in ROLE_LISTS.items()])


def signatures(regions: DataFrame, key: Column) -> DataFrame:
    """Per content: text_hash over kinds and keys of body and context regions in reading order.

    key: the comparison key of a region's text. screen_kind is a column of regions."""
    told = regions.filter(F.col("role").isin("material_body", "material_context"))
    piece = F.struct("reading_order", F.concat_ws(UNIT, "kind", key).alias("piece"))
    packed = told.groupBy("content_id", "screen_kind").agg(F.sort_array(F.collect_list(piece)).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: p["piece"]), RECORD)
    return packed.select("content_id", F.sha2(F.concat_ws(GROUP, "screen_kind", joined), 256).alias("text_hash"))


def headings(regions: DataFrame) -> DataFrame:
    """Per content: first line of its first heading that has text."""
    titled = regions.filter((F.col("kind") == "heading") & (F.trim("text") != ""))
    return titled.groupBy("content_id").agg(F.min_by(F.split(F.trim("text"), "\n")[0], "reading_order").alias("heading"))


def dedup_contents(contents: DataFrame) -> DataFrame:
    """Of contents with one text_hash, the first by content_id, with its own flags."""
    w = Window.partitionBy("text_hash").orderBy("content_id")
    return contents.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def referenced(contents: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Contents that some interval shows."""
    return contents.join(occurrences.select("content_id").filter("content_id IS NOT NULL"), "content_id", "left_semi")


def superseded(contents: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Contents that no interval shows any more."""
    return contents.join(occurrences.select("content_id").filter("content_id IS NOT NULL"), "content_id", "left_anti")


def quality_notes(flags: DataFrame) -> DataFrame:
    """flags: unit, content_id, flag. Per unit and flag that readers are told of: up to three content ids."""
    told = flags.filter(F.col("flag").isin(list(FLAG_NOTES))).select("unit", "flag", "content_id").distinct()
    note = F.create_map(*[F.lit(x) for pair in FLAG_NOTES.items() for x in pair])
    packed = told.groupBy("unit", "flag").agg(F.sort_array(F.collect_set("content_id")).alias("ids"))
    return packed.select("unit", "flag", F.try_element_at(note, F.col("flag")).alias("note"), F.array_join(F.slice("ids", 1, 3), ", ").alias("content_ids"))


def top_regions(regions: DataFrame, k: int = 3) -> DataFrame:
    """Regions to read again: uncertain ones first, then the largest; k of each content. regions: uncertain, area."""
    w = Window.partitionBy("content_id").orderBy(F.desc("uncertain"), F.desc("area"), "reading_order")
    return regions.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
