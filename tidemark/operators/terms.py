"""Terms: the screen's vocabulary, what speech confirms, the term index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import COMMON, SPOKEN_TERM, TECHNICAL, index_terms, shown_words, substring_count
from .intervals import overlap_join

#: Time around an utterance within which a screen confirms its terms. Fixed value.
NEARBY_US = 120_000_000


def screen_terms(occurrences: DataFrame, contents: DataFrame) -> DataFrame:
    """media_id, start_us, end_us, term: words shown, by interval. contents: content_id, body_text."""
    words = contents.select("content_id", F.explode(shown_words(F.col("body_text"))).alias("term"))
    return occurrences.filter("content_id IS NOT NULL").select("media_id", "content_id", "start_us", "end_us").join(words, "content_id").drop("content_id")


def spoken(utterances: DataFrame) -> DataFrame:
    """utterance and each distinct lower-cased candidate term, with whether any of its forms is technical."""
    found = utterances.withColumn("form", F.explode(F.regexp_extract_all("text", F.lit(f"({SPOKEN_TERM})"), 1)))
    found = found.withColumn("term", F.lower("form")).filter(~F.col("term").isin(COMMON))
    return found.groupBy("media_id", "utt_id", "start_us", "end_us", "term").agg(F.max(F.col("form").rlike(TECHNICAL)).alias("technical"))


def near_contents(shows: DataFrame, utterances: DataFrame) -> DataFrame:
    """media_id, utt_id, content_id: what a screen shows within two minutes of an utterance, each once. Intervals meet by
    time before their words are looked up, so each travels once and not once a word."""
    pairs = overlap_join(shows.select("media_id", "content_id", "start_us", "end_us"), utterances.select("media_id", "utt_id", "start_us", "end_us"), pad_us=NEARBY_US)
    return pairs.select("media_id", "utt_id", "content_id").distinct()


def match_shown(utterances: DataFrame, occurrences: DataFrame, contents: DataFrame) -> DataFrame:
    """match_terms of the words of contents (content_id, body_text) that the occurrences show."""
    words = contents.select("content_id", F.explode(shown_words(F.col("body_text"))).alias("term"))
    return _matched(utterances, occurrences.filter("content_id IS NOT NULL"), words)


def match_terms(utterances: DataFrame, shown: DataFrame) -> DataFrame:
    """media_id, utt_id, term, verdict: confirmed (on screen within two minutes), elsewhere (on screen at other times
    of the media), or not_found. Only technical terms and words that the screen has are matched."""
    return _matched(utterances, shown.withColumnRenamed("term", "content_id"), shown.select(F.col("term").alias("content_id"), "term").distinct())


def _matched(utterances: DataFrame, shows: DataFrame, words: DataFrame) -> DataFrame:
    said = spoken(utterances)
    talk = said.select("media_id", "utt_id", "start_us", "end_us").distinct()
    words = words.join(said.select("term").distinct(), "term", "left_semi")
    there = shows.select("media_id", "content_id").distinct().join(talk.select("media_id").distinct(), "media_id", "left_semi")
    vocabulary = there.join(words, "content_id").select("media_id", "term", F.lit(True).alias("known")).distinct()
    close = near_contents(shows, talk).join(words, "content_id").select("media_id", "utt_id", "term", F.lit(True).alias("close")).distinct()
    told = said.join(vocabulary, ["media_id", "term"], "left").join(close, ["media_id", "utt_id", "term"], "left")
    told = told.withColumn("known", F.coalesce("known", F.lit(False))).filter("technical OR known")
    return told.select("media_id", "utt_id", "term", F.when(F.col("close"), "confirmed").when(F.col("known"), "elsewhere").otherwise("not_found").alias("verdict"))


def unverified_terms(matches: DataFrame, top: int = 30, least: int = 5) -> DataFrame:
    """Terms that the screen never shows, by the utterances that have them."""
    counted = matches.filter("verdict = 'not_found'").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "term").limit(top).filter(F.col("n") >= least)


def term_index(occurrences: DataFrame, contents: DataFrame, utterances: DataFrame, top: int = 300) -> DataFrame:
    """term, surface (its commonest form, then the lowest), shown (intervals), said (times in speech), first_us.

    Of the `top` terms most shown (then lowest), those that speech has at all. All speech counts, in any media."""
    forms = contents.select("content_id", F.explode(index_terms(F.col("body_text"))).alias("form"))
    seen = occurrences.filter("content_id IS NOT NULL").join(forms, "content_id").withColumn("term", F.lower("form"))
    by_form = seen.groupBy("term", "form").agg(F.count(F.lit(1)).alias("n"), F.min("start_us").alias("first_us"))
    w = Window.partitionBy("term").orderBy(F.desc("n"), "form")
    by_form = by_form.withColumn("rank", F.row_number().over(w))
    terms = by_form.groupBy("term").agg(F.sum("n").alias("shown"), F.min("first_us").alias("first_us"), F.max(F.when(F.col("rank") == 1, F.col("form"))).alias("surface"))
    terms = terms.orderBy(F.desc("shown"), "term").limit(top)
    # At most `top` terms, so each utterance counts them in place and only the counts are dealt out.
    listed = terms.agg(F.sort_array(F.collect_list("term")).alias("terms"))
    counts = utterances.select(F.lower("text").alias("text")).crossJoin(F.broadcast(listed))
    counts = counts.select(F.explode("terms").alias("term"), "text").select("term", substring_count(F.col("text"), F.col("term")).alias("said"))
    said = counts.groupBy("term").agg(F.sum("said").alias("said"))
    return terms.join(said, "term").filter("said > 0").select("term", "surface", "shown", "said", "first_us")
