"""Queries over the projected timelines, by name: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry, timecode
from ..functions import text as tx
from ..operators import alignment as al
from ..operators import audio, blocks, contents, gaps, intervals, lecture, quality, render, states, store, terms
from ..sources import projections as src

Q = {}
HOUR, DAY = src.HOUR, src.DAY


def query(f):
    Q[f.__name__] = f
    return f


def _joined(array, sep: str = ","):
    return F.array_join(F.transform(array, lambda x: x.cast("string")), sep)


def _align(spark: SparkSession, sf: str) -> DataFrame:
    return al.align(src.occurrences(spark, sf), src.utterances(spark, sf))


def _failed(spark: SparkSession, sf: str) -> DataFrame:
    return src.reviews(spark, sf).filter("reason = 'vision:extraction_failed'").select(F.col("target_ref").alias("occ_id"))


def _find_gaps(spark: SparkSession, sf: str) -> DataFrame:
    occ = src.occurrences(spark, sf).withColumn("skipped", F.col("state_kind") == "short")
    return gaps.find_gaps(occ, src.utterances(spark, sf), _failed(spark, sf))


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    occ = src.occurrences(spark, sf)
    failed = src.reviews(spark, sf).filter("reason in ('vision:extraction_failed', 'vision:truncated_output')").select(F.col("target_ref").alias("occ_id"), F.lit(True).alias("failed"))
    told = occ.join(failed, "occ_id", "left")
    state = states.coverage_state(F.col("content_id"), F.col("state_kind"), F.col("state_kind") == "short", F.coalesce("failed", F.lit(False)))
    return told.select("media_id", "occ_id", "start_us", "end_us", state.alias("state"))


# --- scans -----------------------------------------------------------------------------------------------------------


@query
def scan_occurrences(spark, sf):
    return src.occurrences(spark, sf).select("media_id", "occ_id", "start_us", "end_us", "content_id", "state_kind")


@query
def scan_utterances(spark, sf):
    return src.utterances(spark, sf)


@query
def scan_coverage_track(spark, sf):
    return _spans(spark, sf).filter("state = 'extracted'").select("media_id", "start_us", "end_us", "state")


@query
def lookup_by_key(spark, sf):
    return src.occurrences(spark, sf).filter("media_id = 7").select("media_id", "occ_id", "start_us")


@query
def oldest_media(spark, sf):
    first = src.occurrences(spark, sf).groupBy("media_id").agg(F.min("start_us").alias("first_us"))
    return first.orderBy("first_us", "media_id").limit(1)


# --- projections and filters -----------------------------------------------------------------------------------------


@query
def range_clip(spark, sf):
    return intervals.clipped(src.media(spark, sf), 5 * DAY, 40 * DAY).select("media_id", "range_start_us", "range_end_us")


@query
def state_kind(spark, sf):
    occ = src.occurrences(spark, sf)
    kind = states.state_kind(F.col("value") < 5, F.col("end_us") - F.col("start_us"), 30 * src.MINUTE)
    return occ.select("occ_id", kind.alias("kind"))


@query
def extractable_states(spark, sf):
    occ = src.occurrences(spark, sf)
    return occ.filter(states.should_extract(F.col("state_kind"), F.col("end_us") - F.col("start_us"), HOUR)).select("occ_id", "state_kind")


@query
def _contents(spark, sf):
    body = contents.bodies(src.regions(spark, sf))
    return body.select("content_id", F.sha2("body_text", 256).alias("body_sha"), "n_regions")


Q["body_text"] = Q.pop("_contents")


def _doc_shows(spark, sf):
    """Every event that shows something as an interval that shows a document, dealt over all documents."""
    last = src.table(spark, sf, "documents").agg(F.max("doc_id")).first()[0] or 0
    return src.occurrences(spark, sf).withColumn("content_id", F.when(F.col("content_id").isNotNull(), F.col("occ_id") % (last + 1)))


@query
def referenced_contents(spark, sf):
    docs = src.table(spark, sf, "documents").select(F.col("doc_id").alias("content_id"))
    return contents.referenced(docs, _doc_shows(spark, sf))


@query
def superseded_contents(spark, sf):
    docs = src.table(spark, sf, "documents").select(F.col("doc_id").alias("content_id"))
    return contents.superseded(docs, _doc_shows(spark, sf))


@query
def time_anomalies(spark, sf):
    media = src.media(spark, sf).withColumn("duration_us", F.col("duration_us") - 2 * DAY)
    return quality.time_anomalies(src.occurrences(spark, sf), src.utterances(spark, sf), media)


@query
def coverage_state(spark, sf):
    return _spans(spark, sf).select("occ_id", "state")


@query
def open_reviews_by_prefix(spark, sf):
    return src.reviews(spark, sf).filter(F.col("reason").startswith("vision:") & (F.col("review_status") == "open"))


@query
def topk_regions(spark, sf):
    area = F.length("text")
    regions = src.regions(spark, sf).withColumn("area", area).withColumn("uncertain", F.col("role") == "material_context")
    return contents.top_regions(regions).select("content_id", "reading_order", "area", "uncertain", "rank")


@query
def region_roles(spark, sf):
    return src.regions(spark, sf).groupBy("role", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


# --- joins -----------------------------------------------------------------------------------------------------------


@query
def align_overlap(spark, sf):
    return _align(spark, sf).select("media_id", "occ_id", "utt_id", "overlap_us")


@query
def align_primary(spark, sf):
    return _align(spark, sf).filter("is_primary").select("utt_id", "occ_id", "overlap_us")


def _overlap_sums(spark, sf, pairs):
    """Pairs, overlap and utterances per content. Orders of a customer do not overlap, so what the lines last in all bounds
    the overlap: a BIGINT where that fits, as in the SQL, and beyond it DECIMAL(38, 0)."""
    days = F.sum(F.greatest(F.lit(0.0), "l_quantity"))
    fits = (src.table(spark, sf, "lineitem").agg(days).first()[0] or 0) * DAY < 2**63 * 0.999
    total = F.sum(F.col("overlap_us").cast("decimal(20,0)"))
    return pairs.groupBy("content_id").agg(F.count(F.lit(1)).alias("pairs"), total.cast("bigint" if fits else "decimal(38,0)").alias("overlap_us"), F.count_distinct("utt_id").alias("utterances"))


@query
def align_large(spark, sf):
    return _overlap_sums(spark, sf, intervals.overlap_join(src.order_spans(spark, sf), src.line_spans(spark, sf)))


@query
def align_large_bucketed(spark, sf):
    return _overlap_sums(spark, sf, intervals.overlap_join(src.order_spans(spark, sf), src.line_spans(spark, sf), bucket_us=120 * DAY))


@query
def orphan_utterances(spark, sf):
    return al.orphans(src.utterances(spark, sf), _align(spark, sf)).select("media_id", "utt_id")


@query
def silent_occurrences(spark, sf):
    return al.silent(src.occurrences(spark, sf), _align(spark, sf)).select("media_id", "occ_id")


@query
def alignment_table(spark, sf):
    out = al.alignment_table(src.occurrences(spark, sf), _align(spark, sf), src.utterances(spark, sf))
    return out.select("media_id", "occ_id", "start_us", "end_us", "content_id", "utt_id", "overlap_us", "is_primary", "utt_start_us", "utt_end_us", "text")


@query
def alignments_for_media(spark, sf):
    occ = src.occurrences(spark, sf).filter("media_id between 3 and 9").select("occ_id")
    return _align(spark, sf).join(occ, "occ_id", "left_semi").select("occ_id", "utt_id", "overlap_us")


@query
def utterance_refs(spark, sf):
    out = al.utterance_refs(src.utterances(spark, sf), _align(spark, sf))
    return out.select("utt_id", _joined("occ_ids").alias("occ_ids"), "primary_occ_id")


@query
def occ_with_content(spark, sf):
    docs = src.table(spark, sf, "documents").select(F.col("doc_id").alias("content_id"), F.sha2("text", 256).alias("text_hash"))
    return _doc_shows(spark, sf).join(docs, "content_id", "left").select("occ_id", "content_id", "text_hash")


def _term_inputs(spark, sf):
    last = src.table(spark, sf, "benchmark").agg(F.max("item_id")).first()[0] or 0
    occ = _doc_shows(spark, sf).withColumn("content_id", F.col("content_id") % (last + 1))
    body = src.table(spark, sf, "benchmark").select(F.col("item_id").alias("content_id"), F.col("text").alias("body_text"))
    talk = src.table(spark, sf, "conversations").select((F.col("conv_id") % 97).alias("media_id"), F.concat_ws("-", "conv_id", "turn").alias("utt_id"), ((F.col("conv_id") * 37 + F.col("turn")) % 700 * HOUR).alias("start_us"), "text")
    talk = talk.withColumn("end_us", F.col("start_us") + 12 * src.SECOND)
    return occ, body, talk


@query
def nearby_terms(spark, sf):
    occ, body, talk = _term_inputs(spark, sf)
    words = body.select("content_id", F.explode(tx.shown_words(F.col("body_text"))).alias("term"))
    near = terms.near_contents(occ.filter("content_id IS NOT NULL"), talk).join(words, "content_id")
    return near.groupBy("utt_id").agg(F.count_distinct("term").alias("terms"))


@query
def term_match(spark, sf):
    occ, body, talk = _term_inputs(spark, sf)
    return terms.match_shown(talk, occ, body).select("utt_id", "term", "verdict")


@query
def unverified_terms(spark, sf):
    occ, body, talk = _term_inputs(spark, sf)
    return terms.unverified_terms(terms.match_shown(talk, occ, body), least=2)


@query
def screen_vocab(spark, sf):
    _, body, _ = _term_inputs(spark, sf)
    return body.select(F.explode(tx.shown_words(F.col("body_text"))).alias("term")).distinct()


@query
def spoken_terms(spark, sf):
    talk = src.speech(spark, sf)
    return talk.select("utt_id", F.array_join(tx.spoken_terms(F.col("text")), " ").alias("terms"))


@query
def term_index(spark, sf):
    occ, body, talk = _term_inputs(spark, sf)
    return terms.term_index(occ, body, talk)


@query
def events_in_block(spark, sf):
    runs = states.unextracted_runs(src.occurrences(spark, sf))
    clicks = src.occurrences(spark, sf).select("media_id", "occ_id", "start_us", "end_us").withColumn("event_kind", F.when(F.col("occ_id") % 5 == 0, "cursor").otherwise("pointer"))
    named = runs.withColumnRenamed("run", "block_index")
    return blocks.events_in_blocks(named, clicks).select("media_id", "block_index", "occ_id", "event_kind")


@query
def utt_in_silence(spark, sf):
    spans = states.unextracted_runs(src.occurrences(spark, sf)).select("media_id", "start_us", "end_us")
    return audio.in_silence(src.utterances(spark, sf), spans).select("utt_id", "silent_us")


@query
def failed_occurrences(spark, sf):
    return src.occurrences(spark, sf).join(_failed(spark, sf), "occ_id", "left_semi").select("occ_id", "media_id")


@query
def resume_pending(spark, sf):
    done = src.table(spark, sf, "labels").select(F.col("doc_id").alias("occ_id"))
    return quality.pending(src.occurrences(spark, sf), done, "occ_id").select("occ_id")


@query
def cache_misses(spark, sf):
    wanted = src.occurrences(spark, sf).filter("content_id IS NOT NULL").select("occ_id", "media_id", "content_id", F.lit("v1").alias("prompt"))
    have = wanted.filter("occ_id % 3 = 0").withColumn("cache_key", quality.cache_key(["media_id", "content_id", "prompt"]))
    return quality.cache_misses(wanted, have, ["media_id", "content_id", "prompt"]).select("occ_id", "cache_key")


@query
def block_utterances(spark, sf):
    runs = states.unextracted_runs(src.occurrences(spark, sf))
    pairs = intervals.overlap_join(runs.select("media_id", "run", "start_us", "end_us"), src.utterances(spark, sf).select("media_id", "utt_id", "start_us", "end_us"))
    packed = pairs.select("media_id", "run", "utt_id", "r_start_us").distinct().groupBy("media_id", "run").agg(F.sort_array(F.collect_list(F.struct("r_start_us", "utt_id"))).alias("u"))
    return packed.select("media_id", "run", _joined(F.transform("u", lambda x: x["utt_id"])).alias("utt_ids"))


# --- aggregates ------------------------------------------------------------------------------------------------------


@query
def attempt_stats(spark, sf):
    return src.attempts(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query
def provenance(spark, sf):
    return quality.provenance(src.attempts(spark, sf), ["status", "model", "frame_id"])


@query
def speech_sources(spark, sf):
    return src.speech(spark, sf).select("source").distinct()


@query
def coverage_by_state(spark, sf):
    spans = intervals.filled(_spans(spark, sf), src.media(spark, sf)).withColumn("track", F.lit("screen"))
    return quality.coverage_by_state(spans)


@query
def quality_scorecard(spark, sf):
    docs = src.table(spark, sf, "documents").select(F.col("doc_id").alias("content_id"))
    shows = _doc_shows(spark, sf)
    return quality.scorecard(shows, src.utterances(spark, sf), _align(spark, sf), docs, src.reviews(spark, sf))


@query
def reviews_by_reason(spark, sf):
    return quality.reviews_by_reason(src.reviews(spark, sf))


@query
def gaps_report(spark, sf):
    return _find_gaps(spark, sf).withColumn("score", F.round("score", 6))


Q["gaps"] = Q.pop("gaps_report")


@query
def gap_summary(spark, sf):
    return gaps.gap_summary(_find_gaps(spark, sf))


@query
def gaps_top(spark, sf):
    return gaps.top_gaps(_find_gaps(spark, sf)).select("media_id", "start_us", "reason", F.round("score", 6).alias("score"))


@query
def align_stats(spark, sf):
    return al.align_stats(src.occurrences(spark, sf), src.utterances(spark, sf), _align(spark, sf))


@query
def timestamp_check(spark, sf):
    stamps = src.table(spark, sf, "events").select((F.col("user_id") % 50).alias("media_id"), src.micros("ts").alias("t_us"), F.col("event_id").alias("seq"))
    return quality.timestamp_check(stamps)


@query
def content_dedup(spark, sf):
    docs = src.table(spark, sf, "documents").select(F.col("doc_id").alias("content_id"), F.sha2("text", 256).alias("text_hash"), "source")
    return contents.dedup_contents(docs)


@query
def pixel_stats(spark, sf):
    frames = src.frames(spark, sf)
    before = F.lag("pixels").over(Window.partitionBy("media_id").orderBy("t_us"))
    told = frames.withColumn("before", before).filter("before IS NOT NULL")
    mask = geometry.changed(F.col("pixels"), F.col("before"))
    n = F.aggregate(mask, F.lit(0), lambda acc, x: acc + x)
    return told.select("frame_id", n.alias("changed"), F.round(geometry.spread(F.col("pixels")), 6).alias("spread"), F.round(geometry.mean_difference(F.col("pixels"), F.col("before")), 6).alias("difference"))


@query
def tile_counts(spark, sf):
    frames = src.frames(spark, sf)
    before = F.lag("pixels").over(Window.partitionBy("media_id").orderBy("t_us"))
    told = frames.withColumn("before", before).filter("before IS NOT NULL")
    cells = told.select("frame_id", F.posexplode(geometry.changed(F.col("pixels"), F.col("before"))).alias("at", "hit"))
    row, column = F.floor(F.floor(F.col("at") / 8) / 4), F.floor(F.col("at") % 8 / 2)
    return cells.groupBy("frame_id", row.alias("tile_row"), column.alias("tile_col")).agg(F.sum("hit").alias("changed"))


# --- sequences -------------------------------------------------------------------------------------------------------


@query
def merge_states(spark, sf):
    return states.merge_equal(src.occurrences(spark, sf))


@query
def change_events(spark, sf):
    return states.change_events(src.occurrences(spark, sf)).select("media_id", "occ_id", "start_us")


@query
def merge_deferred(spark, sf):
    return states.merge_deferred(src.occurrences(spark, sf))


@query
def unextracted_runs(spark, sf):
    return states.unextracted_runs(src.occurrences(spark, sf))


@query
def run_kinds(spark, sf):
    return states.run_kinds(src.occurrences(spark, sf))


@query
def coverage_gaps(spark, sf):
    return intervals.uncovered(src.occurrences(spark, sf), src.media(spark, sf))


@query
def coverage_fill(spark, sf):
    return intervals.filled(_spans(spark, sf), src.media(spark, sf))


@query
def bursts(spark, sf):
    return states.bursts(src.occurrences(spark, sf), short_us=2 * HOUR, least=3).select("occ_id", "burst", "new_kind")


@query
def silence_spans(spark, sf):
    events = src.table(spark, sf, "events")
    level = events.select((F.col("user_id") % 20).alias("media_id"), F.row_number().over(Window.partitionBy(F.col("user_id") % 20).orderBy("event_id")).alias("window"), (F.col("value") - 60).alias("dbfs"))
    return audio.silence(level, least_us=60_000)


@query
def chunk_plan(spark, sf):
    media = src.media(spark, sf).select("media_id", (F.col("media_id") * src.SECOND).alias("range_start_us"), (F.col("media_id") % 7 * HOUR + HOUR).alias("range_end_us"), F.lit(5 * src.SECOND).alias("audio_offset_us"), (4 * HOUR + F.lit(0)).alias("audio_us"))
    return audio.chunk_plan(media)


@query
def chunk_owner(spark, sf):
    chunks = chunk_plan(spark, sf)
    said = src.speech(spark, sf).select((F.col("media_id") % 100).alias("media_id"), "utt_id", ((F.col("media_id") * 7919 + F.col("start_us") / 1000).cast("long") % 14400 * src.SECOND).alias("start_us"))
    said = said.withColumn("end_us", F.col("start_us") + 12 * src.SECOND)
    segments = said.join(chunks.select("media_id", "chunk", F.col("start_us").alias("c0"), F.col("end_us").alias("c1")), "media_id").filter("end_us > c0 AND start_us < c1").drop("c0", "c1")
    return audio.owned(segments, chunks).select("media_id", "chunk", "utt_id")


@query
def screen_versions(spark, sf):
    return states.versions(src.occurrences(spark, sf)).select("media_id", "occ_id", "content_id")


def _doc_pairs(spark, sf):
    docs = src.table(spark, sf, "documents").select("doc_id", "source", "text")
    before = F.lag("text").over(Window.partitionBy("source").orderBy("doc_id"))
    return docs.withColumn("before", before).filter("before IS NOT NULL")


@query
def line_diff(spark, sf):
    pairs = _doc_pairs(spark, sf).withColumn("c", tx.line_changes(F.col("text"), F.col("before")))
    return pairs.select("doc_id", "c.added", "c.removed", F.sha2("c.added_lines", 256).alias("added_sha"))


@query
def material_similarity(spark, sf):
    return _doc_pairs(spark, sf).select("doc_id", F.round(tx.material_similarity(F.col("text"), F.col("before")), 6).alias("similarity"))


@query
def cache_evict(spark, sf):
    frames = src.table(spark, sf, "events").select((F.col("user_id") % 10).alias("media_id"), F.col("event_id").alias("frame_id"), (F.col("event_id") % 4).alias("priority"), src.micros("ts").alias("t_us"), F.round(F.col("value") * 100).cast("long").alias("bytes"))
    return quality.evict(frames, 200_000).select("frame_id", "freed_before")


@query
def cache_priority(spark, sf):
    occ = src.occurrences(spark, sf)
    evidence = occ.select("occ_id", F.floor(F.col("occ_id") / 3).alias("frame_id"))
    return quality.cache_priority(occ, src.reviews(spark, sf), evidence)


@query
def flag_merge(spark, sf):
    flags = src.table(spark, sf, "labels").select("doc_id", F.array(F.lit("not_extracted"), F.concat(F.lit("q"), "quality")).alias("a"), F.array(F.lit("not_extracted"), F.concat(F.lit("t"), "toxic")).alias("b"))
    return flags.select("doc_id", _joined(states.flag_merge(F.col("b"), F.col("a"), "q1")).alias("flags"))


# --- scalar functions ------------------------------------------------------------------------------------------------


@query
def fmt_ts(spark, sf):
    return src.occurrences(spark, sf).select("occ_id", timecode.format_timestamp("start_us").alias("stamp"), timecode.format_timestamp(-F.col("start_us"), False).alias("negative"))


@query
def fmt_srt(spark, sf):
    return src.occurrences(spark, sf).select("occ_id", timecode.format_srt(F.col("start_us") - DAY).alias("stamp"))


@query
def pts_to_us(spark, sf):
    return src.occurrences(spark, sf).select("occ_id", timecode.pts_to_us("occ_id", 1001, 30000, 33).alias("t_us"))


@query
def content_hash(spark, sf):
    regions = src.regions(spark, sf).withColumn("screen_kind", F.lit("slide"))
    return contents.signatures(regions, F.trim("text"))


@query
def context_key(spark, sf):
    return contents.headings(src.regions(spark, sf))


@query
def clamp_bbox(spark, sf):
    orders = src.table(spark, sf, "part").select("p_partkey", (F.col("p_size") / 60).alias("x"), (F.col("p_partkey") % 97 / 100).alias("y"))
    box = geometry.clamp_bbox(F.col("x"), F.col("y"), F.col("x") / 2, F.col("y") + 0.125, F.lit(960), F.lit(540), 0.5)
    return orders.select("p_partkey", box.alias("b")).select("p_partkey", "b.*")


@query
def tile_plan(spark, sf):
    heights = src.table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 100).alias("height"))
    return heights.select("p_partkey", F.explode(geometry.tile_plan(F.col("height"))).alias("t")).select("p_partkey", "t.y0", "t.y1")


@query
def md_escape(spark, sf):
    return src.table(spark, sf, "documents").select("doc_id", F.sha2(tx.escape_markdown(F.col("text")), 256).alias("escaped_sha"), tx.fence(F.col("text")).alias("fence"))


@query
def patch_similarity(spark, sf):
    frames = src.frames(spark, sf)
    after = F.lead("pixels").over(Window.partitionBy("media_id").orderBy("t_us"))
    return frames.withColumn("after", after).filter("after IS NOT NULL").select("frame_id", F.round(geometry.mean_difference(F.col("pixels"), F.col("after")), 6).alias("difference"))


@query
def substring_counts(spark, sf):
    return src.speech(spark, sf).select("utt_id", tx.substring_count(F.lower("text"), F.lit("th")).alias("n"))


# --- outputs ---------------------------------------------------------------------------------------------------------


@query
def srt_cues(spark, sf):
    return render.srt_cues(src.speech(spark, sf)).select("media_id", "cue", "utt_id", F.sha2("block", 256).alias("block_sha"))


@query
def review_items(spark, sf):
    return render.review_items(src.occurrences(spark, sf), src.utterances(spark, sf), src.media(spark, sf))


@query
def quality_notes(spark, sf):
    flags = src.table(spark, sf, "documents").join(src.table(spark, sf, "labels"), "doc_id")
    flags = flags.select(F.col("source").alias("unit"), F.col("doc_id").alias("content_id"), F.when(F.col("quality") == 0, "truncated").when(F.col("toxic") == 1, "unreadable").otherwise("duplicate_regions_removed").alias("flag"))
    return contents.quality_notes(flags).select("unit", "flag", "content_ids")


@query
def utterance_rows(spark, sf):
    return render.utterance_rows(src.utterances(spark, sf), _align(spark, sf)).select("utt_id", "start", "end", "text", _joined("occ_ids").alias("occ_ids"))


# --- folds: no SQL, tests hold them against plain versions -----------------------------------------------------------


def _block_members(spark, sf):
    occ = _doc_shows(spark, sf)
    body = src.table(spark, sf, "documents").select(F.col("doc_id").alias("content_id"), F.lit("slide").alias("screen_kind"), F.col("source").alias("heading"), F.col("source").alias("title"), F.col("text").alias("body_text"))
    return blocks.block_members(occ, body, blocks.BlockRule(max_gap_us=HOUR, max_duration_us=2 * DAY, similarity=0.05))


@query
def reading_blocks(spark, sf):
    out = blocks.blocks(_block_members(spark, sf))
    return out.withColumn("occ_ids", _joined("occ_ids"))


@query
def block_labels(spark, sf):
    return _block_members(spark, sf).select("media_id", "block_index", "occ_id", "place", "label")


@query
def block_refs(spark, sf):
    out = blocks.block_refs(_block_members(spark, sf), _align(spark, sf), _doc_shows(spark, sf))
    return out.withColumns({"utt_ids": _joined("utt_ids"), "content_ids": _joined("content_ids")})


def _documents(spark, sf, whole: bool):
    occ, said = _doc_shows(spark, sf), src.utterances(spark, sf)
    members, pairs = _block_members(spark, sf), _align(spark, sf)
    if not whole:
        body = src.table(spark, sf, "documents").select(F.col("doc_id").alias("content_id"), F.lit(False).alias("is_code"), F.col("text").alias("body_text"))
        return lecture.material_lines(members, occ, body, said, pairs)
    body = src.table(spark, sf, "documents").select(F.col("doc_id").alias("content_id"), F.lit("slide").alias("screen_kind"), F.col("text").alias("body_text"))
    return lecture.lecture_lines(members, occ, body, src.regions(spark, sf), said, pairs, src.media(spark, sf))


@query
def material_document(spark, sf):
    return _documents(spark, sf, False).groupBy("media_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("line").startswith("- `")).alias("said"))


@query
def lecture_document(spark, sf):
    return _documents(spark, sf, True).groupBy("media_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))


# --- state tables ----------------------------------------------------------------------------------------------------


@query
def upserted_rows(spark, sf):
    old = src.occurrences(spark, sf).select("occ_id", "state_kind")
    short = old.filter("state_kind = 'short'").select("occ_id", F.lit("transition").alias("state_kind"))
    return store.upsert(old, short.unionByName(old.filter("state_kind = 'blank'").select((-F.col("occ_id") - 1).alias("occ_id"), F.lit("new").alias("state_kind"))), ["occ_id"])


@query
def replaced_scopes(spark, sf):
    spans = _spans(spark, sf).select("media_id", "start_us", "end_us", "state")
    blank = src.occurrences(spark, sf).filter("state_kind = 'blank'").select("media_id").distinct()
    fresh = blank.select("media_id", F.lit(0).cast("long").alias("start_us"), F.lit(DAY).alias("end_us"), F.lit("unextracted").alias("state"))
    return store.replace_where(spans, fresh, ["media_id"])


@query
def cascaded_rows(spark, sf):
    shown = src.occurrences(spark, sf).filter("content_id IS NOT NULL").select(F.col("occ_id").alias("target_ref"))
    return store.cascade(src.reviews(spark, sf), shown, "target_ref")


@query
def orphan_references(spark, sf):
    shown = src.occurrences(spark, sf).filter("content_id IS NOT NULL").select(F.col("occ_id").alias("target_ref"))
    return store.orphan_keys(src.reviews(spark, sf), shown, "target_ref")


@query
def cleared_reviews(spark, sf):
    return store.clear_open_reviews(src.reviews(spark, sf), "vision:")


@query
def constraint_checks(spark, sf):
    return store.checks(src.occurrences(spark, sf), ordered="end_us >= start_us", later="start_us > 86400000000", shown="content_id IS NOT NULL")


@query
def status_counts(spark, sf):
    return store.status_counts(src.occurrences(spark, sf), src.utterances(spark, sf), src.reviews(spark, sf))


@query
def role_lists(spark, sf):
    out = contents.role_lists(src.regions(spark, sf))
    return out.select("content_id", *[F.sha2(F.array_join(name, "\n"), 256).alias(f"{name}_sha") for name in contents.ROLE_LISTS])


@query
def shown_metrics(spark, sf):
    lines = src.table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("stage"), F.lit("price").alias("name"), F.col("l_extendedprice").cast("double").alias("value"), F.lit("x").alias("unit"))
    whole = src.table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("stage"), F.lit("count").alias("name"), F.col("l_quantity").cast("double").alias("value"), F.lit("").alias("unit"))
    return store.shown_metrics(lines.unionByName(whole))


@query
def change_kinds(spark, sf):
    flags = F.when(F.col("value") < 5, F.array(F.lit("change:repeat"))).when(F.col("value") < 20, F.array(F.lit("x"), F.lit("change:modified"), F.lit("change:repeat"))).otherwise(F.array().cast("array<string>"))
    return src.occurrences(spark, sf).select("occ_id", states.change_kind(flags, F.col("content_id")).alias("kind"))


@query
def attempts_of_frame(spark, sf):
    return src.attempts(spark, sf).filter("frame_id = 7").select("frame_id", "created_us", "status", "model")


@query
def contained_spans(spark, sf):
    pairs = intervals.containment_join(src.order_spans(spark, sf), src.occurrences(spark, sf).select("media_id", F.col("occ_id").alias("event_id"), "start_us", "end_us"))
    return pairs.groupBy("occ_id").agg(F.count(F.lit(1)).alias("inside"))


@query
def utterances_or_none(spark, sf):
    """Every display interval with what is said in it, or with nulls: the left join."""
    occ, said = src.occurrences(spark, sf).select("media_id", "occ_id", "start_us", "end_us"), src.utterances(spark, sf).select("media_id", "utt_id", "start_us", "end_us")
    return intervals.overlap_join(occ, said, "left").select("occ_id", "utt_id", "overlap_us")


@query
def full_image_sizes(spark, sf):
    size = geometry.full_image_size(F.col("p_size") * 100, F.col("p_partkey") % 97 * 40 + 1, 2048)
    factor = geometry.upscale_factor(F.col("p_size") * 9, F.col("p_size") * 3, 20_000)
    return src.table(spark, sf, "part").select("p_partkey", size.alias("s"), F.round(factor, 6).alias("factor")).select("p_partkey", "s.width", "s.height", F.round("s.scale", 6).alias("scale"), "factor")


@query
def audio_mismatches(spark, sf):
    lines = src.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity").cast("long") * 100_000).alias("made"), (F.col("l_linenumber") * 700_000).cast("long").alias("length"))
    told = audio.audio_mismatch(F.col("made"), F.when(F.col("l_linenumber") > 2, F.col("length")), F.when(F.col("l_linenumber") > 1, F.col("length")), F.lit(50_000))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", told.alias("t")).select("l_orderkey", "l_linenumber", "l_partkey", "t.expected_us", "t.diff_us", "t.mismatch")


@query
def block_stats(spark, sf):
    return blocks.block_stats(_block_members(spark, sf))


@query
def utterances_deduped(spark, sf):
    said = src.speech(spark, sf).withColumn("chunk", F.floor(F.col("start_us") / (20 * src.SECOND)))
    return audio.dedup_across_chunks(said).select("media_id", "utt_id")


@query
def frame_states(spark, sf):
    from ..operators import frames

    return frames.scan(src.frames(spark, sf), 8, 8, frames.ScanRule(min_changed_pixels=40, density_window=1, border=0, tile_pixels=64, global_ratio=0.6, cursor_max_pixels=20, tile_ratio=1.0)).filter("event_kind IS NULL").drop("event_kind", "box")
