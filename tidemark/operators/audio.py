"""Audio planning on tables: chunks, who owns a segment, silence, repeated utterances."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import utterance_key
from .intervals import islands, overlap_join

RATE, US = 16_000, 1_000_000
#: 20 ms windows, the level below which one is quiet, the shortest silence, utterances looked back at.
WINDOW, QUIET_DBFS, SILENCE_US, LOOK_BACK = RATE // 50, -45.0, 1_000_000, 8


def chunk_plan(media: DataFrame, chunk_us: int = 600 * US, overlap_us: int = 2 * US) -> DataFrame:
    """media: media_id, range_start_us, range_end_us, audio_offset_us, audio_us. One row per chunk: its core, and the
    core widened by the overlap as far as there is audio. Chunks without audio are left out."""
    chunk_us = max(10 * US, chunk_us)
    start = F.greatest("range_start_us", "audio_offset_us")
    n = F.ceil((F.col("range_end_us") - start) / chunk_us)
    rows = media.withColumn("__s", start).filter(F.col("__s") < F.col("range_end_us")).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    core = F.col("__s") + F.col("chunk") * chunk_us
    core_end = F.least(F.col("range_end_us"), core + chunk_us)
    rows = rows.select("media_id", "chunk", core.alias("core_start_us"), core_end.alias("core_end_us"), F.greatest(F.col("audio_offset_us"), core - overlap_us).alias("start_us"), F.least(F.col("audio_offset_us") + F.col("audio_us"), core_end + overlap_us).alias("end_us"))
    return rows.filter("end_us > start_us")


def owned(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Segments (media_id, chunk, start_us, end_us, ...) kept by the chunk whose core holds their middle; the first
    chunk keeps earlier ones too and the last later ones. Ends in the wrong order are swapped."""
    a, b = F.least("start_us", "end_us"), F.greatest("start_us", "end_us")
    last = F.max("chunk").over(Window.partitionBy("media_id"))
    ends = chunks.select("media_id", "chunk", "core_start_us", "core_end_us", last.alias("__last"))
    rows = segments.withColumns({"start_us": a, "end_us": b}).join(ends, ["media_id", "chunk"])
    middle = F.floor((F.col("start_us") + F.col("end_us")) / 2)
    inside = (middle >= F.col("core_start_us")) & (middle < F.col("core_end_us"))
    edge = ((F.col("chunk") == 0) & (middle < F.col("core_start_us"))) | ((F.col("chunk") == F.col("__last")) & (middle >= F.col("core_end_us")))
    return rows.filter(inside | edge).drop("core_start_us", "core_end_us", "__last")


def levels(samples: DataFrame) -> DataFrame:
    """samples: media_id, i, x (-1 to 1). dBFS of each full window of 20 ms."""
    windows = samples.groupBy("media_id", F.floor(F.col("i") / WINDOW).alias("window")).agg(F.avg(F.col("x") * F.col("x")).alias("power"), F.count(F.lit(1)).alias("n"))
    return windows.filter(F.col("n") == WINDOW).select("media_id", "window", (20 * F.log10(F.sqrt(F.greatest(F.lit(1e-12), "power")))).alias("dbfs"))


def silence(levels_: DataFrame, offset_us: int = 0, window_us: int = US // 50, quiet: float = QUIET_DBFS, least_us: int = SILENCE_US) -> DataFrame:
    """Maximal runs of quiet windows (media_id, window, dbfs), at least least_us long."""
    w = Window.partitionBy("media_id").orderBy("window")
    hushed = levels_.filter(F.col("dbfs") < quiet).withColumn("window", F.col("window").cast("long"))  # 36 minutes in µs are beyond an int
    runs = islands(hushed, ["media_id"], ["window"], F.col("window") != F.lag("window").over(w) + 1)
    spans = runs.groupBy("media_id", "island").agg((F.min("window") * window_us + offset_us).alias("start_us"), ((F.max("window") + 1) * window_us + offset_us).alias("end_us"))
    return spans.filter(F.col("end_us") - F.col("start_us") >= least_us).drop("island")


def in_silence(utterances: DataFrame, spans: DataFrame, share: float = 0.9) -> DataFrame:
    """Utterances of which more than `share` lies in silence."""
    pairs = overlap_join(utterances.select("media_id", "utt_id", "start_us", "end_us"), spans.select("media_id", "start_us", "end_us"))
    sums = pairs.groupBy("media_id", "utt_id", "l_start_us", "l_end_us").agg(F.sum("overlap_us").alias("silent_us"))
    return sums.filter(F.col("silent_us") / F.greatest(F.lit(1), F.col("l_end_us") - F.col("l_start_us")) > share).select("media_id", "utt_id", "silent_us")


def dedup_across_chunks(utterances: DataFrame, look_back: int = LOOK_BACK) -> DataFrame:
    """Drops an utterance if one of the last `look_back` kept ones is of another chunk, overlaps it and has the same
    key. A fold in order of time; a timeline is streamed, only the look-back is held."""
    keyed = utterances.withColumn("key", utterance_key(F.col("text")))
    dealt = keyed.repartition("media_id").sortWithinPartitions("media_id", "start_us", "end_us", "utt_id")

    def run(batches):
        media, kept = None, []
        for batch in batches:
            keep = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("media_id", "chunk", "start_us", "end_us", "key")), strict=True)
            for m, chunk, start, end, key in rows:
                if m != media:
                    media, kept = m, []
                twin = any(c != chunk and k == key and min(e, end) - max(s, start) > 0 for c, s, e, k in kept)
                keep.append(not twin)
                if not twin:
                    kept = [*kept, (chunk, start, end, key)][-look_back:]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return dealt.mapInArrow(run, dealt.schema).drop("key")


#: Difference of audio lengths that is a mismatch. Fixed value.
MISMATCH_US = 200_000


def audio_mismatch(produced_us: Column, audio_us: Column, duration_us: Column, offset_us: Column) -> Column:
    """expected_us, diff_us, mismatch: what was written against the container's audio length (or, without one, its
    duration from the audio's offset on)."""
    known = lambda x: F.when(x != 0, x)
    expected = F.coalesce(known(audio_us), known(duration_us) - offset_us)
    diff = produced_us - expected
    return F.struct(expected.alias("expected_us"), diff.alias("diff_us"), F.coalesce(F.abs(diff) > MISMATCH_US, F.lit(False)).alias("mismatch"))
