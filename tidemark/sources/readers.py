"""Readers of what probes and models return: JSON columns to typed rows. Bad JSON is a status, never an empty result."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import clamp_bbox, parse_bbox
from ..functions.timecode import rate, seconds_to_us

#: Sound that starts this far from the picture, and frame rates that differ by this share, are flagged.
OFFSET_US, VARIABLE_SHARE = 50_000, 0.01

PROBE = """struct<streams:array<struct<codec_type:string,start_time:string,duration:string,r_frame_rate:string,avg_frame_rate:string,
    width:int,height:int,time_base:string,sample_rate:string,channels:int>>,format:struct<start_time:string,duration:string>>"""
SPEECH = "struct<result:struct<language:string>,params:struct<language:string>,transcription:array<struct<text:string,offsets:struct<`from`:bigint,`to`:bigint>,tokens:array<struct<text:string,offsets:struct<`from`:bigint,`to`:bigint>>>>>>"
REGION = "struct<kind:string,role:string,text:string,bbox:string,reading_order:int>"
COMPLETION = "struct<choices:array<struct<finish_reason:string,message:struct<content:string>>>>"


def probe(rows: DataFrame, column: str = "probe_json") -> DataFrame:
    """Media facts of a probe document: origin, duration, sound offset, sizes and flags."""
    p = F.from_json(F.col(column), PROBE)
    first = lambda kind: F.try_element_at(F.filter(p["streams"], lambda s: s["codec_type"] == kind), F.lit(1))
    us = lambda text: seconds_to_us(text.try_cast("double"))
    video, sound = first("video"), first("audio")
    origin = F.coalesce(us(video["start_time"]), us(p["format"]["start_time"]), F.lit(0).cast("long"))
    longest = F.array_max(F.transform(p["streams"], lambda s: us(s["duration"])))
    out = rows.withColumns({"__v": video, "__a": sound, "origin_us": origin, "duration_us": F.coalesce(us(p["format"]["duration"]), longest)})
    steady, mean = rate(F.col("__v.r_frame_rate")), rate(F.col("__v.avg_frame_rate"))
    variable = F.coalesce(F.abs(steady - mean) / mean > VARIABLE_SHARE, F.lit(False))
    offset = us(F.col("__a.start_time")) - F.col("origin_us")
    flags = F.filter(F.array(F.when(F.abs(offset) > OFFSET_US, "audio_offset"), F.when(variable, "variable_frame_rate"), F.when(F.col("__v").isNull(), "no_video"), F.when(F.col("__a").isNull(), "no_audio")), lambda x: x.isNotNull())
    return out.withColumns({"audio_offset_us": offset, "is_vfr": variable, "width": F.col("__v.width"), "height": F.col("__v.height"), "fps": F.coalesce(mean, steady), "timeline_flags": flags}).drop("__v", "__a")


def speech_segments(rows: DataFrame, column: str = "asr_json") -> DataFrame:
    """One row per transcribed segment, in microseconds of its chunk. Segments without times or text are left out."""
    p = F.from_json(F.col(column), SPEECH)
    keep = [c for c in rows.columns if c != column]
    seg = rows.select(*keep, F.coalesce(p["result"]["language"], p["params"]["language"]).alias("language"), F.posexplode(p["transcription"]).alias("segment", "s"))
    seg = seg.filter("s.offsets.from IS NOT NULL AND s.offsets.to IS NOT NULL AND trim(s.text) <> ''")
    tokens = F.transform("s.tokens", lambda t: F.struct(t["text"].alias("text"), (t["offsets"]["from"] * 1000).alias("start_us"), (t["offsets"]["to"] * 1000).alias("end_us")))
    return seg.select(*keep, "language", "segment", (F.col("s.offsets.from") * 1000).alias("start_us"), (F.col("s.offsets.to") * 1000).alias("end_us"), F.trim("s.text").alias("text"), tokens.alias("tokens"))


def payload_problem(payload) -> F.Column:
    """Why a reading cannot be used; '' if it can. payload: a JSON object as text."""
    v = F.try_parse_json(payload)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    regions = F.from_json(F.get_json_object(payload, "$.regions"), "array<string>")
    field = lambda r, name: F.get_json_object(r, f"$.{name}")
    number = lambda x: x.try_cast("double").isNotNull()
    boxed = lambda r: F.when(field(r, "bbox").startswith("["), (F.size(F.from_json(field(r, "bbox"), "array<string>")) == 4) & F.forall(F.from_json(field(r, "bbox"), "array<string>"), number)).otherwise(F.size(F.split(field(r, "bbox"), ",")) >= 4)
    return (
        F.when(v.isNull(), "not JSON")
        .when(F.coalesce(~kind("$.regions").startswith("ARRAY"), F.lit(True)), "regions is not a list")
        .when(F.coalesce(kind("$.screen_kind") != "STRING", F.lit(True)), "screen_kind is not a string")
        .when(F.coalesce(kind("$.output_complete") != "BOOLEAN", F.lit(True)), "output_complete is not a boolean")
        .when(F.exists(regions, lambda r: field(r, "text").isNull()), "a region has no text")
        .when(F.exists(regions, lambda r: field(r, "bbox").isNotNull() & ~F.coalesce(boxed(r), F.lit(False))), "a region's bbox is not four numbers")
        .otherwise("")
    )


def vision_readings(rows: DataFrame, column: str = "completion_json") -> DataFrame:
    """Adds payload, status (ok, truncated, schema_invalid) and problem to each model completion."""
    choice = F.try_element_at(F.from_json(F.col(column), COMPLETION)["choices"], F.lit(1))
    out = rows.withColumns({"payload": choice["message"]["content"], "__end": choice["finish_reason"]})
    out = out.withColumn("problem", payload_problem(F.col("payload")))
    complete = F.get_json_object("payload", "$.output_complete")
    status = F.when(F.col("__end") == "length", "truncated").when(F.col("payload").isNull() | (F.col("problem") != ""), "schema_invalid").when(complete == "false", "truncated").otherwise("ok")
    return out.withColumn("status", status).drop("__end")


def payload_regions(rows: DataFrame, column: str = "payload", width: str = "width", height: str = "height") -> DataFrame:
    """One row per region of a reading: its place in the list is its order unless it says otherwise; boxes in pixels."""
    keep = [c for c in rows.columns if c != column]
    listed = rows.select(*keep, F.posexplode(F.from_json(F.get_json_object(column, "$.regions"), f"array<{REGION}>")).alias("position", "r"))
    box = parse_bbox(F.coalesce(F.col("r.bbox"), F.lit("")))
    clamped = clamp_bbox(box[0], box[1], box[2], box[3], F.col(width), F.col(height))
    return listed.select(*keep, F.coalesce("r.reading_order", "position").alias("reading_order"), F.coalesce("r.kind", F.lit("unknown")).alias("kind"), F.coalesce("r.role", F.lit("material_body")).alias("role"), F.coalesce("r.text", F.lit("")).alias("text"), clamped.alias("bbox"))


def channel(samples: F.Column, channels: int, pick: str) -> F.Column:
    """One channel of interleaved samples: 'mix' (mean), 'left', 'right' or a number from 0."""
    named = {"left": 0, "right": 1}
    if pick != "mix" and not (pick in named or pick.isdigit() and int(pick) < channels):
        raise ValueError(f"no such channel: {pick}")
    frames = F.sequence(F.lit(0), F.floor(F.size(samples) / channels).cast("int") - 1)
    if pick == "mix":
        return F.transform(frames, lambda k: F.aggregate(F.slice(samples, k * channels + 1, channels), F.lit(0.0), lambda acc, x: acc + x) / channels)
    return F.transform(frames, lambda k: F.get(samples, k * channels + named.get(pick, int(pick) if pick.isdigit() else 0)))


def wav_samples(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples of a WAV file of one 16-bit channel; any other is refused."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, samples = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", data, at + 8)
        elif name == b"data":
            samples = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if form is None or samples is None or form[0] != 1 or form[1] != 1 or form[5] != 16:
        raise ValueError("not one 16-bit channel")
    return form[2], np.frombuffer(samples[: len(samples) // 2 * 2], "<i2")


def wav_facts(files: DataFrame, column: str = "content") -> DataFrame:
    """Adds rate, samples and duration_us to WAV files as spark.read.format("binaryFile") gives them; nulls if one is none."""

    @F.pandas_udf("struct<rate:int,samples:bigint,duration_us:bigint>")
    def facts(contents: pd.Series) -> pd.DataFrame:
        out = []
        for data in contents:
            try:
                rate_, samples = wav_samples(bytes(data))
                out.append((rate_, len(samples), round(len(samples) / rate_ * 1_000_000)))
            except (ValueError, TypeError, struct.error, ZeroDivisionError):
                out.append((None, None, None))
        return pd.DataFrame(out, columns=["rate", "samples", "duration_us"]).astype("Int64")

    return files.withColumn("__f", facts(column)).select(*files.columns, "__f.rate", "__f.samples", "__f.duration_us")
