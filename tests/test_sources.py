import json

import pytest
from pyspark.sql import functions as F

from tidemark.plans import jobs
from tidemark.sources import adapters, readers


def completion(content, finish="stop"):
    return json.dumps({"choices": [{"finish_reason": finish, "message": {"content": content}}]})


def test_readings(spark):
    good = {"screen_kind": "slide", "regions": [{"kind": "heading", "text": "T", "bbox": [0, 0, 1, 0.5]}, {"text": "b", "bbox": "0.1,0.2,0.3,0.4", "reading_order": 7}], "output_complete": True}
    bad = {**good, "regions": [{"text": "x", "bbox": [1, 2, 3]}]}
    cases = [completion(json.dumps(good)), completion(json.dumps(good), "length"), completion(json.dumps({**good, "output_complete": False})), completion("not json"), completion(json.dumps(bad)), completion(json.dumps({**good, "regions": 3})), completion(json.dumps({"screen_kind": "slide", "output_complete": True}))]
    df = spark.createDataFrame([(k, c, 960, 540) for k, c in enumerate(cases)], "k int, completion_json string, width int, height int")
    out = readers.vision_readings(df)
    got = {r.k: (r.status, r.problem) for r in out.collect()}
    assert [got[k][0] for k in range(7)] == ["ok", "truncated", "truncated", "schema_invalid", "schema_invalid", "schema_invalid", "schema_invalid"]
    assert got[0][1] == "" and "bbox" in got[4][1] and "list" in got[5][1]
    regions = readers.payload_regions(out.filter("k = 0").select("k", "payload", "width", "height")).orderBy("reading_order").collect()
    assert [(r.reading_order, r.kind, r.role, r.text, tuple(r.bbox)) for r in regions] == [(0, "heading", "material_body", "T", (0, 0, 960, 274)), (7, "unknown", "material_body", "b", (92, 104, 292, 220))]


def test_probe(spark):
    doc = {"streams": [{"codec_type": "video", "start_time": "0.5", "r_frame_rate": "30/1", "avg_frame_rate": "29/1", "width": 960, "height": 540, "duration": "9"}, {"codec_type": "audio", "start_time": "0.6"}], "format": {"duration": "10.0"}}
    r = readers.probe(spark.createDataFrame([(json.dumps(doc),), ("{}",)], "probe_json string")).collect()
    assert (r[0].origin_us, r[0].duration_us, r[0].audio_offset_us, r[0].is_vfr) == (500_000, 10_000_000, 100_000, True)
    assert r[0].timeline_flags == ["audio_offset", "variable_frame_rate"] and r[1].timeline_flags == ["no_video", "no_audio"]


def test_speech(spark):
    doc = {"params": {"language": "ja"}, "transcription": [{"text": " a ", "offsets": {"from": 10, "to": 20}, "tokens": [{"text": "a", "offsets": {"from": 10, "to": 12}}]}, {"text": " ", "offsets": {"from": 1, "to": 2}}, {"text": "b"}]}
    r = readers.speech_segments(spark.createDataFrame([(json.dumps(doc),)], "asr_json string")).collect()
    assert [(x.start_us, x.end_us, x.text, x.language, x.tokens[0].end_us) for x in r] == [(10_000, 20_000, "a", "ja", 12_000)]


def test_channels(spark):
    samples = F.array(*[F.lit(x) for x in (1.0, 3.0, 5.0, 7.0)])
    got = spark.range(1).select(readers.channel(samples, 2, "mix"), readers.channel(samples, 2, "right"), readers.channel(samples, 2, "0")).first()
    assert tuple(got) == ([2.0, 6.0], [3.0, 7.0], [1.0, 5.0])
    with pytest.raises(ValueError):
        readers.channel(samples, 2, "5")


def test_call_policy():
    ok, bad, cut, err = (adapters.Reading(s) for s in ("ok", "schema_invalid", "truncated", "error"))
    for script, want in (([ok], ("ok", 1)), ([bad, err, ok], ("ok", 3)), ([bad, cut, ok], ("truncated", 2)), ([err], ("error", 3))):
        reading, n = adapters.ask(adapters.ScriptedAdapter({1: list(script)}), {"key": 1})
        assert (reading.status, n) == want


def test_loopback_only():
    assert adapters.loopback("http://127.0.0.1:80/x")
    with pytest.raises(ValueError):
        adapters.loopback("http://example.org/")


def test_split_read():
    read = lambda a, b: adapters.Reading("ok" if b - a <= 300 else "truncated", f"{a}-{b}")
    assert [(a, b) for a, b, _ in adapters.split_read(read, 1000)] == [(0, 250), (250, 500), (500, 750), (750, 1000)]
    assert [(a, b) for a, b, _ in adapters.split_read(lambda a, b: adapters.Reading("error"), 400, least=180)] == [(0, 200), (200, 400)]


def test_read_all_asks_only_what_the_cache_lacks(spark):
    requests = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "key string, size int")
    cache = spark.createDataFrame([], "cache_key string, payload string")
    make = lambda: adapters.ScriptedAdapter({"a": adapters.Reading("ok", "A"), "b": adapters.Reading("truncated", "B")})
    first = adapters.read_all(requests, cache, make, "m1", ["key", "size"])
    assert sorted((r.key, r.status, r.asked) for r in first.collect()) == [("a", "ok", 1), ("b", "truncated", 1), ("b", "truncated", 1)]
    again = adapters.read_all(requests, adapters.cacheable(first), make, "m1", ["key", "size"])
    assert sorted((r.key, r.status, r.asked) for r in again.collect()) == [("a", "ok", 0), ("b", "truncated", 1), ("b", "truncated", 1)]


def test_jobs():
    j, ran = jobs.Jobs(), []
    assert j.run("asr", "i", "c", lambda job: ran.append(1)) and not j.run("asr", "i", "c", lambda job: ran.append(2)) and ran == [1]
    j.run("align", "i", "c", lambda job: None)
    assert j.run("asr", "i", "c2", lambda job: None) and "align" not in j.rows
    with pytest.raises(RuntimeError):
        j.run("vision", "i", "c", lambda job: (job.checkpoint.update(at=3), (_ for _ in ()).throw(RuntimeError()))[0])
    assert j.rows["vision"].status == "failed" and j.start("vision", "i", "c").checkpoint == {"at": 3} and j.start("vision", "i2", "c").checkpoint == {}
    assert jobs.Jobs.from_json(j.to_json()).to_json() == j.to_json()
    assert jobs.downstream("frame_scan") == ["vision", "screen_tracker", "align", "blocks", "export"] and jobs.downstream("export") == []
    assert [jobs.completion(*x) for x in ((False, 0), (True, 2), (True, 0))] == ["processing", "completed_with_review", "reviewed"]
    assert jobs.config_hash({"a": 1, "b": 2}, ["a"]) == jobs.config_hash({"b": 3, "a": 1}, ["a"])
    told = jobs.manifest({"id": 1}, j, {"a": 1}, ["b", "a"], 0, {})
    assert told == jobs.manifest({"id": 1}, j, {"a": 1}, ["a", "b"], 0, {}) and '"status":"processing"' in told
    assert jobs.selected(["export", "asr"]) == ["asr", "export"]


def test_wav_facts(spark):
    import io
    import wave

    from tidemark.sources import readers

    def made(channels, width, n):
        held = io.BytesIO()
        with wave.open(held, "wb") as w:
            w.setnchannels(channels)
            w.setsampwidth(width)
            w.setframerate(16_000)
            w.writeframes(bytes(channels * width * n))
        return held.getvalue()

    df = spark.createDataFrame([(1, made(1, 2, 24_000)), (2, made(2, 2, 10)), (3, b"RIFF"), (4, None)], "k int, content binary")
    got = [tuple(r) for r in readers.wav_facts(df).select("k", "rate", "samples", "duration_us").orderBy("k").collect()]
    assert got == [(1, 16_000, 24_000, 1_500_000), (2, None, None, None), (3, None, None, None), (4, None, None, None)]


def test_config_sections(tmp_path):
    import pytest

    from tidemark.plans import jobs

    config = jobs.merged_config({"scan": {"interval_us": 1}})
    jobs.save_config(config, str(tmp_path / "c.json"))
    assert jobs.load_config(str(tmp_path / "c.json")) == config and config["scan"]["small_width"] == 960
    assert jobs.stage_hash("export", config) == jobs.stage_hash("export", jobs.merged_config({})) != jobs.stage_hash("frame_scan", config)
    assert jobs.stage_hash("frame_scan", config) != jobs.stage_hash("frame_scan", jobs.merged_config({}))
    with pytest.raises(ValueError):
        jobs.merged_config({"scan": {"intervall": 1}})
    assert jobs.quick_hash(3, b"a", b"b") != jobs.quick_hash(4, b"a", b"b") and jobs.input_hash(["a", "b"]) != jobs.input_hash(["ab"])


def test_a_screen_is_read_whole_then_in_parts():
    import json

    from tidemark.sources.adapters import Reading, ScreenReader, ScriptedAdapter

    class Scripted(ScriptedAdapter):
        def read(self, request):
            kind = request["kind"]
            return super().read({"key": kind if kind != "tile" else (request["top"], request["bottom"])})

    long = "a region with quite some words in it that was read twice by the model"
    full = json.dumps({"screen_kind": "slide", "output_complete": True, "regions": [{"text": long, "bbox": [0, 0, 9, 9]}, {"text": long, "bbox": [0, 0, 9, 9]}, {"text": "un?ear", "bbox": [0, 9, 9, 20], "unreadable": ["?"]}]})
    inner = Scripted({"full": Reading("ok", full), "crop": Reading("ok", json.dumps({"text": "unclear"}))})
    got = json.loads(ScreenReader(inner).read({"height": 400}).payload)
    assert [r["text"] for r in got["regions"]] == [long, "unclear"] and got["flags"] == ["duplicate_regions_removed", "unreadable"]
    assert got["regions"][1]["flags"] == ["reread_differs_from_full_pass"] and inner.calls == 2
    tile = lambda text: Reading("ok", json.dumps({"regions": [{"text": text, "bbox": [0, 1, 5, 6]}]}))
    inner = Scripted({"full": Reading("error"), (0, 400): Reading("schema_invalid"), (0, 200): tile("up"), (200, 400): tile("down")})
    got = json.loads(ScreenReader(inner, retries=0).read({"height": 400}).payload)
    assert [(r["text"], r["bbox"][1]) for r in got["regions"]] == [("up", 1), ("down", 201)] and got["flags"] == ["fallback_split_read"]
    assert ScreenReader(Scripted({}), retries=0).read({"height": 100}) == Reading("error", detail="not_extracted")


def test_markers_chunks_and_areas():
    import json

    import numpy as np

    from tidemark.sources.adapters import ChunkAdapter, MarkerAdapter, Reading, ScriptedAdapter, area_unchanged, marker

    screen = np.full((20, 60), 90, np.uint8)
    screen[:4, :48] = marker(1234)
    assert MarkerAdapter({1234: Reading("ok", "{}")}).read({"pixels": screen.tolist()}) == Reading("ok", "{}")
    sound = ChunkAdapter(lambda r: [(0, 5, "a"), (5, r["say"], "b")], "test")
    assert json.loads(sound.read({"start_us": 100, "end_us": 110, "say": 10}).payload)[1] == {"start_us": 105, "end_us": 110, "text": "b"}
    assert sound.read({"start_us": 100, "end_us": 110, "say": 11}).status == "schema_invalid"
    area = ScriptedAdapter({1: Reading("ok", json.dumps({"lines": ["x "]})), 2: Reading("ok", json.dumps({"text": "x"})), 3: Reading("ok", json.dumps({"text": "y"}))})
    same = lambda a, b: area_unchanged(area, {"key": a}, {"key": b}, str.strip)
    assert (same(1, 2), same(1, 3), same(1, 4)) == (True, False, None)


def test_reviews_of_a_run(spark):
    from tidemark.operators import reviews

    occ = spark.createDataFrame([(1, "c"), (2, "c"), (3, None)], "occ_id long, content_id string")
    body = spark.createDataFrame([("c", ["truncated"])], "content_id string, flags array<string>")
    region = spark.createDataFrame([("c", 0, ["unreadable", "crop_reread_empty", "crop_reread_failed"], ["q"]), ("c", 1, None, []), ("c", 2, ["x"], ["z"])], "content_id string, reading_order int, flags array<string>, unreadable array<string>")
    got = sorted((r.target_ref, r.reason, r.detail) for r in reviews.reading_reviews(occ, body, region).collect() if r.target_ref[0] == "1")
    assert got == [("1", "vision:truncated_output", ""), ("1:0", "vision:crop_reread_failed", ""), ("1:0", "vision:unreadable_text", '["q"]'), ("1:2", "vision:unreadable_text", '["z"]')]
    checks = spark.createDataFrame([(1, 0, 2, 3)], "media_id long, missing int, non_monotonic int, gaps int")
    media = spark.createDataFrame([(1, True), (2, None)], "media_id long, is_vfr boolean")
    assert sorted(r.reason for r in reviews.timeline_reviews(checks, media).collect()) == ["timeline:non_monotonic_pts", "timeline:pts_gaps", "timeline:vfr_suspected"]
    lengths = spark.createDataFrame([(1, True, -5), (2, False, 0)], "media_id long, mismatch boolean, diff_us long")
    chunks = spark.createDataFrame([("a", "ok", None), ("b", "error", "gone")], "chunk_id string, status string, detail string")
    silent = spark.createDataFrame([(7,)], "utt_id long")
    assert sorted((r.target_ref, r.detail) for r in reviews.speech_reviews(lengths, chunks, silent).collect()) == [("1", "-5"), ("7", ""), ("b", "gone")]
    terms = spark.createDataFrame([("t", 5), ("u", 4)], "term string, n long")
    assert [(r.target_ref, r.detail) for r in reviews.term_reviews(terms).collect()] == [("t", "5")]
