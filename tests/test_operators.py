import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import alignment, audio, blocks, contents, gaps, intervals, lecture, quality, regions, render, states, store, terms

OCC = "media_id long, occ_id long, start_us long, end_us long, content_id string, state_kind string"
UTT = "media_id long, utt_id long, start_us long, end_us long, text string"


def scenario(spark):
    """Five screens and five utterances: a slide, two versions of a program, a popup that is not read, the slide."""
    occ = [(1, 0, 0, 2_000_000, "s11", "stable"), (1, 1, 2_000_000, 4_500_000, "c12", "stable"), (1, 2, 4_500_000, 7_000_000, "c13", "stable"), (1, 3, 7_000_000, 7_100_000, None, "short"), (1, 4, 7_100_000, 9_100_000, "s11", "stable")]
    utt = [(1, 0, 500_000, 1_800_000, "a"), (1, 1, 1_900_000, 2_900_000, "b"), (1, 2, 3_200_000, 4_400_000, "c"), (1, 3, 5_000_000, 6_200_000, "d"), (1, 4, 7_500_000, 8_500_000, "e")]
    code = "def total(xs):\n    result = {}\n    for x in xs:\n        result += x\n    return result"
    bodies = [("s11", "slide", "Lecture 1", "Lecture 1", "Agenda\none\ntwo"), ("c12", "code", "total.py", "total.py", code.format(0)), ("c13", "code", "total.py", "total.py", code.format(1))]
    return spark.createDataFrame(occ, OCC), spark.createDataFrame(utt, UTT), spark.createDataFrame(bodies, "content_id string, screen_kind string, heading string, title string, body_text string")


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def random_intervals(rng, n, prefix):
    out = []
    for k in range(n):
        s = rng.randint(-20, 60)
        out.append((rng.randint(1, 3), k, s, s + rng.choice([0, 0, 1, 5, 20, 200]), prefix))
    return out


@pytest.mark.parametrize("bucket", [None, 0, 7, 64])
def test_overlap_join_is_the_theta_join(spark, bucket):
    rng = random.Random(5)
    left, right = random_intervals(rng, 60, "l"), random_intervals(rng, 60, "r")
    a = spark.createDataFrame(left, "media_id long, occ_id long, start_us long, end_us long, x string")
    b = spark.createDataFrame(right, "media_id long, utt_id long, start_us long, end_us long, y string")
    want = sorted((p[1], q[1], min(p[3], q[3]) - max(p[2], q[2])) for p in left for q in right if p[0] == q[0] and min(p[3], q[3]) > max(p[2], q[2]))
    got = intervals.overlap_join(a, b, bucket_us=bucket)
    assert rows(got, "occ_id", "utt_id", "overlap_us") == sorted(want, key=repr)
    left_too = intervals.overlap_join(a, b, "left", bucket_us=bucket)
    met = {w[0] for w in want}
    assert rows(left_too, "occ_id", "utt_id", "overlap_us") == sorted([*want, *((p[1], None, None) for p in left if p[1] not in met)], key=repr)


@pytest.mark.parametrize("bucket", [None, 7])
def test_containment_join(spark, bucket):
    rng = random.Random(6)
    left, right = random_intervals(rng, 60, "l"), random_intervals(rng, 60, "r")
    a = spark.createDataFrame(left, "media_id long, occ_id long, start_us long, end_us long, x string")
    b = spark.createDataFrame(right, "media_id long, utt_id long, start_us long, end_us long, y string")
    want = sorted((p[1], q[1]) for p in left for q in right if p[0] == q[0] and q[2] >= p[2] and q[3] <= p[3])
    assert rows(intervals.containment_join(a, b, bucket_us=bucket), "occ_id", "utt_id") == sorted(want, key=repr)


def test_alignment_of_the_scenario(spark):
    occ, utt, _ = scenario(spark)
    al = alignment.align(occ, utt)
    assert rows(al, "occ_id", "utt_id", (F.col("overlap_us") / 1000).cast("int")) == [(0, 0, 1300), (0, 1, 100), (1, 1, 900), (1, 2, 1200), (2, 3, 1200), (4, 4, 1000)]
    assert rows(al.filter("is_primary"), "utt_id", "occ_id") == [(0, 0), (1, 1), (2, 1), (3, 2), (4, 4)]
    assert rows(alignment.silent(occ, al), "occ_id") == [(3,)] and rows(alignment.orphans(utt, al), "utt_id") == []
    table = alignment.alignment_table(occ, al, utt)
    assert table.count() == 7 and table.filter("utt_id IS NULL").count() == 1
    assert rows(alignment.align_stats(occ, utt, al), "alignments", "primaries", "orphans", "silent") == [(6, 5, 0, 1)]


def test_primary_ties_go_to_the_earlier(spark):
    occ = spark.createDataFrame([(1, 0, 0, 1000, "a", "stable"), (1, 1, 1000, 2000, "b", "stable")], OCC)
    utt = spark.createDataFrame([(1, 0, 500, 1500, "x")], UTT)
    assert rows(alignment.align(occ, utt).filter("is_primary"), "occ_id") == [(0,)]


def test_coverage_is_whole(spark):
    rng = random.Random(9)
    spans = [(m, k, s, s + rng.randint(0, 30), "x", "stable") for m in (1, 2) for k in range(12) for s in [rng.randint(0, 90)]]
    occ = spark.createDataFrame(spans, OCC)
    media = spark.createDataFrame([(1, 100), (2, 150), (3, 40)], "media_id long, duration_us long")
    holes = intervals.uncovered(occ, media).collect()
    for m, duration in ((1, 100), (2, 150), (3, 40)):
        covered = set()
        for s in spans:
            if s[0] == m:
                covered |= set(range(s[2], s[3]))
        free = [t for h in holes if h.media_id == m for t in range(h.start_us, h.end_us)]
        assert len(free) == len(set(free)) and set(free) == set(range(duration)) - covered


def test_merge_equal(spark):
    occ = spark.createDataFrame([(1, 0, 0, 10, "a", "stable"), (1, 1, 10, 20, "a", "short"), (1, 2, 21, 30, "a", "stable"), (1, 3, 30, 40, None, "stable"), (1, 4, 40, 50, None, "stable"), (1, 5, 50, 60, "b", "stable")], OCC)
    assert rows(states.merge_equal(occ), "occ_id", "start_us", "end_us", "members") == [(0, 0, 20, 2), (2, 21, 30, 1), (3, 30, 40, 1), (4, 40, 50, 1), (5, 50, 60, 1)]
    assert rows(states.change_events(occ), "occ_id") == [(1,)]
    assert rows(states.merge_deferred(occ), "deferred") == [(1,)]
    assert rows(states.unextracted_runs(occ), "start_us", "end_us", "members", "run") == [(30, 50, 2, 1)]


def test_bursts(spark):
    four = [(1, k, k * 100_000, (k + 1) * 100_000, None, "blank" if k == 0 else "short") for k in range(4)]
    three = [(2, 10 + k, k * 100_000, (k + 1) * 100_000, None, "short") for k in range(3)]
    got = states.bursts(spark.createDataFrame(four + three, OCC))
    assert rows(got, "occ_id", "new_kind") == sorted([(0, "transition"), (1, "transition"), (2, "transition"), (3, "short"), (10, "short"), (11, "short"), (12, "short")], key=repr)


def test_flag_merge_keeps_the_first_arrays_flag(spark):
    a, b = F.array(F.lit("not_extracted"), F.lit("x")), F.array(F.lit("not_extracted"), F.lit("y"))
    assert spark.range(1).select(states.flag_merge(a, b, "not_extracted")).first()[0] == ["not_extracted", "x", "y"]


def test_gap_of_the_scenario(spark):
    occ, utt, _ = scenario(spark)
    occ = occ.withColumn("skipped", F.col("state_kind") == "short")
    none = spark.createDataFrame([], "occ_id long")
    got = gaps.find_gaps(occ, utt, none, least_us=0).first()
    assert (got.reason, got.duration_us, got.utterances, got.neighbours_differ, round(got.score, 6)) == ("skipped_short", 100_000, 0, True, 2.01)
    assert gaps.find_gaps(occ, utt, none).count() == 0
    failed = spark.createDataFrame([(3,)], "occ_id long")
    assert gaps.find_gaps(occ, utt, failed).first().reason == "failed"


def test_blocks_of_the_scenario(spark):
    occ, utt, bodies = scenario(spark)
    members = blocks.block_members(occ, bodies)
    assert [(r.kind, r.occ_ids) for r in blocks.blocks(members).orderBy("block_index").collect()] == [("single", [0]), ("unit_edited", [1, 2]), ("unextracted", [3]), ("single", [4])]
    assert [r.label for r in members.orderBy("occ_id").collect()] == ["first", "first", "modified", "unextracted", "first"]
    refs = blocks.block_refs(members, alignment.align(occ, utt), occ).orderBy("block_index").collect()
    assert [r.utt_ids for r in refs] == [[0, 1], [1, 2, 3], None, [4]] and refs[1].content_ids == ["c12", "c13"]
    assert blocks.block_stats(members).first().asDict() == {"blocks": 4, "unit_blocks": 1, "unextracted_blocks": 1, "edited_units": 1, "occurrences": 5, "repeat_displays": 0, "modified_displays": 1}


def test_typing_is_one_edited_unit(spark):
    lines = ["def f():", "    a = 1", "    b = 2", "    c = 3", "    d = 4"]
    bodies = ["\n".join(lines[:3]), "\n".join(lines[:4]), "\n".join([*lines[:3], "    c = 9"]), "\n".join([*lines[:3], "    c = 9", lines[4]])]
    occ = spark.createDataFrame([(1, k, k * 1_000_000, (k + 1) * 1_000_000, f"c{k}", "stable") for k in range(4)], OCC)
    body = spark.createDataFrame([(f"c{k}", "code", "t.py", "t.py", b) for k, b in enumerate(bodies)], "content_id string, screen_kind string, heading string, title string, body_text string")
    got = blocks.blocks(blocks.block_members(occ, body)).collect()
    assert [(r.kind, r.members) for r in got] == [("unit_edited", 4)]


def test_waiting_states_join_only_with_a_later_member(spark):
    occ = spark.createDataFrame([(1, 0, 0, 10, "a", "stable"), (1, 1, 10, 20, None, "short"), (1, 2, 20, 30, "a", "stable"), (1, 3, 30, 40, None, "short"), (1, 4, 40, 50, "b", "stable"), (1, 5, 99_000_000, 99_000_010, "b", "stable")], OCC)
    body = spark.createDataFrame([("a", "slide", "x", "x", "one"), ("b", "slide", "y", "y", "two")], "content_id string, screen_kind string, heading string, title string, body_text string")
    got = blocks.blocks(blocks.block_members(occ, body)).orderBy("block_index").collect()
    assert [(r.kind, r.occ_ids) for r in got] == [("unit", [0, 1, 2]), ("unextracted", [3]), ("single", [4]), ("single", [5])]


def test_tiles_join():
    assert regions.join_tiles(list("abc"), list("bcd"), 3) == (list("abcd"), True)
    assert regions.join_tiles(list("ab"), list("xy"), 3) == (list("abxy"), False)
    assert regions.join_tiles(["a", " b c"], ["bc ", "d"], 3) == (["a", " b c", "d"], True)
    assert regions.join_tiles([], ["a"], 3) == (["a"], True)


def test_duplicate_regions(spark):
    assert regions.kept_regions(["a b", "ab", "", "xyz"]) == ([0, 2, 3], {0})
    assert regions.kept_regions(["abcd", "abcdef", "q"]) == ([1, 2], {1})
    assert regions.kept_regions(["abcdefgh", "abc"]) == ([0, 1], set())
    df = spark.createDataFrame([("c", 0, "a b"), ("c", 1, "ab"), ("d", 0, "z")], "content_id string, reading_order int, text string")
    assert rows(regions.drop_duplicates(df), "content_id", "reading_order", "stands") == [("c", 0, True), ("d", 0, False)]


def test_terms_by_place(spark):
    shown = spark.createDataFrame([(1, 0, 10, "alpha_1"), (1, 500_000_000, 500_000_010, "beta_2")], "media_id long, start_us long, end_us long, term string")
    utt = spark.createDataFrame([(1, 7, 5, 20, "alpha_1 beta_2 gamma_3 plain")], UTT)
    assert rows(terms.match_terms(utt, shown), "term", "verdict") == [("alpha_1", "confirmed"), ("beta_2", "elsewhere"), ("gamma_3", "not_found")]


def test_upper_median(spark):
    stamps = spark.createDataFrame([(1, t, k) for k, t in enumerate([0, 1, 3, 6, 10, 10, 30])], "media_id long, t_us long, seq long")
    assert tuple(quality.timestamp_check(stamps).first()) == (1, 7, 1, 3, 1)


def test_chunk_owner_and_plan(spark):
    media = spark.createDataFrame([(1, 0, 25_000_000, 0, 25_000_000)], "media_id long, range_start_us long, range_end_us long, audio_offset_us long, audio_us long")
    plan = audio.chunk_plan(media, chunk_us=10_000_000)
    assert rows(plan, "chunk", "core_start_us", "core_end_us", "start_us", "end_us") == [(0, 0, 10_000_000, 0, 12_000_000), (1, 10_000_000, 20_000_000, 8_000_000, 22_000_000), (2, 20_000_000, 25_000_000, 18_000_000, 25_000_000)]
    seg = spark.createDataFrame([(1, 0, 1, 9_000_000, 11_000_000), (1, 1, 2, 9_000_000, 11_000_000)], "media_id long, chunk long, seg long, start_us long, end_us long")
    assert rows(audio.owned(seg, plan), "seg") == [(2,)]


def test_dedup_across_chunks(spark):
    utt = spark.createDataFrame([(1, 0, 0, 10, "Hello, there."), (1, 1, 5, 12, "hello there"), (1, 2, 11, 20, "hello there"), (1, 3, 30, 40, "x")], UTT).withColumn("chunk", F.expr("case when utt_id = 1 then 1 else 0 end"))
    assert rows(audio.dedup_across_chunks(utt), "utt_id") == [(0,), (2,), (3,)]


def test_levels_and_silence(spark):
    samples = spark.range(0, 320 * 3 + 10).select(F.lit(1).cast("long").alias("media_id"), F.col("id").alias("i"), F.when(F.col("id") < 320, 0.5).otherwise(0.0).alias("x"))
    got = rows(audio.levels(samples), "window", F.round("dbfs", 3))
    assert got == [(0, -6.021), (1, -120.0), (2, -120.0)]
    assert rows(audio.silence(audio.levels(samples), least_us=40_000), "start_us", "end_us") == [(20_000, 60_000)]


def test_contents(spark):
    r = spark.createDataFrame([("c", 0, "heading", "material_body", " T \nx"), ("c", 1, "paragraph", "application_ui", "u"), ("c", 2, "paragraph", "material_body", "b")], "content_id string, reading_order int, kind string, role string, text string")
    assert rows(contents.bodies(r), "body_text", "n_regions") == [(" T \nx\n\nb", 3)]
    assert rows(contents.headings(r), "heading") == [("T ",)]
    a = contents.signatures(r.withColumn("screen_kind", F.lit("slide")), F.trim("text")).first().text_hash
    b = contents.signatures(r.filter("role <> 'application_ui'").withColumn("screen_kind", F.lit("slide")), F.trim("text")).first().text_hash
    assert a == b


def test_state_tables(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert rows(store.upsert(old, new, ["k"]), "k", "v") == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(store.replace_where(old, new, ["k"]), "k", "v") == [(1, "a"), (2, "c"), (3, "d")]
    reviews = spark.createDataFrame([("vision:x", "1", "open"), ("vision:y", "2", "resolved"), ("asr:z", "3", "open")], "reason string, target_ref string, review_status string")
    assert rows(store.clear_open_reviews(reviews, "vision:"), "reason") == [("asr:z",), ("vision:y",)]
    assert rows(store.checks(old, positive="k > 0", short="k < 2"), "rule", "violations") == [("positive", 0), ("short", 1)]
    assert store.orphan_keys(new, old, "k").count() == 1
    text = spark.createDataFrame([("c", 0, "teh", ["x"])], "content_id string, reading_order int, text string, flags array<string>")
    log = spark.createDataFrame([], "content_id string, reading_order int, original string, corrected string")
    fixed, log = store.correct_region(text, log, "c", 0, "the")
    assert rows(fixed, "text", "flags") == [("the", ["user_corrected", "x"])] and rows(log, "original", "corrected") == [("teh", "the")]


def test_subtitles(spark):
    utt = spark.createDataFrame([(1, 0, 0, 0, "a\nb"), (1, 1, 5_000_000, 6_000_000, "c")], UTT)
    assert render.srt(utt).first().text == "1\n00:00:00,000 --> 00:00:00,001\na b\n\n2\n00:00:05,000 --> 00:00:06,000\nc\n"


def documents_of(spark, occ, utt, bodies, **more):
    members, al = blocks.block_members(occ, bodies), alignment.align(occ, utt)
    media = spark.createDataFrame([(1, 12_000_000)], "media_id long, duration_us long")
    region = spark.createDataFrame([("s11", 0, "heading", "material_body", "Agenda"), ("s11", 1, "bullet", "material_body", "one\ntwo"), ("s11", 2, "text", "application_ui", "File  Edit"), ("s11", 3, "text", "material_context", "Week 1"), ("c12", 0, "code", "material_body", "x = 1"), ("c13", 0, "code", "material_body", "x = `2`")], "content_id string, reading_order int, kind string, role string, text string")
    coded = bodies.withColumn("is_code", F.col("screen_kind") == "code")
    return render.documents(lecture.material_lines(members, occ, coded, utt, al)).first().text, render.documents(lecture.lecture_lines(members, occ, bodies, region, utt, al, media)).first().text


def test_documents(spark):
    occ, utt, bodies = scenario(spark)
    utt = utt.union(spark.createDataFrame([(1, 9, 11_000_000, 11_500_000, "too late")], UTT))
    material, record = documents_of(spark, occ, utt, bodies)
    assert material.startswith("## 0:00:00.000 – 0:00:02.000 Lecture 1\n\nAgenda\none\ntwo\n\n**Speech**\n- `0:00:00.500 – 0:00:01.800` a\n")
    assert "```\ndef total" in material and material.rstrip().endswith("## Speech outside all units\n\n- `0:00:11.000 – 0:00:11.500` too late <!-- 9 -->")
    assert "### Agenda" in record and "- one\n- two" in record and "- Context: Week 1" in record and "```\nx = `2`\n```" in record
    assert "**Speech that goes on elsewhere**" in record and "- No screen: 0:00:09.100 – 0:00:12.000" in record
    assert record.rstrip().endswith("File  Edit") and "## Appendix" in record


@pytest.mark.parametrize("seed", range(3))
def test_every_utterance_is_in_both_documents(spark, seed):
    """Whatever the screens: units without text, gaps, zero lengths, several displays of one utterance."""
    rng = random.Random(seed)
    occ, at = [], 0
    for k in range(25):
        start = at + rng.choice([0, 0, 500_000])
        at = start + rng.choice([0, 100_000, 1_000_000, 3_000_000])
        occ.append((1, k, start, at, rng.choice(["s11", "c12", "c13", None, None]), rng.choice(["stable", "short"])))
    utt = [(1, k, s := rng.randint(0, at + 2_000_000), s + rng.choice([0, 1, 700_000, 4_000_000]), f"said{k}x") for k in range(40)]
    _, _, bodies = scenario(spark)
    for text in documents_of(spark, spark.createDataFrame(occ, OCC), spark.createDataFrame(utt, UTT), bodies):
        assert all(f"said{k}x" in text for k in range(40))


def test_report_has_every_row(spark):
    table = spark.range(1500).selectExpr("id", "cast(null as string) as none")
    lines = [r.line for r in render.report_lines("T", [("A", table), ("B", table.limit(1))]).collect()]
    assert lines[0] == "# T" and lines[1].startswith("\n## A") and len(lines) == 1504 and "| 1499 |  |" in lines and lines[-1] == "| 0 |  |"


def test_measures_and_sizes(spark):
    from tidemark.functions import geometry

    log = store.append_metric(store.append_metric(spark.createDataFrame([], "stage string, name string, value double, unit string"), "scan", "rate", 85.5, "fps"), "scan", "states", 39)
    assert rows(store.shown_metrics(log), "shown") == [("39",), ("85.500fps",)]
    occ, utt, _ = scenario(spark)
    reviews = spark.createDataFrame([("a", "open"), ("b", "resolved")], "reason string, review_status string")
    assert tuple(store.status_counts(occ, utt, reviews).first()) == (5, 4, 5, 1)
    flags = spark.createDataFrame([(["x", "change:repeat"], "c"), ([], None), (None, "c")], "flags array<string>, content_id string")
    assert [r[0] for r in flags.select(states.change_kind(F.col("flags"), F.col("content_id"))).collect()] == ["repeat", "unextracted", "first"]
    one = spark.range(1)
    size = lambda w, h: tuple(one.select(geometry.full_image_size(F.lit(w), F.lit(h), 2048)).first()[0])
    assert size(4096, 1000) == (2048, 500, 0.5) and size(100, 50) == (100, 50, 1.0)
    factor = lambda w, h: one.select(geometry.upscale_factor(F.lit(w), F.lit(h), 100_000)).first()[0]
    assert (factor(50, 20), factor(50, 48), factor(500, 200)) == (3.0, 2.0, 1.0) and round(factor(1000, 90), 3) == 1.054
    told = lambda *x: tuple(one.select(audio.audio_mismatch(*[F.lit(v).cast("long") for v in x])).first()[0])
    assert told(1_000_000, 1_300_000, 0, 0) == (1_300_000, -300_000, True) and told(1_000_000, None, 1_250_000, 100_000) == (1_150_000, -150_000, False) and told(5, None, None, 0) == (None, None, False)


def test_repair_of_repeated_regions(spark):
    long = "a region with quite some words in it that was read twice by the model"
    df = spark.createDataFrame([("c", 0, long, ["x"]), ("c", 1, long, []), ("d", 0, "short", [])], "content_id string, reading_order int, text string, flags array<string>")
    same, told = store.repaired(df, dry_run=True)
    assert same is df and rows(told, "content_id", "regions_before", "regions_after") == [("c", 2, 1)]
    fixed, _ = store.repaired(df)
    assert fixed.count() == 2 and fixed.filter("array_contains(flags, 'duplicate_regions_removed')").count() == 1


def test_json_lines_keep_nulls(spark):
    occ, _, _ = scenario(spark)
    assert '"content_id":null' in render.json_lines(occ.filter("occ_id = 3")).first().value


def test_small_changes_inherit(spark):
    schema = "media_id long, occ_id long, start_us long, end_us long, content_id string, change_share double, area_before string, area_after string"
    df = spark.createDataFrame([(1, 0, 0, 1, "a", None, None, None), (1, 1, 1, 2, "b", 0.1, "x", "x"), (1, 2, 2, 3, "c", 0.15, "y", "y"), (1, 3, 3, 4, "d", 0.1, "x", "z"), (1, 4, 4, 5, "e", 0.2, "x", "x")], schema)
    assert rows(states.inherit_content(df), "occ_id", "content_id", "inherited") == [(0, "a", False), (1, "a", True), (2, "a", True), (3, "d", False), (4, "e", False)]


def test_unextracted_blocks_merge(spark):
    df = spark.createDataFrame([(1, 0, "single", 0, 1), (1, 1, "unextracted", 1, 2), (1, 2, "unextracted", 2, 5), (1, 3, "single", 5, 6), (1, 4, "single", 6, 7)], "media_id long, block_index int, kind string, start_us long, end_us long")
    assert rows(states.merge_unextracted(df), "block_index", "start_us", "end_us", "blocks") == [(0, 0, 1, 1), (1, 1, 5, 2), (3, 5, 6, 1), (4, 6, 7, 1)]


def test_outline_and_notes(spark):
    occ, utt, bodies = scenario(spark)
    index = spark.createDataFrame([("total", "total", 2, 1, 2_000_000)], "term string, surface string, shown long, said long, first_us long")
    text = render.documents(render.outline_lines(index, states.versions(occ), bodies)).first().text
    assert text.splitlines() == ["- 0:00:00.000 Lecture 1", "- 0:00:02.000 total.py", "- 0:00:04.500 total.py", "- 0:00:07.100 Lecture 1", "- total: 2 / 1 (0:00:02.000)"]
    note = lambda n, g: render.structure_note(F.lit(n), F.lit("a"), F.lit("b"), F.lit("one_way"), F.array(*[F.lit(x) for x in g]))
    assert tuple(spark.range(1).select(note("x", ["g", "h"]), note(" ", [])).first()) == ("> x\n> a → b\n> g, h", "")
