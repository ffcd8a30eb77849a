from pyspark.sql import functions as F

from tidemark.functions import geometry, text, timecode


def one(spark, *columns, **values):
    rows = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return tuple(rows.select(*columns).first())


def test_presentation_stamps(spark):
    f = timecode.pts_to_us
    got = one(spark, f(90000, 1, 90000), f(1001, 1, 30000), f(90000, 1, 90000, 500000), f(-1001, 1, 30000), f(1, 1, 2_000_000), f(10**13, 1, 90000))
    assert got == (1_000_000, 33_367, 500_000, -33_367, 1, 111_111_111_111_111)


def test_stamps(spark):
    t = 3_723_456_000
    got = one(spark, timecode.format_timestamp(t), timecode.format_timestamp(-t, False), timecode.format_srt(t), timecode.format_srt(-5), timecode.format_timestamp(F.lit(0).cast("long")))
    assert got == ("1:02:03.456", "-1:02:03", "01:02:03,456", "00:00:00,000", "0:00:00.000")


def test_seconds_round_to_even(spark):
    assert one(spark, timecode.seconds_to_us(F.lit(0.0000025)), timecode.seconds_to_us(F.lit(1.5)), timecode.us_to_seconds(F.lit(1_500_000))) == (2, 1_500_000, 1.5)


def test_overlap(spark):
    o = timecode.overlap_us
    assert one(spark, o(0, 100, 50, 150), o(0, 100, 100, 150), o(0, 100, 50, 50)) == (50, 0, 0)


def test_parse_time(spark):
    p = lambda s: timecode.parse_time(F.lit(s))
    assert one(spark, p("12.5"), p("1:23"), p("0:01:23.456"), p(""), p("1:2:3:4")) == (12_500_000, 83_000_000, 83_456_000, None, None)


def test_rates(spark):
    r = lambda s: timecode.rate(F.lit(s))
    got = one(spark, r("30000/1001"), r("0/0"), r("N/A"), r("25"), r("x/1"))
    assert round(got[0], 6) == round(30000 / 1001, 6) and got[1:] == (None, None, 25.0, None)


def test_code_key(spark):
    k = lambda s: text.code_key(F.lit(s))
    a, b, c, d, e, f = one(spark, k("  x = 0"), k("x = 0"), k("x = 0  \r\ny\t"), k("x = 0\ny"), k("x = 1"), k("\n\nx\n"))
    assert a != b and c == d and b != e and f == "x"


def test_prose_key(spark):
    k = lambda s: text.prose_key(F.lit(s))
    assert one(spark, k("Ａ１　ｂ"), k("“a” – b  \n   c "), k("a\u3000\u3000b")) == ("A1 b", '"a" - b\nc', "a b")


def test_utterance_key(spark):
    k = lambda s: text.utterance_key(F.lit(s))
    a, b, c = one(spark, k("これは、テストです。"), k("これはテストです"), k(" Hello,  WORLD! "))
    assert a == b and c == "hello world"


def test_terms(spark):
    vocabulary = F.array(F.lit("plain"))
    got = one(spark, text.spoken_terms(F.lit("Use snake_case and camelCase, plain words, about utf-8")), text.spoken_terms(F.lit("plain Words snake_case"), vocabulary), text.index_terms(F.lit("Server the The server_1 abc Alpha")))
    assert got == (["camelcase", "snake_case", "utf-8"], ["plain", "snake_case"], ["Server", "server_1", "Alpha"])


def test_sequence_ratio(spark):
    assert one(spark, text.sequence_ratio("a", "b"), a="abcd", b="bcde") == (0.75,)


def test_similarity(spark):
    m = lambda a, b: text.material_similarity(F.lit(a), F.lit(b))
    got = one(spark, m("a\nb\n c ", "c\na\n\n"), m("", "a"), m("a\na", "a"))
    assert tuple(round(x, 4) for x in got) == (0.6667, 0.0, 1.0)


def test_markdown(spark):
    e = lambda s: text.escape_markdown(F.lit(s))
    assert one(spark, e("# a*b\n- c\n 1. d\ne_f [g] \\"), text.fence(F.lit("plain")), text.fence(F.lit("a ``` b")), text.fence(F.lit("`````"))) == ("\\# a\\*b\n\\- c\n \\1. d\ne\\_f \\[g\\] \\\\", "```", "````", "``````")


def test_line_changes(spark):
    got = one(spark, text.line_changes(F.lit("a\nb\nb"), F.lit("a\nc")))[0]
    assert (got.added, got.removed, got.added_lines, got.removed_lines) == (2, 1, "b / b", "c")


def test_link(spark):
    assert one(spark, text.time_link("p", "s"), p="C:\\a b\\ü.mp4", s=1.5) == ("C:/a%20b/%C3%BC.mp4#t=1.500",)


def test_boxes(spark):
    c = lambda *v, pad=0.0: geometry.clamp_bbox(*[F.lit(float(x)) for x in v], F.lit(100), F.lit(50), pad)
    got = one(spark, c(0, 0, 1, 1), c(0.5, 0.5, 0.25, 0.25), c(10, 10, 20, 20), c(200, 10, 300, 20), geometry.parse_bbox(F.lit("[1, 2, x, 3, 4, 5]")), geometry.parse_bbox(F.lit("1,2")))
    assert [tuple(x) for x in got[:3]] == [(0, 0, 100, 50), (21, 8, 54, 29), (6, 6, 24, 24)]
    assert tuple(got[3]) == (196, 6, 100, 24) and got[4] == [1.0, 2.0, 3.0, 4.0] and got[5] == [0.0, 0.0, 1.0, 1.0]


def test_tiles(spark):
    plan = lambda h: geometry.tile_plan(F.lit(h))
    a, b = one(spark, plan(1000), plan(2500))
    assert [tuple(x) for x in a] == [(0, 1000)] and [tuple(x) for x in b] == [(0, 1100), (902, 2002), (1804, 2500)]
