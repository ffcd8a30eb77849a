"""Queries where tables are large: sums beyond 64 bits, long timelines, what is shuffled."""

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import audio, blocks, terms
from tidemark.plans import timeline


@pytest.mark.parametrize("name", ["align_large", "align_large_bucketed"])
def test_overlap_sums_beyond_64_bits(spark, tmp_path, name):
    orders = spark.createDataFrame([(1, 7, "O", datetime(2024, 1, 1)), (2, 7, "F", datetime(9000, 1, 1))], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz")
    lines = spark.range(60).select(F.lit(1).cast("long").alias("l_orderkey"), F.col("id").cast("int").alias("l_linenumber"), F.lit(1).cast("long").alias("l_partkey"), F.lit(1).cast("long").alias("l_suppkey"), F.lit(2_500_000.0).alias("l_quantity"), F.expr("TIMESTAMP_NTZ'2024-01-01'").alias("l_shipdate"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    span = (datetime(9000, 1, 1) - datetime(2024, 1, 1)).days
    got = {r.content_id: tuple(r) for r in timeline.Q[name](spark, str(tmp_path)).collect()}
    assert got["O"] == ("O", 60, 60 * min(span, 2_500_000) * timeline.DAY, 60) and got["O"][2] > 2**63
    assert dict(timeline.Q[name](spark, "/root/testdata/sf0.001").dtypes)["overlap_us"] == "bigint"


def test_silence_late_in_a_long_recording(spark):
    levels = spark.createDataFrame([(1, w, -60.0) for w in range(200_000, 200_005)], "media_id long, window int, dbfs double")
    assert [tuple(r) for r in audio.silence(levels, least_us=60_000).select("start_us", "end_us").collect()] == [(4_000_000_000, 4_000_100_000)]


def shows(spark, seed):
    rng = random.Random(seed)
    lines = [f"line {k}" for k in range(12)]
    bodies = {k: "\n".join(rng.choice([x, f" {x}\t", ""]) for x in rng.choices(lines, k=rng.randint(0, 6))) for k in range(15)}
    about = {k: rng.choice(["x", "y", None]) for k in bodies}
    occ, at = [], 0
    for k in range(120):
        start = at + rng.choice([0, 0, 0, 5, 40])
        at = start + rng.choice([0, 1, 10])
        occ.append((1, k, start, at, rng.choice([None, 99, *bodies, *bodies]), rng.choice(["stable", "short"])))
    body = spark.createDataFrame([(k, "slide", about[k], "t", b) for k, b in bodies.items()], "content_id long, screen_kind string, heading string, title string, body_text string")
    return occ, spark.createDataFrame(occ, "media_id long, occ_id long, start_us long, end_us long, content_id long, state_kind string"), bodies, about, body


@pytest.mark.parametrize("seed", range(2))
def test_blocks_by_line_hashes_equal_blocks_by_whole_lines(spark, seed):
    occ, table, bodies, about, body = shows(spark, seed)
    rule = blocks.BlockRule(max_gap_us=20, max_duration_us=300, similarity=0.3)
    whole = lambda c: blocks.Lines(len(x := blocks.body_lines(bodies.get(c, ""))), frozenset(x))
    timeline_ = [blocks.Shown(o, s, e, kind, c, whole(c), ("slide", about[c]) if c in about else (None, None), "t") for _, o, s, e, c, kind in sorted(occ, key=lambda r: (r[2], r[3], r[1]))]
    want = [(x.occ, index, label, x.kind, x.content) for index, (_, members) in enumerate(blocks.fold(timeline_, rule)) for x, label in members]
    got = blocks.block_members(table, body, rule).orderBy("occ_id").select("occ_id", "block_index", "label", "state_kind", "content_id").collect()
    assert [tuple(r) for r in got] == sorted(want) and {"repeat", "modified"} <= {r.label for r in got}


def test_bodies_are_not_shuffled_with_the_intervals(spark):
    _, table, _, _, body = shows(spark, 0)
    plan = blocks.block_members(table, body)._jdf.queryExecution().optimizedPlan().toString()
    assert "body_text" not in plan.split("RepartitionByExpression")[1].splitlines()[1]


@pytest.mark.parametrize("whole", [False, True])
def test_documents_share_their_tables(spark, whole):
    plan = timeline._documents(spark, "/root/testdata/sf0.001", whole)._jdf.queryExecution().optimizedPlan().toString()
    joins = len(re.findall(r"(?m)^[\s:+|-]*Join (?:Inner|Left|Cross)", plan))
    print("joins", joins)
    assert joins <= (8 if not whole else 20)


def test_terms_meet_by_time_before_their_words(spark):
    rng, m = random.Random(3), 60_000_000
    bodies = {k: [f"term_{x}" for x in rng.sample(range(12), 4)] for k in range(6)}
    occ = [(rng.randint(1, 3), k, s := rng.randint(0, 40) * m, s + rng.choice([0, m, 3 * m]), rng.choice([None, *bodies])) for k in range(40)]
    utt = [(rng.randint(1, 4), k, s := rng.randint(0, 40) * m, s + 12_000_000, f"term_{rng.randint(0, 13)} plain") for k in range(60)]
    shows = spark.createDataFrame(occ, "media_id long, occ_id long, start_us long, end_us long, content_id long")
    body = spark.createDataFrame([(k, " ".join(v)) for k, v in bodies.items()], "content_id long, body_text string")
    want = []
    for media, k, start, end, text in utt:
        term = text.split()[0]
        spans = [(s, e) for m_, _, s, e, c in occ if m_ == media and c is not None and term in bodies[c]]
        near = any(min(e, end + 2 * m) - max(s, start - 2 * m) > 0 for s, e in spans)
        want.append((k, term, "confirmed" if near else "elsewhere" if spans else "not_found"))
    out = terms.match_shown(spark.createDataFrame(utt, "media_id long, utt_id long, start_us long, end_us long, text string"), shows, body).select("utt_id", "term", "verdict")
    assert sorted(tuple(r) for r in out.collect()) == sorted(want) and len({w[2] for w in want}) == 3
    spread = out._jdf.queryExecution().optimizedPlan().toString().split("explode(sequence(")[1].splitlines()
    assert "term" not in spread[1]
