import json

from pyspark.sql import functions as F

from tidemark.cli import main

from .test_operators import scenario


def test_commands(spark, tmp_path, capsys):
    occ, utt, body = scenario(spark)
    folder = str(tmp_path / "in")
    occ.withColumn("flags", F.when(F.col("state_kind") == "short", F.array(F.lit("short_or_transition"))).otherwise(F.array().cast("array<string>"))).write.parquet(f"{folder}/occurrences")
    utt.write.parquet(f"{folder}/utterances")
    body.write.parquet(f"{folder}/contents")
    spark.createDataFrame([(1, 10_000_000)], "media_id long, duration_us long").write.parquet(f"{folder}/media")
    spark.createDataFrame([("r1", "3", "vision:extraction_failed", "open")], "review_id string, target_ref string, reason string, review_status string").write.parquet(f"{folder}/reviews")
    spark.createDataFrame([("s11", 0, "heading", "material_body", "Agenda")], "content_id string, reading_order int, kind string, role string, text string").write.parquet(f"{folder}/regions")
    assert main(["gaps", folder, "--min-duration", "0", "--jsonl", str(tmp_path / "gaps")], spark) == 0
    row = json.loads(capsys.readouterr().out)
    assert (row["reason"], row["start"], row["end"], row["score"]) == ("failed", "0:00:07.000", "0:00:07.100", 5.01)
    assert main(["export", folder, str(tmp_path / "out")], spark) == 0
    cues = "".join(p.read_text() for p in (tmp_path / "out/transcript.srt/media_id=1").glob("part-*"))
    assert cues.startswith("1\n00:00:00,500 --> 00:00:01,800\na\n")
    assert len("".join(p.read_text() for p in (tmp_path / "out/alignment_table.jsonl/media_id=1").glob("part-*")).splitlines()) == 7
    assert main(["report", folder], spark) == 0
    assert "| occurrences | 5 |" in capsys.readouterr().out
    assert main(["resolve", folder, "r1", str(tmp_path / "reviews")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "reviews")).first().review_status == "resolved"
    capsys.readouterr()
    assert main(["status", folder], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"occurrences": 5, "extracted": 4, "utterances": 5, "open_reviews": 1}
    assert main(["review", folder, "--reason", "vision:"], spark) == 0
    assert json.loads(capsys.readouterr().out)["review_id"] == "r1"
    assert main(["correct", folder, "s11", "0", "The agenda", str(tmp_path / "fixed")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "fixed/bodies")).first().body_text == "The agenda"
    text = "".join(p.read_text() for p in (tmp_path / "out/lecture.md/media_id=1").glob("part-*"))
    assert text.startswith("## Block 1 — Lecture 1") and "### Agenda" in text
