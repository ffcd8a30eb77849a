"""The pipeline against plain versions of its stages, and every query that has SQL against it."""

import os

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import mixing, queries

from . import brute

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Nulls in any column, a repeated row, columns whose names the operators use themselves."""
    path = str(tmp_path_factory.mktemp("sf"))
    rows = brute.corpus(seed=11, n=80)
    spark.createDataFrame(rows, brute.SCHEMA).coalesce(2).write.parquet(f"{path}/documents.parquet")
    return path, rows


def test_pipeline(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    good = [r for r in rows if brute.rules(r[1])[-1]]
    stay = {d for d, _, _, k, _ in brute.exact(good) if k}
    once = [r for r in good if r[0] in stay]
    apart = {d for d, _, _, k in brute.near(once, 80) if k}
    kept = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES[:3], ([r[0] for r in good], stay, apart), strict=True):
        kept = stage(spark, kept, path)
        assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(want, key=repr), name
    assert 0 < len(apart) < len(stay) < len(good) < len(rows)
    taken = {r.doc_id: r.taken for r in mixing.mix_report(docs.filter(docs.doc_id.isin(list(apart))).dropDuplicates(["doc_id"])).collect()}
    t, text, have = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {r[0]: r[1] for r in rows}, dict.fromkeys(taken, 0)
    for r in corpus_pipeline.run(spark, path).collect():
        said = t.decode(list(r.ids), skip_special_tokens=False)
        assert r.n_tokens == len(r.ids) and t.encode(said, add_special_tokens=False).ids == list(r.ids)
        assert not set(brute.words(said)) - set(brute.words(text[r.doc_id]))
        have[r.doc_id] += len(brute.words(said))
    assert have == taken


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    df = queries.QUERIES[name](spark, DATA)
    columns = ", ".join(sorted(df.columns))
    got = sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)
    assert got == sorted(con.execute(f"SELECT {columns} FROM ({queries.ORACLE_SQL[name]})").fetchall(), key=repr)
