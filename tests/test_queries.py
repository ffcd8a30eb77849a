"""Every timeline query against its SQL, on the smallest tables."""

import math
import os
from datetime import datetime

import duckdb
import pytest

import __spark_entry__
from tidemark.plans import sql, timeline

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = sql.statements()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str | datetime):
        return v
    return None if isinstance(v, float) and math.isnan(v) else round(float(v), 6)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = timeline.Q[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_query_is_registered():
    assert set(timeline.Q) <= set(__spark_entry__.queries()) and set(SQL) <= set(timeline.Q)


def test_blocks_show_documents_of_the_whole_table(spark):
    data = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id")
    shown = timeline._doc_shows(spark, data).join(docs.withColumnRenamed("doc_id", "content_id"), "content_id").select("content_id").distinct().count()
    print("documents shown", shown, "of", docs.count())
    assert shown > 0.9 * docs.count()
