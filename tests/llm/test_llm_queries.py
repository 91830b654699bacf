"""Registered corpus queries: those with SQL against it, the pipeline stage by stage against its parts."""

import os

import duckdb
import pytest

import corpus_pipeline
from tallyloom.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(str(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_like_sql(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    con = db.execute(queries.ORACLE_SQL[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in con.description], con.fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, SF), "test-stage")
        assert out.columns == columns and out.join(docs, "doc_id", "left_anti").isEmpty()
        assert 0 < out.count() <= left
        docs, left = out, out.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    from tallyloom.llm.pieces import decoded

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"]: r["text"] for r in decoded(last).collect()} == texts
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(texts)
