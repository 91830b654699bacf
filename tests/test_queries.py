"""Every registered core query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from tallyloom.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(str(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_like_sql(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    con = db.execute(queries.ORACLE_SQL[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in con.description], con.fetchall())
