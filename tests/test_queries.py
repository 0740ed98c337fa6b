import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def ordered(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, folder, db, name):
    df = QUERIES[name](spark, folder)
    want = db.sql(SQL[name])
    columns, rows = want.columns, want.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert ordered(df.columns, [tuple(r) for r in df.collect()]) == ordered(columns, rows)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {"accuracy", "macro avg", "weighted avg"} <= {r["class"] for r in rows}


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
