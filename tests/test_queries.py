"""Every registered query against its SQL on a second engine, over whole tables."""

import os

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {n: f for n, f in E.queries().items() if n in E.QUERIES}
SQL = {n: q for n, q in E.oracle_sql().items() if n in E.QUERIES}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = canon([tuple(r) for r in df.collect()], df.columns)
    assert got, "no rows"
    if name in SQL:
        res = db.execute(SQL[name])
        columns = [c[0] for c in res.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == canon(res.fetchall(), columns)


def test_contract(spark):
    assert set(SQL) <= set(QUERIES)
    assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
