"""Every registered query against its SQL counterpart, on the smallest dataset."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def canonical(rows, order):
    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else v + 0.0
        return v
    picked = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(picked, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == columns
    got = canonical(df.collect(), [df.columns.index(c) for c in columns])
    expected = canonical(want.fetchall(), [want.columns.index(c) for c in columns])
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry_has_a_stable_schema(spark):
    first, second = entry.entry(spark), entry.entry(spark)
    assert first.schema == second.schema and first.count() > 0
