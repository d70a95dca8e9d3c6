"""Every query with SQL against DuckDB on the smallest data set, and the others for their shape."""

import datetime
import math

import pytest

from millrace.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return None if math.isnan(v) else round(float(v), 5)
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, data, duck, name):
    df = registry.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(columns).collect()), key=str)
    cursor = duck.execute(registry.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_runs(spark, data, name):
    assert registry.QUERIES[name](spark, data).limit(5).count() > 0


def test_entry():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
