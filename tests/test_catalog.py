"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidewire.plans import catalog, day_catalog

assert day_catalog


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    norm = lambda x: round(x, 6) if isinstance(x, float) else x
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{small}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, small, duck, name):
    df = catalog.QUERIES[name](spark, small)
    data = [tuple(r) for r in df.collect()]
    if name in catalog.ORACLE:
        want = duck.execute(catalog.ORACLE[name])
        names = [x[0] for x in want.description]
        assert sorted(df.columns) == sorted(names)
        assert rows(df.columns, data) == rows(names, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
