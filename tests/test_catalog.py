"""Every registered query against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from tidemark import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for n in TABLES:
        c.sql(f"CREATE VIEW {n} AS SELECT * FROM '{small}/{n}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows(spark, small, duck, name):
    got = catalog.QUERIES[name](spark, small)
    want = duck.sql(catalog.ORACLES[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    rows = lambda cols, data: sorted((tuple(plain(r[cols.index(k)]) for k in order) for r in data), key=str)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
