"""Every registered query with SQL gives what DuckDB gives, on the smallest tables."""

import math

import pytest

from metaloom.adapters import TABLES
from metaloom.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, int | float):
        return round(float(v), 5)
    if hasattr(v, "replace") and hasattr(v, "tzinfo"):
        return str(v.replace(tzinfo=None))
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    result = duck.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    want = sorted((tuple(plain(dict(zip(columns, r, strict=True))[c]) for c in order) for r in result.fetchall()), key=repr)
    rows = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=repr)
    assert rows == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
