"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from dialogscope.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _value(x):
    if x is None or x != x:
        return "null"
    if isinstance(x, (bool, str)):
        return str(x)
    return f"{float(x):.6g}" if isinstance(x, (int, float)) and math.isfinite(x) else str(x)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = duck.sql(registry.ORACLE_SQL[name])
    assert columns == sorted(result.columns)
    at = [result.columns.index(c) for c in columns]
    want = sorted(tuple(_value(r[i]) for i in at) for r in result.limit(10**9).fetchall())
    assert sorted(tuple(map(_value, r)) for r in df.select(*columns).collect()) == want
