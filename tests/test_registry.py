"""Every query against its DuckDB oracle on the smallest tables."""

import math
import os

import duckdb
import pytest

from quernstone.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_parity(spark, oracle, name):
    query, sql = registry.QUERIES[name]
    got = query(spark, SF)
    columns = sorted(got.columns)
    rows = sorted((tuple(norm(r[c]) for c in columns) for r in got.collect()), key=repr)
    if sql is None:
        assert rows
        return
    want = oracle.sql(sql)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=repr)
