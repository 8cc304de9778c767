"""Every registered query against its DuckDB oracle at the smallest scale."""

import datetime as dt
import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as E
from quarry.queries import QUERIES

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(str(_norm(r[i])) for i in order) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, sf_dir, duck, key):
    df = E.queries()[key](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    sql = E.oracle_sql().get(key)
    assert sql is not None, "every key has an oracle"
    res = duck.sql(sql)
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(res.columns)
    assert len(rows) == len(orows)
    assert _digest(df.columns, rows) == _digest(res.columns, orows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["panel", "kind", "rank", "x", "x2", "y", "y2"]
