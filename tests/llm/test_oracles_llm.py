"""The queries of this folder that SQL can express, against their DuckDB twins."""

import duckdb
import pytest

from quarry.llm.entries import ORACLES, QUERIES


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(repr(r[i]) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, key):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    df = QUERIES[key](spark, sf_dir)
    res = con.sql(ORACLES[key])
    assert sorted(df.columns) == sorted(res.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(res.columns, res.fetchall())
