"""Queries of the training-data operators against their SQL in DuckDB; those without SQL must give rows."""

import os

import duckdb
import pytest

from lattica.llm.queries import ORACLES

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}") + 0.0
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("data", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name, data):
    from lattica.llm.queries import QUERIES

    duck = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{data}/{t}.parquet"):
            duck.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = in_order(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.sql(ORACLES[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    assert got == in_order(tuple(plain(r[i]) for i in at) for r in result.fetchall())
