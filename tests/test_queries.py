"""Every query against its SQL in DuckDB, on the smallest tables; queries without SQL must give rows."""

import os
import subprocess
import sys

import duckdb
import pytest

from lattica.plans.derived import TABLES
from lattica.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}") + 0.0
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = in_order(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    result = duck.sql(ORACLES[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    assert got == in_order(tuple(plain(r[i]) for i in at) for r in result.fetchall())


def test_the_rest_works_without_the_optional_part(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in os.listdir(root):
        if name not in ("corpus_pipeline.py", "lattica", ".git"):
            os.symlink(f"{root}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "lattica")
    for name in os.listdir(f"{root}/lattica"):
        if name != "llm":
            os.symlink(f"{root}/lattica/{name}", tmp_path / "lattica" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and e.oracle_sql() and 'pipeline' not in q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
