"""Every registered query equals its DuckDB SQL on the smallest table set."""

import collections
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from logpipe.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
TABLES = ["events", "documents", "pages", "conversations"]


@pytest.fixture(scope="module")
def duck():
    if not os.path.exists(f"{SF_DIR}/events.parquet"):
        pytest.skip("test data not present")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return con


def bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def norm(v):
        return round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    return collections.Counter(tuple(norm(r[i]) for i in order) for r in rows)


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert bag(df.columns, rows) == bag(dcols, res.fetchall())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["window_start", "level", "source", "n", "with_host"]
