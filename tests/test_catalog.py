"""Every query of the engine against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from quarrymill.operators import nodes
from quarrymill.plans import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="the given tables are not there")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, oracle, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = [tuple(_plain(r[c]) for c in cols) for r in df.collect()]
    spark.catalog.clearCache()
    cursor = oracle.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({catalog.SQL[name]})")
    want = [tuple(map(_plain, r)) for r in cursor.fetchall()]
    key = lambda r: tuple(str(x) for x in r)
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 1e-4) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL) - {"grid_search", "random_search"}))
def test_query_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, str(DATA)).count() > 0


@pytest.mark.parametrize("name", ["tpl_oo", "tpl_callgraph", "tpl_cross_map", "tpl_lines", "tpl_maintain"])
def test_tables_that_grow_with_the_files_are_not_broadcast(spark, name):
    """Their guessed sizes are those of the input before files became trees."""
    plan = catalog.QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    spark.catalog.clearCache()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_tasks_hold_a_stated_number_of_files(spark, monkeypatch):
    monkeypatch.setattr(nodes, "FILES", 10)
    files = spark.range(300).selectExpr("id AS file_id", "'x = 1' AS content")
    assert nodes.spread(files).rdd.getNumPartitions() == 30


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
