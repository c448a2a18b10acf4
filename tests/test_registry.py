"""Every registered query with SQL against DuckDB on the smallest tables."""

import numbers

import duckdb
import numpy as np
import pandas as pd
import pytest

from heapscribe import registry, token_queries  # noqa: F401  the second adds its queries to the first's

from .conftest import DATA


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events", "part", "customer", "supplier"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)) or v is pd.NA:
        return "NULL"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    return repr(float(v)) if isinstance(v, (numbers.Number, np.number)) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, DATA).toPandas()) == rows(duck.sql(registry.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_timeline_fills_from_time_zero(spark):
    rows = "SELECT CAST(1 AS BIGINT) AS ts, CAST(NULL AS STRING) AS s, 5 AS delta UNION ALL SELECT 9, NULL, -2 UNION ALL SELECT 6, 'a', 1 UNION ALL SELECT NULL, 'a', 7"
    got = {(r.bucket, r.s, r.value) for r in registry.intervals.step_timeline(spark.sql(rows), "s", 3).collect()}
    assert got == {(0, None, 5), (1, None, 5), (2, None, 5), (3, None, 3), (0, "a", 0), (1, "a", 0), (2, "a", 1), (3, "a", 1)}


def test_flagship_equals_snapshot(spark):
    """The timeline at the end of a bucket is the state at that time."""
    line = registry.flagship(spark, DATA)
    t = 1_000_000 // 3000 * 3000 + 2999
    live = registry.proxies.query(spark, DATA, "SELECT heap, sum(size) AS value FROM " + registry.at(t) + " a GROUP BY heap")
    got = {(r.heap, r.value) for r in line.where(f"bucket = {t // 3000}").collect() if r.value}
    assert got == {(r.heap, r.value) for r in live.collect()}


def test_deltas_are_antisymmetric(spark):
    a, b = (registry.proxies.query(spark, DATA, registry.at(t)).groupBy("heap").count().collect() for t in (registry.BEFORE, registry.AFTER))
    change = {r.heap: r.allocations for r in registry.QUERIES["a22_heap_delta"](spark, DATA).collect()}
    assert change == {r.heap: r["count"] - dict(map(tuple, a)).get(r.heap, 0) for r in b}


def test_point_lookup_is_an_equi_join(spark):
    plan = registry.QUERIES["j03_j04_point_in_interval"](spark, DATA)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_address_search_reads_numbers_and_text(spark):
    got = {(r.asked, r.alloc_id) for r in registry.QUERIES["f03_address_search"](spark, DATA).collect()}
    assert {x for x in got if x[0] in ("0x700064", "7340132")} == {("0x700064", 7), ("7340132", 7)}
    assert any(x[0] == "3f" for x in got) and not any(x[0] == "none" for x in got)
