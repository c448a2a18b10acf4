"""Registered queries of this subpackage against their SQL on DuckDB, whole tables."""

import math

import duckdb
import pytest

from heapscribe.llm.queries import ORACLE_SQL, QUERIES

from ..conftest import DATA

TABLES = ["documents", "conversations", "benchmark"]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = db.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    order = lambda r: tuple((x is not None, x) for x in r)
    rows, expected = sorted(map(tuple, got.select(*columns).collect()), key=order), sorted(want.fetchall(), key=order)
    assert len(rows) == len(expected)
    for a, b in zip(rows, expected, strict=True):
        assert all(x == y or isinstance(x, float) and math.isclose(x, y, rel_tol=1e-12) for x, y in zip(a, b, strict=True)), (a, b)
