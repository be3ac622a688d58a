"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

from spanloom.plans.catalogue import QUERIES, SQL

FOLDER = os.environ.get("SPANLOOM_TEST_TABLES", "/root/testdata/sf0.001")


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([None if isinstance(r[i], float) and r[i] != r[i] else r[i] for i in order]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(columns, want.fetchall())
