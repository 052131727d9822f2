"""Registered queries against their oracle SQL, on the smallest given tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from citeloom.plans.views import BASE
from tools.check import rows

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are missing")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in BASE:
        connection.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    got = rows(frame.columns, [tuple(r) for r in frame.collect()])
    if name not in ORACLES:
        assert got
        return
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert got == rows(columns, result.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1
