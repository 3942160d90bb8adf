"""Every registered flow query with SQL gives the rows that DuckDB gives on the same tables."""

import math
import os

import duckdb
import pytest

from tideway.plans.registry import QUERIES

SLOW = {"e6_linear_svm", "e14_weighted_total", "r1_r2_r3_report"}


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for name in os.listdir(sf):
        connection.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 4) + 0.0
    return value


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query_equals_sql(spark, sf, duck, name):
    function, sql = QUERIES[name]
    found = function(spark, sf)
    rows = [tuple(r) for r in found.collect()]
    if sql is None:
        assert rows
        return
    want = duck.sql(sql)
    order = [want.columns.index(c) for c in found.columns]
    assert len(want.columns) == len(order)
    expected = [tuple(plain(r[i]) for i in order) for r in want.fetchall()]
    assert sorted(([plain(v) for v in r] for r in rows), key=repr) == sorted(map(list, expected), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
