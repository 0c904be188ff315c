"""Layer 3: every key with oracle SQL matches DuckDB at sf0.01 (row count,
column names/kinds, order-insensitive values)."""

import pytest

import __spark_entry__ as se
from conftest import SF001
from oracle_harness import compare, duck

SQL = se.oracle_sql()


@pytest.mark.parametrize("key", sorted(SQL))
def test_matches_oracle(spark, key):
    got = se.queries()[key](spark, SF001).toPandas()
    want = duck(SQL[key], SF001)
    r = compare(got, want)
    assert r["ok"], r
