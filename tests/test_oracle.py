"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest
from check_oracle import compare, database

import __spark_entry__ as entry

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLE:
        assert compare(df, con, ORACLE[name]) is None
    else:
        df.count()
