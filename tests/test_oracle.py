"""Every registered query against the same question in SQL on another engine."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def other():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, other, name):
    query = entry.queries()[name]
    if name in SQL:
        assert compare(spark, other, name, query, SQL[name], SF) is None
    else:
        assert query(spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(SQL) <= set(entry.queries())
