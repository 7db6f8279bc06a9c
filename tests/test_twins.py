"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from check_twins import compare, connect

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_twin(spark, small, con, name):
    assert compare(entry.queries()[name](spark, small), con, entry.oracle_sql()[name]) == ""


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_twins_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
