"""Every named query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from driftline.plans import load_all
from tests.conftest import SMALL
from tests.oracle_check import compare, connect

QUERIES, ORACLES = load_all()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    problem, _, _, _ = compare(spark, con, SMALL, QUERIES[name], ORACLES.get(name))
    assert problem is None, problem


def test_sql_belongs_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_holds_every_query():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 6
