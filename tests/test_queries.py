"""Every query against its SQL statement, on whole tables."""

from __future__ import annotations

import pytest
from compare import connect, differences

import __spark_entry__ as entry_points
from fieldtally.plans import catalog
from oracles import oracle_sql

QUERIES = catalog.queries()
STATEMENTS = oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(STATEMENTS)


def test_entry_points_offer_every_query():
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(STATEMENTS) <= set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, folder, con):
    assert differences(QUERIES[name](spark, folder), con, STATEMENTS[name]) == ""


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["dimension", "item", "answer", "n", "total", "prop"]
    assert df.count() > 0
