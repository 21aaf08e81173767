"""Every registered query against its SQL check."""

import pytest

import __spark_entry__ as entry
from checking import compare, connect
from folioloom.plans.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


def test_every_query_has_a_check():
    """All of the reference's own operators; those of the llm subpackage have tests of their own where SQL fails."""
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    problem, rows = compare(spark, db, SF_DIR, entry.queries()[name], entry.oracle_sql()[name])
    assert problem is None and rows > 0, problem


def test_entry(spark):
    assert entry.entry(spark).count() > 0
