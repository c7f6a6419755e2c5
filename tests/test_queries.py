"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
import check

FOLDER = "/root/testdata/sf0.001"
# Queries that rightly find nothing in the smallest tables.
EMPTY: set[str] = set()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return check.connect(FOLDER)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    same, note = check.compare(spark, duck, FOLDER, entry.queries()[name], entry.oracle_sql().get(name))
    assert same or (note == "0 rows" and name in EMPTY), note
