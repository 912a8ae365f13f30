"""Every registered query against its SQL."""

import os

import pytest

import __spark_entry__ as entry
from kpivane.plans import catalogue
from tests.support import DATA, differences, duck

SF = os.environ.get("TEST_SF", "0.001")
PATH = f"{DATA}/sf{SF}"
QUERIES, SQL = catalogue.queries(), catalogue.sql()
#: Queries whose conditions nothing in the smallest tables meets.
MAY_BE_EMPTY = {"why_top_contributors"}


@pytest.fixture(scope="module")
def con():
    return duck(PATH)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    frame = QUERIES[name](spark, PATH)
    if name not in SQL:
        assert frame.count() > 0
        return
    report = differences(frame, con, SQL[name])
    assert report is None or (report == "no rows on either side" and name in MAY_BE_EMPTY), report


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
