"""Registered queries beside their SQL on the smallest tables.

Every query runs here; the driver repeats them at ten times the size.
"""

import os

import pytest
from oracle import compare, connect

from tagspark.catalog import ORACLES, QUERIES

SF = os.environ.get("TAGSPARK_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert not QUERIES[name](spark, SF).isEmpty()


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == [
        "setId", "identity", "state", "cellsAsked", "cellsAnswered", "cellsBound", "cellsNotBound", "agreement", "unreliableReason"
    ]
    assert set(entry.oracle_sql()) <= set(entry.queries())
