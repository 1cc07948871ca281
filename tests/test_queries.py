"""Every query with SQL against DuckDB on the smallest tables."""

import pytest

from evenkeel.catalog import INVENTORY, ORACLES, QUERIES
from tests.oracle import connect, differences


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, small, con, name):
    assert differences(QUERIES[name](spark, small), con, ORACLES[name]) == []


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) == set(INVENTORY)


def test_entry_runs(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert {r["ratio"] for r in rows} == {1.0}
