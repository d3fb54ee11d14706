"""Every query with SQL equals DuckDB on the smallest tables."""

import pytest

import check
from corpusmill.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.oracle_connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    ok, note = check.compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
