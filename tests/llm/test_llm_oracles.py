"""Queries of the subpackage against their SQL in DuckDB."""

import pytest
from check import compare, oracle_connection

from corpusmill.llm import catalog

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    ok, note = compare(spark, oracle_connection(SF), name, catalog.QUERIES[name], catalog.ORACLES[name], SF)
    assert ok, note


def test_every_oracle_is_sql():
    assert all(isinstance(x, str) for x in catalog.ORACLES.values())
