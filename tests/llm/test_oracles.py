"""Queries with SQL against DuckDB at the smallest scale."""

import pytest

from codeloom.llm import queries
from tests.check import compare, duck
from tests.llm.helpers import SF, needs_data


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    needs_data()
    message, ok = compare(spark, duck(SF), SF, queries.QUERIES[name], queries.ORACLES[name])
    assert ok, message
