"""Every query against its oracle at the smallest scale; without the data these are skipped."""

from __future__ import annotations

import os

import pytest

from codeloom.plans import catalog
from tests.check import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = sorted(catalog.all_queries())


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    message, ok = compare(spark, con, SF, catalog.all_queries()[name], catalog.all_oracles().get(name))
    assert ok, message
