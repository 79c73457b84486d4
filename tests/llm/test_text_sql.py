"""The registered text queries that have SQL against it."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(contract.TEXT_ORACLE))
def test_matches_sql(spark, con, name):
    assert difference(spark, con, SF, contract.queries()[name], contract.oracle_sql()[name]) is None
