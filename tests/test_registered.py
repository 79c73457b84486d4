"""Every registered query against its SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from stayflow.plans.catalog import ORACLE, QUERIES
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(ORACLE))
def test_matches_sql(spark, con, name):
    assert difference(spark, con, SF, contract.queries()[name], contract.oracle_sql()[name]) is None


def test_every_own_query_has_sql():
    assert set(QUERIES) <= set(contract.oracle_sql())


def test_late_rows_are_reported(spark):
    report = contract.queries()["late_data_report"](spark, SF).collect()
    assert sum(r.dropped for r in report) > 0
    assert sum(r.input_rows for r in report) == spark.read.parquet(f"{SF}/events.parquet").count()


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_rows_come_in_order(spark):
    ids = [r.id for r in contract.queries()["properties_by_id"](spark, SF).collect()]
    assert ids == sorted(ids) and len(ids) > 1
    listed = [(r.created_at, r.id) for r in contract.queries()["bookings_with_property"](spark, SF).collect()]
    by_id = sorted(listed, key=lambda row: row[1])
    assert listed == sorted(by_id, key=lambda row: row[0], reverse=True) and len(listed) > 1
