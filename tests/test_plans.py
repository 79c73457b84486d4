"""What the plans must and must not contain."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from stayflow.plans import projections
from stayflow.sources import views

SF = "/root/testdata/sf0.001"
STREAMED = {
    "src_event_stream", "src_multi_topic", "log_tail", "revenue_windows_append", "revenue_windows_update", "raw_event_append",
    "late_data_report", "late_data_windows", "booking_ingest", "dedup_24h", "booking_requests", "request_messages", "latest_stream",
    "revenue_windows_table",
}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - STREAMED))
def test_no_nested_loops_and_no_python_rows(spark, name):
    text = plan(contract.queries()[name](spark, SF))
    assert not re.search("NestedLoop|CartesianProduct|BatchEvalPython|ArrowEvalPython|InPandas", text)


def test_filter_and_columns_reach_the_scan(spark):
    text = plan(projections.optional_property(views.stays(spark, SF), 7).select("id"))
    assert "EqualTo(l_partkey,7)" in text
    assert "l_discount" not in text


def test_small_lookup_is_broadcast_and_large_one_is_salted(spark):
    assert "BroadcastHashJoin" in plan(views.bookings(spark, SF))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 10)
    try:
        text = plan(views.bookings(spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and "_salt" in text


def test_large_tables_give_the_same_answers(spark):
    """With every lookup too large to broadcast, the salted joins give the same rows."""
    names = ["masked_bookings", "price_quote", "backfill_owner", "confirm_bookings", "property_enrich"]
    for name in names:
        query = contract.queries()[name]
        small = query(spark, SF)
        expected = small.agg(F.count("*"), F.sum(F.hash(*small.columns))).first()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 10)
        try:
            large = query(spark, SF)
            assert large.select(small.columns).agg(F.count("*"), F.sum(F.hash(*small.columns))).first() == expected
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_calendar_orders_days_and_not_bookings(spark):
    text = plan(contract.queries()["availability_by_property"](spark, SF))
    # The window sits above an aggregate by property and day.
    assert text.index("Window") < text.index("HashAggregate")


def test_json_fields_are_parsed_once(spark):
    text = plan(contract.queries()["decode_rejects"](spark, SF))
    assert text.count("from_json") == 1


def test_aggregates_are_combined_before_the_shuffle(spark):
    for name in ["revenue_windows_batch", "overlapping_bookings", "fk_orphans", "duplicate_keys", "alert_threshold_hold"]:
        assert "partial_" in plan(contract.queries()[name](spark, SF))
