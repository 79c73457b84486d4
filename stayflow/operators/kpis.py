"""Figures of the dashboard and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dashboard(masked: DataFrame) -> DataFrame:
    """Number of bookings, revenue of the unmasked ones, and the shown occupancy (5 % each, at most 95 %)."""
    visible = F.when(~F.col("masked"), F.coalesce(F.col("total_price"), F.lit(0)))
    return masked.agg(
        F.count(F.lit(1)).alias("bookings"),
        F.coalesce(F.sum(visible), F.lit(0)).cast("double").alias("revenue"),
        F.least(F.lit(95).cast("long"), F.count(F.lit(1)) * 5).alias("occupancy_pct"),
    )


def _marked(name: str, mark) -> Column:
    """A rollup key, with `mark` in subtotal rows; a NULL key stays NULL."""
    return F.when(F.grouping(name) == 1, F.lit(mark)).otherwise(F.col(name)).alias(f"{name}_shown")


def property_report(bookings: DataFrame) -> DataFrame:
    """Bookings, nights and revenue by property, month and status, with subtotals; -1 and 'all' mark them.

    Bookings are added up by all three keys first. These sums are rows of the report as they are; only the subtotals are
    grouped again, so that a task never holds the sums of all three keys a second time. Both parts read one shuffle.
    """
    sums = bookings.groupBy("property_id", F.date_format("check_in", "yyyy-MM").alias("month"), "status").agg(
        F.count(F.lit(1)).alias("bookings"), F.sum("nights").alias("nights"), F.sum("total_price").alias("revenue"))
    subtotals = sums.rollup("property_id", "month").agg(
        _marked("property_id", -1), _marked("month", "all"),
        F.sum("bookings").alias("bookings"), F.sum("nights").alias("nights"), F.sum("revenue").cast("double").alias("revenue"),
    ).select(F.col("property_id_shown").alias("property_id"), F.col("month_shown").alias("month"),
             F.lit("all").alias("status"), "bookings", "nights", "revenue")
    return sums.withColumn("revenue", F.col("revenue").cast("double")).unionByName(subtotals)


def campaign_rollup(events: DataFrame) -> DataFrame:
    """Events and value by type and day, with subtotals marked 'all'."""
    rows = events.select(
        F.col("event_type").alias("campaign"), F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.col("value").cast("decimal(12,2)").alias("value"),
    )
    sums = rows.groupBy("campaign", "day").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
    return sums.rollup("campaign", "day").agg(
        _marked("campaign", "all"), _marked("day", "all"),
        F.sum("events").alias("events"), F.sum("value").cast("double").alias("total_value"),
    ).select(F.col("campaign_shown").alias("campaign"), F.col("day_shown").alias("day"), "events", "total_value")
