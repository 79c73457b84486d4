"""Revenue per property in event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stayflow import fixed_values as V
from stayflow.functions.messages import decode_marketing, with_event_time
from stayflow.operators.joins import lookup_join
from stayflow.operators.latest import pick_first
from stayflow.streaming.bucketed import BucketedTable


def decimal_value() -> Column:
    return F.col("booking_value").cast("decimal(12,2)")


def window_totals(decoded: DataFrame, width: str = V.WINDOW) -> DataFrame:
    """Count, sum and mean of booking values per window and property.

    A missing value is counted but neither summed nor averaged; a row without a time is in no window.
    """
    totals = decoded.groupBy(F.window("event_time", width).alias("w"), "property_id").agg(
        F.count(F.lit(1)).alias("booking_count"),
        F.sum(decimal_value()).alias("total"),
        F.count("booking_value").alias("valued"),
    )
    return _told(totals)


def _told(totals: DataFrame) -> DataFrame:
    """Sums per window and property as they are reported."""
    revenue = F.col("total").cast("double")
    return totals.select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"),
        F.col("w.end").cast("timestamp_ntz").alias("window_end"),
        "property_id",
        "booking_count",
        revenue.alias("total_revenue"),
        (revenue / F.nullif(F.col("valued"), F.lit(0))).alias("avg_booking_value"),
    )


def revenue_batch(messages: DataFrame) -> DataFrame:
    return window_totals(with_event_time(decode_marketing(messages)))


def revenue_stream(messages: DataFrame, watermark: str = V.WATERMARK) -> DataFrame:
    """The same totals over a stream; rows behind the watermark are dropped."""
    return window_totals(with_event_time(decode_marketing(messages)).withWatermark("event_time", watermark))


TOTALS = "cell string, window_start timestamp, property_id int, booking_count long, total decimal(22,2), valued long"


def _added(rows: DataFrame) -> DataFrame:
    """Partial totals of a window and property added up; adding sums up again gives the same."""
    sums = [F.sum(c).alias(c) for c in ("booking_count", "valued")]
    return rows.groupBy("cell").agg(
        F.max("window_start").alias("window_start"), F.max("property_id").alias("property_id"), sums[0],
        F.sum("total").cast("decimal(22,2)").alias("total"), sums[1])


def totals_table(spark: SparkSession, path: str, **how) -> BucketedTable:
    """Window totals that batches are added to, for a history of any length in batches of bounded size: nothing is held in
    state, no row is too late, and a batch that comes twice counts once."""
    return BucketedTable(spark, path, "cell", TOTALS, _added, **how)


def totals_sink(table: BucketedTable, width: str = V.WINDOW, source: str = "messages") -> Callable[[DataFrame, int], None]:
    """foreachBatch sink for marketing messages: a batch is summed up by window and property before it is added."""
    def write(batch: DataFrame, number: int) -> None:
        rows = with_event_time(decode_marketing(batch)).where("event_time is not null")
        cells = rows.groupBy(F.window("event_time", width)["start"].alias("window_start"), "property_id").agg(
            F.count(F.lit(1)).alias("booking_count"), F.sum(decimal_value()).alias("total"), F.count("booking_value").alias("valued"))
        cell = F.concat(F.unix_micros("window_start").cast("string"), F.lit("/"), F.coalesce(F.col("property_id").cast("string"), F.lit("")))
        table.append(cells.withColumns({"cell": cell, "total": F.col("total").cast("decimal(22,2)")}), source, number, merged=True)

    return write


def table_windows(table: BucketedTable, width: str = V.WINDOW) -> DataFrame:
    """The windows of a totals table as `window_totals` gives them."""
    start = F.col("window_start")
    return _told(table.table().withColumn("w", F.struct(start.alias("start"), (start + F.expr(f"INTERVAL {width}")).alias("end"))))


def newest_windows(updates: DataFrame) -> DataFrame:
    """The last value of each window from the batches of an update-mode query."""
    last = pick_first(updates, ["window_start", "property_id"], [F.col("batch").desc()])
    return last.drop("batch")


def _marks(cells: DataFrame, delivery: str, watermark: str) -> DataFrame:
    """Per delivery the watermark that earlier ones left, NULL for the first; deliveries are put in order, not rows."""
    earlier = Window.orderBy(delivery).rowsBetween(Window.unboundedPreceding, -1)
    newest = cells.groupBy(delivery).agg(F.max("_newest").alias("_newest"))
    return newest.select(delivery, (F.max("_newest").over(earlier) - F.expr(f"INTERVAL {watermark}")).alias("_mark"))


def totals_without_late(decoded: DataFrame, delivery: str, width: str = V.WINDOW, watermark: str = V.WATERMARK) -> DataFrame:
    """What `window_totals` over a stream comes to when rows arrive in deliveries, each one batch: windows without the rows that
    come after the watermark of the deliveries before has passed the window's end.

    Rows are summed up by delivery, window and property before marks are joined; a sum is late or in time as a whole.
    """
    cells = decoded.groupBy(delivery, F.window("event_time", width).alias("w"), "property_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(decimal_value()).alias("total"), F.count("booking_value").alias("valued"),
        F.max("event_time").alias("_newest"))
    in_time = lookup_join(cells, _marks(cells, delivery, watermark), [delivery], "left").where(
        F.col("_mark").isNull() | (F.col("w.end") > F.col("_mark")))
    return _told(in_time.groupBy("w", "property_id").agg(
        F.sum("n").alias("booking_count"), F.sum("total").alias("total"), F.sum("valued").alias("valued")))


def late_rows(rows: DataFrame, delivery: str, ts: str, width: str = V.WINDOW, watermark: str = V.WATERMARK) -> DataFrame:
    """Per delivery, its rows and those whose window had closed: it ended at or before the watermark that earlier
    deliveries left. Rows are summed up by delivery and window before anything is joined; a row without a time is
    in no window and never late. Deliveries, not rows, are put in order.
    """
    end = F.window(F.coalesce(ts, F.lit(0).cast("timestamp").cast("timestamp_ntz")), width)["end"]
    cells = rows.withColumn("_slot", end).groupBy(delivery, F.when(F.col(ts).isNotNull(), F.col("_slot")).alias("_end")).agg(
        F.count(F.lit(1)).alias("_rows"), F.max(ts).alias("_newest")
    )
    marks = _marks(cells, delivery, watermark)
    late = F.when(F.col("_end") <= F.col("_mark"), F.col("_rows")).otherwise(0)
    return lookup_join(cells.drop("_newest"), marks, [delivery], "left").groupBy(delivery).agg(
        F.sum("_rows").alias("input_rows"), F.sum(late).alias("dropped")
    )
