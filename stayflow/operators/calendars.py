"""Which days are taken, without comparing every day with every booking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def occupied_spans(bookings: DataFrame, keys: list[str], inclusive_checkout: bool = True) -> DataFrame:
    """Spans of days with a constant number of bookings, per key: (keys, first_day, last_day, booked).

    A booking adds one on its first day and takes one away after its last. These changes are summed per day
    before the shuffle, so what is ordered per key is at most one row per calendar day, however many
    bookings the key has.
    """
    after = F.date_add("check_out", 1) if inclusive_checkout else F.col("check_out")
    changes = bookings.filter(after > F.col("check_in")).select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.col("check_in").alias("day"), F.lit(1).alias("change")),
                F.struct(after.alias("day"), F.lit(-1).alias("change")),
            )
        ),
    )
    daily = changes.groupBy(*keys, "day").agg(F.sum("change").alias("change"))
    # Without keys this is one row per calendar day, which one task can order.
    ordered = Window.partitionBy(*keys).orderBy("day") if keys else Window.partitionBy(F.lit(0)).orderBy("day")
    running = F.sum("change").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    spans = daily.withColumns({"booked": running, "next_day": F.lead("day").over(ordered)})
    return spans.filter("booked > 0").select(
        *keys, F.col("day").alias("first_day"), F.date_sub("next_day", 1).alias("last_day"), "booked"
    )


def occupied_days(bookings: DataFrame, keys: list[str], inclusive_checkout: bool = True) -> DataFrame:
    """One row per key and taken day, with the number of bookings on it."""
    spans = occupied_spans(bookings, keys, inclusive_checkout)
    return spans.select(*keys, F.explode(F.sequence("first_day", "last_day")).alias("day"), "booked")


def date_dimension(months: DataFrame, today: Column) -> DataFrame:
    """Every day of the given months (column `month`, any day of it)."""
    first = F.trunc("month", "month")
    days = months.select(first.alias("month")).distinct().select(
        "month", F.explode(F.sequence(F.col("month"), F.last_day("month"))).alias("day")
    )
    return days.withColumns(
        {
            "weekday": F.weekday("day"),
            "first_offset": F.weekday("month"),
            "is_past": F.col("day") < today,
        }
    )


def availability(days: DataFrame, taken: DataFrame, keys: list[str], selected: list[str]) -> DataFrame:
    """Status of each day: past, booked, selected or free, the first that applies."""
    joined = days.join(taken, [*keys, "day"], "left")
    chosen = F.col("day").isin([F.lit(d).cast("date") for d in selected]) if selected else F.lit(False)
    return joined.withColumns(
        {
            "booked": F.coalesce("booked", F.lit(0)),
            "status": F.when(F.col("is_past"), "past")
            .when(F.col("booked") > 0, "booked")
            .when(chosen, "selected")
            .otherwise("free"),
        }
    )


def occupancy(bookings: DataFrame, key: str, first: str, last: str) -> DataFrame:
    """Taken nights of each key between two days, counted once each, and their share of all days."""
    spans = occupied_spans(bookings, [key], inclusive_checkout=False)
    start, end = F.greatest("first_day", F.lit(first).cast("date")), F.least("last_day", F.lit(last).cast("date"))
    total = F.datediff(F.lit(last).cast("date"), F.lit(first).cast("date")) + 1
    taken = F.greatest(F.datediff(end, start) + 1, F.lit(0))
    return spans.groupBy(key).agg(F.sum(taken).alias("booked_days")).withColumn(
        "occupancy", F.col("booked_days").cast("double") / total.cast("double")
    )
