"""Record shapes of the topics and tables."""

from __future__ import annotations

from pyspark.sql import types as T

MARKETING = T.StructType(
    [
        T.StructField("event", T.StringType()),
        T.StructField("property_id", T.IntegerType()),
        T.StructField("guest_email", T.StringType()),
        T.StructField("booking_value", T.DoubleType()),
        T.StructField("timestamp", T.StringType()),
    ]
)

# Every field is read as text; casting is a separate step, so that a bad value rejects its record only.
BOOKING_TEXT = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "event", "event_id", "booking_id", "property_id", "guest_name", "email", "guest_email", "phone",
            "guests", "check_in", "check_out", "nights", "total_price", "description", "timestamp",
        )
    ]
)

SEED_COLUMNS = "id long, name string, location string, price string, guests int, description string, amenities string"

MESSAGE = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

LINEITEM = T.StructType(
    [
        T.StructField("l_orderkey", T.LongType()),
        T.StructField("l_partkey", T.LongType()),
        T.StructField("l_suppkey", T.LongType()),
        T.StructField("l_linenumber", T.IntegerType()),
        T.StructField("l_quantity", T.DoubleType()),
        T.StructField("l_extendedprice", T.DoubleType()),
        T.StructField("l_discount", T.DoubleType()),
        T.StructField("l_tax", T.DoubleType()),
        T.StructField("l_returnflag", T.StringType()),
        T.StructField("l_linestatus", T.StringType()),
        T.StructField("l_shipdate", T.TimestampNTZType()),
    ]
)
