"""Booking messages into the bookings table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayflow import fixed_values as V
from stayflow.functions.messages import cast_booking, read_booking
from stayflow.operators.writes import few_folders, update_where_key
from stayflow.streaming.bucketed import BucketedTable

# Columns that a booking message may set.
EVENT_COLUMNS = [
    "property_id", "guest_name", "email", "phone", "guests", "check_in", "check_out", "nights", "total_price",
]


RECORD_SCHEMA = (
    "event string, event_id string, booking_id string, property_id long, guest_name string, email string, "
    "guest_email string, phone string, guests int, check_in date, check_out date, nights int, "
    "total_price decimal(10,2), description string, timestamp string, rejected string, sent timestamp"
)

# What the last message that carries it sets: all fields but the key, the time and the reasons of a rejection.
STATE_FIELDS = {
    name: kind for name, kind in (column.split(" ", 1) for column in RECORD_SCHEMA.split(", "))
    if name not in ("booking_id", "timestamp", "rejected", "sent")
}

# Fields that an accepted message need not carry.
SOMETIMES = ["event", "event_id", "guest_email", "phone", "guests"]

# All of them: first what every accepted message carries, of which the digest covers all but the description. So of messages of
# one time and digest the one with the greatest description is the greatest.
LAST_FIELDS = [*(name for name in STATE_FIELDS if name not in SOMETIMES), *SOMETIMES]

# `last` is what the last message sets; `tie` orders messages of the same time. A field that `last` does not carry, or that
# another message of the same time and digest sets higher, stands by itself with the time of its message.
STATE_SCHEMA = (
    f"booking_id string, created timestamp, last struct<sent: timestamp, tie: binary, {', '.join(f'{n}: {STATE_FIELDS[n]}' for n in LAST_FIELDS)}>, "
    + ", ".join(f"{name} struct<sent: timestamp, tie: binary, value: {STATE_FIELDS[name]}>" for name in SOMETIMES))
STATE_COLUMNS = ["booking_id", "created", "last", *SOMETIMES]


def _tie() -> Column:
    """Eight bytes of a digest of what a message sets: messages of one time that agree on it are equal."""
    told = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in EVENT_COLUMNS))
    return F.unhex(F.substring(F.md5(told), 1, 16))


def to_state(good: DataFrame) -> DataFrame:
    """Accepted messages as rows of the state, one per message."""
    alone = [F.lit(None).cast(f"struct<sent: timestamp, tie: binary, value: {STATE_FIELDS[name]}>").alias(name) for name in SOMETIMES]
    last = F.struct("sent", _tie().alias("tie"), *LAST_FIELDS)
    return good.select("booking_id", F.col("sent").alias("created"), last.alias("last"), *alone)


def _own(name: str) -> Column:
    """A field as the last message carries it; NULL if it does not."""
    value = F.col(f"last.{name}")
    return F.when(value.isNotNull(), F.struct(F.col("last.sent").alias("sent"), F.col("last.tie").alias("tie"), value.alias("value")))


def merge_state(rows: DataFrame) -> DataFrame:
    """One row per booking: of each field the last value that any message carries, and the first message's time.

    Rows are combined before the shuffle, and it does not matter in which order or how often they are merged.
    """
    _check_columns(rows)
    fields = [F.max(F.coalesce(F.col(c), _own(c))).alias(c) for c in SOMETIMES]
    merged = rows.groupBy("booking_id").agg(F.min("created").alias("created"), F.max("last").alias("last"), *fields)
    return merged.withColumns({c: F.when(~F.col(c).eqNullSafe(_own(c)), F.col(c)) for c in SOMETIMES})


def _check_columns(rows: DataFrame) -> None:
    if set(rows.columns) != set(STATE_COLUMNS):
        raise ValueError("the bookings were stored in an older form: ingest their messages into a new folder")


def state_table(spark: SparkSession, path: str, **how) -> BucketedTable:
    """The bookings of a folder as a table that batches are merged into."""
    return BucketedTable(spark, f"{path}/bookings", "booking_id", STATE_SCHEMA, merge_state, **how)


def enrich(state: DataFrame) -> DataFrame:
    """The bookings of merged state rows, with the constant columns of a saved booking; defaults are for what no message carries."""
    _check_columns(state)
    values = {c: F.coalesce(f"{c}.value", f"last.{c}") if c in SOMETIMES else F.col(f"last.{c}") for c in STATE_FIELDS}
    rows = state.select("booking_id", F.col("created").cast("timestamp_ntz").alias("created_at"), *(v.alias(c) for c, v in values.items()))
    return rows.withColumns({
        "guests": F.coalesce("guests", F.lit(V.DEFAULT_GUESTS)), "status": F.lit(V.STATUS_CONFIRMED), "pipeline": F.lit(V.PIPELINE_LABEL),
    })


def ingest_batch(path: str, source: str = "messages", **how) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: decode a batch once, write accepted and rejected records apart, merge the accepted into the bookings.

    The records of a batch have a folder of their own, which a replay replaces; the merge reads that folder and nothing older.
    A message is stamped with its time here, or with now if it has none that can be read, so that its time never changes
    later. A number of guests that a message does not carry is stored as NULL, so that it overwrites nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, folder = batch.sparkSession, f"{path}/records/batch={batch_id}"
        bookings = state_table(spark, path, **how)
        raw = read_booking(batch).withColumn("guests_sent", F.col("guests").isNotNull())
        cast = cast_booking(raw).withColumns({
            "accepted": F.col("rejected") == "", "guests": F.when(F.col("guests_sent"), F.col("guests")),
            "sent": F.coalesce(F.try_to_timestamp("timestamp"), F.current_timestamp()),
        })
        with few_folders(spark, 2):
            cast.drop("guests_sent").write.mode("overwrite").option("compression", "zstd").partitionBy("accepted").parquet(folder)
        fresh = spark.read.schema(f"{RECORD_SCHEMA}, accepted boolean").parquet(folder).where("accepted")
        bookings.append(to_state(fresh), source, batch_id)

    return write


def ingested(spark: SparkSession, path: str) -> DataFrame:
    """All decoded records; filters on `accepted` skip the other folder."""
    return spark.read.schema(f"{RECORD_SCHEMA}, batch long, accepted boolean").parquet(f"{path}/records")


def booking_table(spark: SparkSession, path: str, **how) -> DataFrame:
    """The bookings after all accepted messages, from the merged table; no message is read again."""
    return enrich(state_table(spark, path, **how).table())


def rejected_messages(spark: SparkSession, path: str) -> DataFrame:
    return ingested(spark, path).filter("NOT accepted").drop("batch", "accepted")


def confirm(bookings: DataFrame, booking_events: DataFrame, key: str, keys: DataFrame | None = None) -> DataFrame:
    """Confirm the pending bookings that a booking event names, and mark their invoice as sent.

    keys: the key column of the table that the bookings are made from, so that they are computed once.
    """
    return update_where_key(
        bookings, booking_events, key, {"status": F.lit(V.STATUS_CONFIRMED), "invoice_sent": F.lit(True)}, keys
    )
