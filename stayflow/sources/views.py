"""The rental tables as seen through the test tables.

properties <- part, users <- customer, stays <- lineitem, bookings <- lineitem with orders,
marketing and booking messages <- events and lineitem, metric samples <- events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayflow import fixed_values as V
from stayflow.functions import scalars as X
from stayflow.operators.joins import lookup_join
from stayflow.sources.tables import table


def guest_email(user_id: Column) -> Column:
    return F.concat(F.lit("guest"), user_id.cast("string"), F.lit("@example.com"))


def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("location"),
        X.money(F.col("p_retailprice")).alias("price"),
        F.col("p_size").alias("guests"),
        F.lit("").alias("description"),
        F.to_json(F.array("p_type", "p_brand")).alias("amenities"),
        F.col("p_type").alias("kind"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("username"),
        F.when(F.col("c_custkey") == 0, "admin").otherwise("user").alias("role"),
        F.concat(F.lit("Guest "), F.col("c_custkey").cast("string")).alias("full_name"),
        guest_email(F.col("c_custkey")).alias("email"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )


# Arrival order of lineitem rows with the same booking id: latest first.
def newest_first() -> list[Column]:
    names = ["l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax"]
    return [F.col(n).desc() for n in names]


def oldest_first() -> list[Column]:
    names = ["l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax"]
    return [F.col(n).asc() for n in names]


def with_stay_columns(lineitem: DataFrame) -> DataFrame:
    """Booking columns that lineitem alone gives, next to its own columns."""
    night_count = (F.lit(1) + F.col("l_quantity").cast("int") % 14).cast("int")
    check_in = F.to_date("l_shipdate")
    return lineitem.withColumns(
        {
            "id": F.concat(
                F.lit("BK-"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")
            ),
            "property_id": F.col("l_partkey"),
            "guests": F.col("l_linenumber"),
            "check_in": check_in,
            "check_out": F.date_add(check_in, night_count),
            "nights": night_count,
            "total_price": X.money(F.col("l_extendedprice")),
        }
    )


STAY_COLUMNS = ["id", "property_id", "guests", "check_in", "check_out", "nights", "total_price"]


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_stay_columns(table(spark, sf_dir, "lineitem")).select("l_orderkey", *STAY_COLUMNS)


def order_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_orderstatus") == "F", V.STATUS_CONFIRMED).otherwise(V.STATUS_PENDING).alias("status"),
        F.col("o_orderdate").alias("created_at"),
    )


def bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lookup_join(stays(spark, sf_dir), order_owners(spark, sf_dir), ["l_orderkey"], keys=table(spark, sf_dir, "lineitem").select("l_orderkey"))
    return joined.select(
        *STAY_COLUMNS,
        "user_id",
        F.concat(F.lit("Guest "), F.col("user_id").cast("string")).alias("guest_name"),
        guest_email(F.col("user_id")).alias("email"),
        F.concat(F.lit("+48"), (F.lit(500000000) + F.col("user_id")).cast("string")).alias("phone"),
        "status",
        "created_at",
    )


def stay_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The property of each stay, from one column of the stored table."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("property_id"))


def with_property(bookings_df: DataFrame, properties_df: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Bookings with the name of their property; bookings of unknown properties are dropped.

    keys: the property_id column of the table that the bookings are made from, to count hot properties there.
    """
    names = properties_df.select(F.col("id").alias("property_id"), F.col("name").alias("property_name"))
    return lookup_join(bookings_df, names, ["property_id"], keys=keys)


def marketing_messages(events: DataFrame, topic: Column | None = None) -> DataFrame:
    """Events as they lie on a topic (the marketing topic unless given): a key and a JSON text."""
    payload = F.struct(
        F.col("event_type").alias("event"),
        F.col("user_id").cast("int").alias("property_id"),
        guest_email(F.col("user_id")).alias("guest_email"),
        F.concat(F.lit("Guest "), F.col("user_id").cast("string")).alias("guest_name"),
        F.col("value").alias("booking_value"),
        X.iso_timestamp("ts").alias("timestamp"),
    )
    return events.select(
        (F.lit(V.TOPIC_MARKETING) if topic is None else topic).alias("topic"),
        F.col("user_id").cast("string").alias("key"),
        F.to_json(payload).alias("value"),
    )


def metric_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as metric samples: the event type is the metric, the user its series label.

    Views carry no `state` label; the other events do.
    """
    return table(spark, sf_dir, "events").select(
        "ts",
        F.col("event_type").alias("metric"),
        F.map_filter(
            F.create_map(
                F.lit("series"), F.col("user_id").cast("string"),
                F.lit("state"), F.when(F.col("event_type") == "signup", "mounted").when(
                    F.col("event_type") != "view", "detached"),
            ),
            lambda _, v: v.isNotNull(),
        ).alias("labels"),
        "value",
    )
