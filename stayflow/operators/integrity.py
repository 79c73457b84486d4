"""Checks on keys, references and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayflow.operators.joins import lookup_join


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def orphan_references(rows: DataFrame, ref: str, targets: DataFrame, key: str) -> DataFrame:
    """References without a target, with the number of rows that hold them.

    References are counted before they meet the targets, so each is joined once.
    """
    counted = rows.filter(F.col(ref).isNotNull()).groupBy(ref).agg(F.count(F.lit(1)).alias("refs"))
    return counted.join(targets.select(F.col(key).alias(ref)).distinct(), ref, "left_anti")


def existing_keys(rows: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """Rows whose key occurs in another table."""
    return rows.join(other.select(F.col(other_key).alias(key)).distinct(), key, "left_semi")


def double_bookings(bookings: DataFrame) -> DataFrame:
    """Check-in days on which a property was already taken, or was booked more than once.

    Bookings are reduced to one row per property and check-in day first; the running latest check-out then
    orders at most one row per calendar day and property.
    """
    daily = bookings.filter(F.col("check_out") > F.col("check_in")).groupBy("property_id", "check_in").agg(
        F.count(F.lit(1)).alias("bookings"), F.max("check_out").alias("latest_out")
    )
    before = Window.partitionBy("property_id").orderBy("check_in").rowsBetween(Window.unboundedPreceding, -1)
    checked = daily.withColumn("taken_until", F.max("latest_out").over(before))
    conflict = F.coalesce(F.col("taken_until") > F.col("check_in"), F.lit(False))
    return checked.filter(conflict | (F.col("bookings") > 1)).select(
        "property_id", "check_in", "bookings", "taken_until",
        F.when(conflict, "earlier stay").otherwise("same day").alias("conflict"),
    )


def owners_by_email(users: DataFrame, email: str) -> DataFrame:
    """One user per normalised e-mail: the highest id. Blank addresses are left out."""
    return (
        users.filter(F.col(email).isNotNull())
        .groupBy(F.col(email).alias("_email"))
        .agg(F.max("id").alias("_id"), F.max_by("username", "id").alias("_username"))
    )


def backfill_owner(bookings: DataFrame, users: DataFrame, booking_email: str, user_email: str) -> DataFrame:
    """Fill user_id and username of bookings without an owner from the user with the same e-mail.

    `linked` marks the rows that got an owner. Both e-mail columns must be normalised, blanks as NULL.
    """
    orphan_email = F.when(F.col("user_id").isNull(), F.col(booking_email))
    joined = lookup_join(
        bookings.withColumn("_email", orphan_email), owners_by_email(users, user_email), ["_email"], "left"
    )
    return joined.withColumns(
        {
            "linked": F.col("_id").isNotNull(),
            "user_id": F.coalesce("user_id", "_id"),
            "username": F.coalesce("username", "_username"),
        }
    ).drop("_email", "_id", "_username")
