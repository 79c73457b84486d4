"""Equi joins of a large side with a side that holds each key once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def estimated_bytes(df: DataFrame) -> int:
    """Spark's own size estimate (file sizes scaled to the columns read)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _limit_bytes(spark) -> int:
    return int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Spark would broadcast this side by itself. A client without a JVM of its own cannot ask: then not."""
    if not hasattr(df, "_jdf"):
        return False
    return estimated_bytes(df) <= _limit_bytes(df.sparkSession)


def lookup_join(facts: DataFrame, lookup: DataFrame, on: list[str], how: str = "inner", hot_rows: int = 10_000_000,
                keys: DataFrame | None = None) -> DataFrame:
    """Join facts to a lookup whose `on` columns are unique.

    A lookup below spark.sql.autoBroadcastJoinThreshold needs no shuffle and has no skew: Spark broadcasts
    it by itself. A larger one is joined by shuffle, with the rows of hot keys spread over many partitions.

    keys: the `on` columns of the table that the facts are made from, so that hot keys are counted by a scan of these
    columns and not by computing the facts twice. Counts that are too high only spread a key more.
    """
    if fits_broadcast(lookup):
        return facts.join(lookup, on, how)
    return salted_join(facts, lookup, on, how, hot_rows, keys)


def salted_join(facts: DataFrame, lookup: DataFrame, on: list[str], how: str = "inner", hot_rows: int = 10_000_000,
                keys: DataFrame | None = None) -> DataFrame:
    """Shuffle join that gives every key one partition per `hot_rows` of its rows.

    The lookup row of a hot key is repeated once per partition. Finding the hot keys reads only the key
    columns and is combined on the map side.
    """
    # At most (fact rows / hot_rows) keys are hot: 100,000 narrow rows for 10^12 facts. That bound is what
    # allows the broadcast.
    hot = (
        (facts if keys is None else keys).groupBy(*on)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > hot_rows)
        .select(*on, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_parts"))
    )
    # The salt follows the input partition, never row order or chance: a task that runs again after a lost
    # executor sends the same rows to the same reducers, and equal copies of a row spread as well as others.
    spread = F.xxhash64(F.spark_partition_id())
    # A NULL key matches nothing, so its rows may go anywhere.
    no_key = F.lit(False)
    for name in on:
        no_key = no_key | F.col(name).isNull()
    salt = F.when(no_key, F.pmod(spread, F.lit(1 << 20))).otherwise(F.pmod(spread, F.coalesce("_parts", F.lit(1))))
    left = facts.join(F.broadcast(hot), on, "left").withColumn("_salt", salt.cast("int")).drop("_parts")
    copies = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    right = lookup.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(copies)).drop("_parts")
    return left.join(right, [*on, "_salt"], how).drop("_salt")
