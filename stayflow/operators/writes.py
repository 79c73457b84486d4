"""Insert, upsert and update over tables held as files."""

from __future__ import annotations

import datetime as dt
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stayflow.operators.joins import lookup_join
from stayflow.operators.latest import pick_first
from stayflow.session import reliable_checkpoint


def absent_rows(existing: DataFrame, incoming: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Incoming rows whose key is new; of several rows with one new key the first is taken.

    Both sides hold a key once when they meet, so the join has no hot key.
    """
    return pick_first(incoming, [key], order).join(existing.select(key), key, "left_anti")


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return existing.unionByName(absent_rows(existing, incoming, key, order))


def seed_if_empty(table: DataFrame, seed: DataFrame) -> DataFrame:
    """The table, or the seed rows when the table has none. Reads at most one row to decide."""
    return seed if table.isEmpty() else table


def upsert(existing: DataFrame, changes: DataFrame, key: str, order: list[Column], columns: list[str]) -> DataFrame:
    """Write the last change of each key over `columns`; all other columns keep their old value.

    A NULL in a change means that the event did not carry the field.
    """
    last = pick_first(changes, [key], order).select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    merged = existing.join(last, key, "full_outer")
    return merged.select(
        *[
            F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c)
            for c in existing.columns
        ]
    )


def update_where_key(table: DataFrame, keys: DataFrame, key: str, assignments: dict[str, Column], table_keys: DataFrame | None = None) -> DataFrame:
    """Assign columns on the rows whose key occurs in `keys`.

    table_keys: the key column of what the table is made from, so that hot keys are counted there (see `lookup_join`).
    """
    hits = keys.select(key).distinct().withColumn("_hit", F.lit(True))
    joined = lookup_join(table, hits, [key], "left", keys=table_keys)
    new = [
        F.when(F.col("_hit"), assignments[c]).otherwise(F.col(c)).alias(c) if c in assignments else F.col(c)
        for c in table.columns
    ]
    return joined.select(*new)


def assign_ids(rows: DataFrame, order: list[str], id_col: str, start_after: int = 0) -> DataFrame:
    """Number rows 1, 2, 3 … after `start_after` in the order of unique columns, without one global window.

    Rows are range partitioned and sorted; the sizes of the partitions give each one its offset.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # monotonically_increasing_id holds the partition in the upper bits and the row in the lower 33. The
    # range bounds come from a sample, so the numbered rows are fixed by a checkpoint before they are
    # counted.
    numbered = reliable_checkpoint(ranged.withColumn("_mid", F.monotonically_increasing_id())).select(
        "*", F.shiftright("_mid", 33).alias("_part"), F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)).alias("_row")
    )
    # One row per partition.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return numbered.join(F.broadcast(offsets), "_part").withColumn(
        id_col, F.lit(start_after) + F.col("_offset") + F.col("_row") + 1
    ).drop("_mid", "_part", "_row", "_offset")


def add_missing_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Add each absent column as a typed NULL; present columns stay as they are."""
    absent = {name: F.lit(None).cast(kind) for name, kind in wanted.items() if name not in df.columns}
    return df.withColumns(absent) if absent else df


def insert_shape(rows: DataFrame, table_columns: list[str]) -> DataFrame:
    """Keep the columns that the target table has, in its order."""
    return rows.select(*[c for c in table_columns if c in rows.columns])


def keep_recent(df: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    return df.filter(F.col(ts) >= now - F.make_dt_interval(days=F.lit(days)))


def kept_days(df: DataFrame, ts: str, now: dt.datetime, days: int, day: str = "dt") -> DataFrame:
    """The rows of the last `days` days before `now` from a table with a folder per day (ISO text in the column `day`).

    Older folders are left out by their name, and younger ones are taken as they are: only the border day's rows are
    compared by their time. A row lies in the folder of its own day.
    """
    cut = now - dt.timedelta(days=days)
    border = cut.date().isoformat()
    return df.where((F.col(day) > border) | ((F.col(day) == border) & (F.col(ts) >= F.lit(str(cut)).cast(df.schema[ts].dataType))))


def expired_days(df: DataFrame, now: dt.datetime, days: int, day: str = "dt") -> list[str]:
    """The days whose folders may be removed, from the folders' names; no row is read."""
    border = (now - dt.timedelta(days=days)).date().isoformat()
    return sorted(r[0] for r in df.select(day).where(F.col(day) < border).distinct().collect())


@contextmanager
def _for_now(spark: SparkSession, name: str, value: str, default: str):
    before = spark.conf.get(name, default)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def few_folders(spark: SparkSession, folders: int):
    """Within it, a task that writes to up to so many folders at once does not sort its rows by folder first.

    A task that has as many writers as Spark's setting says sorts all rows to come, and spills them uncompressed: hence one more.
    """
    return _for_now(spark, "spark.sql.maxConcurrentOutputFileWriters", str(folders + 1), "0")


def no_shuffle_left(spark: SparkSession):
    """Within it, what a write has shuffled is removed when it ends, not when the driver happens to collect its garbage."""
    return _for_now(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true", "false")


def write_daily(rows: DataFrame, path: str, day: str = "dt") -> None:
    """Append to a folder per day. Rows are brought together by day first, with large days split and small
    ones merged, so that a day gets few files and no single task."""
    rows.hint("rebalance", day).write.mode("append").partitionBy(day).parquet(path)
