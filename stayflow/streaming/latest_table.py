"""The latest value per key with a lifetime in event time, kept by a stream.

Which row is the latest is told by columns of the row, not by the order in which rows come, so late, repeated and shuffled
rows give the same result. Batches are merged into a bucketed table; what has outlived its lifetime is left out when the
table is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayflow.streaming.bucketed import BucketedTable


def _newest(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(F.max("latest").alias("latest"))

    return merge


class LatestTable:
    """key, order and value are columns with their types. The row with the greatest `order` counts, then the greatest `value`."""

    def __init__(self, spark: SparkSession, path: str, key: dict[str, str], order: dict[str, str], value: dict[str, str], **how):
        if len(key) != 1:
            raise ValueError("one key column")
        self.key, self.fields = next(iter(key)), [*order, *value]
        columns = ", ".join(f"{n}: {t}" for n, t in [*order.items(), *value.items()])
        schema = f"{self.key} {key[self.key]}, latest struct<{columns}>"
        self.rows = BucketedTable(spark, path, self.key, schema, _newest([self.key]), **how)

    def sink(self, source: str = "rows") -> Callable[[DataFrame, int], None]:
        """foreachBatch sink. Rows without the first order column have no place and are left out."""
        def write(batch: DataFrame, number: int) -> None:
            placed = batch.where(F.col(self.fields[0]).isNotNull())
            self.rows.append(placed.select(self.key, F.struct(*self.fields).alias("latest")), source, number)

        return write

    def alive(self, ts: str, now: Column, ttl_seconds: int) -> DataFrame:
        """The latest row of each key whose time lies less than the lifetime before `now`."""
        rows = self.rows.table().select(self.key, "latest.*")
        return rows.where(F.col(ts) > now - F.make_dt_interval(secs=F.lit(ttl_seconds)))
