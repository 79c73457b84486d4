"""Table readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stayflow import fixed_values as V
from stayflow import schemas


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jdbc_table(spark: SparkSession, url: str, name: str, *, user: str, password: str,
               partition_column: str | None = None, lower: int = 0, upper: int = 0, partitions: int = 1) -> DataFrame:
    """A database table, read in parallel ranges of `partition_column` when one is given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, user=user, password=password)
    if partition_column:
        reader = reader.options(
            partitionColumn=partition_column, lowerBound=lower, upperBound=upper, numPartitions=partitions
        )
    return reader.load()


def seed_catalogue(spark: SparkSession) -> DataFrame:
    """The six starting properties."""
    rows = spark.createDataFrame(V.SEED_PROPERTIES, schemas.SEED_COLUMNS)
    return rows.withColumn("price", rows.price.cast("decimal(10,2)"))
