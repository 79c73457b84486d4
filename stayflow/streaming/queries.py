"""Starting streaming queries, and sinks that may see a batch twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from stayflow.session import stream_conf, work_dir


def start(writer, name: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Start a named query with its own checkpoint; without a trigger it reads what is there and ends."""
    writer = writer.queryName(name).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)
    with stream_conf(SparkSession.active()):
        return writer.start()


def batch_files(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: one folder per batch, replaced when the batch is replayed."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def batch_jdbc(url: str, table: str, user: str, password: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink into a database table, from the executors, with the batch number as a column.

    A database append is at least once: `batch` lets readers keep one copy of a replayed batch. The file sink
    above replaces the batch instead.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn("batch", F.lit(batch_id)).write.format("jdbc")
            .options(url=url, dbtable=table, user=user, password=password)
            .mode("append").save()
        )

    return write


def run_to_files(stream: DataFrame, name: str, mode: str = "append") -> str:
    """Read all that a stream has to give into batch folders; returns the folder."""
    spark: SparkSession = stream.sparkSession
    home = work_dir(spark, name)
    out = f"{home}/out"
    query = start(
        stream.writeStream.outputMode(mode).foreachBatch(batch_files(out)), home.rsplit("/", 1)[1], f"{home}/checkpoint"
    )
    query.awaitTermination()
    return out


def batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All batch folders as one table with their batch number."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
