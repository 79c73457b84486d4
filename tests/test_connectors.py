"""The options that are given to Spark's connectors, whose servers are not at hand, and the processing-time trigger."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from stayflow.sources import streams, tables
from stayflow.streaming.queries import batch_files, batches, batch_jdbc, start
from tests.test_streaming import name


class Recorder:
    """Takes any chain of calls and notes them; as a session, a reader or a writer."""

    def __init__(self, frame=None):
        self.frame, self.calls = frame, {}

    def __getattr__(self, called):
        if called in ("readStream", "write"):
            return self

        def note(*args, **named):
            if called in ("load", "save"):
                return self.frame
            if called == "option":
                self.calls[args[0]] = args[1]
            else:
                self.calls[called] = args[0] if args else None
            self.calls.update(named)
            return self

        return note


def test_a_topic_reader_skips_what_the_broker_has_lost(spark):
    frame = spark.range(1).select(F.lit("t").alias("topic"), F.lit(b"k").alias("key"), F.lit(b"v").alias("value"))
    session = Recorder(frame)
    found = streams.kafka_topics(session, "host:1", ["a", "b"], starting="earliest", maxOffsetsPerTrigger="5")
    assert tuple(found.first()) == ("t", "k", "v")
    assert session.calls == {"format": "kafka", "kafka.bootstrap.servers": "host:1", "subscribe": "a,b", "startingOffsets": "earliest",
                             "failOnDataLoss": "false", "maxOffsetsPerTrigger": "5"}


def test_a_database_table_is_read_in_ranges():
    session = Recorder("rows")
    session.read = session
    assert tables.jdbc_table(session, "jdbc:x", "t", user="u", password="p", partition_column="id", upper=9, partitions=3) == "rows"
    assert session.calls == {"format": "jdbc", "url": "jdbc:x", "dbtable": "t", "user": "u", "password": "p", "options": None,
                             "partitionColumn": "id", "lowerBound": 0, "upperBound": 9, "numPartitions": 3}


def test_writers_name_the_broker_and_the_table():
    messages = Recorder()
    streams.write_kafka(messages, "host:1")
    assert messages.calls == {"format": "kafka", "kafka.bootstrap.servers": "host:1"}
    rows = Recorder()
    rows.withColumn = lambda *_: rows
    batch_jdbc("jdbc:x", "t", "u", "p")(rows, 3)
    assert rows.calls == {"format": "jdbc", "url": "jdbc:x", "dbtable": "t", "user": "u", "password": "p", "options": None, "mode": "append"}


def test_a_processing_time_trigger_goes_on_until_it_is_stopped(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(3).write.parquet(source)
    stream = spark.readStream.schema("id long").parquet(source)
    query = start(stream.writeStream.foreachBatch(batch_files(out)), name(), str(tmp_path / "cp"), trigger="1 seconds")
    try:
        deadline = time.time() + 60
        for rows in (3, 5):
            while not query.lastProgress or sum(p["numInputRows"] for p in query.recentProgress) < rows:
                assert time.time() < deadline and query.isActive
                time.sleep(0.2)
            if rows == 3:
                spark.range(10, 12).write.mode("append").parquet(source)
        assert query.isActive
    finally:
        query.stop()
    assert batches(spark, out, stream.schema).count() == 5
