"""spark-submit job: booking requests to bookings and messages; booking, invoice and marketing messages to tables and mails.

    spark-submit --packages <kafka connector> --py-files stayflow.zip stayflow/jobs/booking_stream.py --servers host:9092 --out <folder>

The keys for personal data come from spark.stayflow.pii.keys (put it among the settings that spark.redaction.regex hides).
"""

from __future__ import annotations

import argparse
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stayflow import fixed_values as V
from stayflow.functions.messages import outbox, with_dedup_key
from stayflow.functions.privacy import KeyRing
from stayflow.session import build_session
from stayflow.sources.streams import kafka_topics, write_kafka
from stayflow.streaming import requests as R
from stayflow.streaming.bookings import ingest_batch
from stayflow.streaming.dedup import stream_dedup
from stayflow.streaming.queries import batch_files, start

REQUESTS = "booking-requests"


def once_a_day(messages: DataFrame) -> DataFrame:
    """Booking messages, a repeated one left out for a day. Messages without any id are rejected by the ingest: they would all
    be repeats of one key. The state lies in Spark's own store and is forgotten behind the watermark."""
    known = with_dedup_key(messages).filter(F.col("dedup_key") != V.DEFAULT_KEY)
    sent = F.coalesce(F.try_to_timestamp(F.get_json_object("value", "$.timestamp")), F.current_timestamp())
    return stream_dedup(known.withColumn("_sent", sent), ["dedup_key"], "_sent", f"{V.TTL_PROCESSED} seconds").drop("_sent", "dedup_key")


def queries(spark: SparkSession, topics: Callable[..., DataFrame], out: str, ring: KeyRing, send: R.Sink, brand: str = V.BRAND,
            trigger: str | None = V.TRIGGER, one_by_one: bool = False, buckets: int = 64) -> Iterator[StreamingQuery]:
    """Start the queries of the job; `topics` gives the stream of some topics, `send` publishes messages.

    Each query has its own checkpoint and reads the topics independently of the others. With one_by_one each is started when
    the one before has been awaited.
    """
    home = f"{out}/requests"
    table = R.request_table(spark, f"{home}/table", buckets=buckets)
    spark.createDataFrame([], R.OUTBOX).write.mode("append").parquet(f"{home}/outbox/batch=-1")  # a stream needs its folder

    def run(stream: DataFrame, sink: R.Sink, name: str) -> StreamingQuery:
        return start(stream.writeStream.foreachBatch(sink), name, f"{out}/checkpoints/{name}", trigger=trigger)

    asked = topics(REQUESTS).select(F.inline(F.array(F.from_json("value", R.REQUEST))))
    steps = [
        lambda: run(asked, R.create_batch(table, home, ring), "requests"),
        lambda: run(R.outbox_stream(spark, home), R.publish_batch(home, ring, send), "publish"),
        lambda: run(topics(V.TOPIC_BOOKINGS), ingest_batch(f"{out}/bookings", buckets=buckets), "booking-ingest"),
        lambda: run(once_a_day(topics(V.TOPIC_BOOKINGS)), handle_once(table, f"{out}/confirmations", brand), "confirmations"),
        lambda: run(outbox(topics(V.TOPIC_INVOICES, V.TOPIC_MARKETING), brand), batch_files(f"{out}/mails"), "invoices-and-offers"),
    ]
    started = (step() for step in steps)
    yield from started if one_by_one else list(started)


def handle_once(table, mails: str, brand: str) -> R.Sink:
    """What a booking message does the first time it is seen: one mail, and its booking is confirmed."""
    confirm, write = R.confirm_batch(table), batch_files(mails)

    def sink(batch: DataFrame, number: int) -> None:
        write(outbox(batch, brand), number)
        confirm(batch, number)

    return sink


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--servers", required=True)
    parser.add_argument("--out", required=True, help="folder that every executor can reach")
    parser.add_argument("--brand", default=V.BRAND)
    parser.add_argument("--max-messages", default="10000000", help="messages per topic and batch")
    parser.add_argument("--buckets", type=int, default=1024, help="buckets of the booking tables; fixed once they exist")
    args = parser.parse_args()

    spark = build_session("booking-stream")

    def topics(*names):
        return kafka_topics(spark, args.servers, list(names), starting="earliest", maxOffsetsPerTrigger=args.max_messages)

    def send(messages: DataFrame, _: int) -> None:
        write_kafka(messages.select("topic", "key", "value"), args.servers)

    list(queries(spark, topics, args.out, KeyRing.from_conf(spark), send, args.brand, buckets=args.buckets))
    spark.streams.awaitAnyTermination()


if __name__ == "__main__":
    main()
