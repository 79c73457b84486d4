"""spark-submit job: marketing messages into windowed revenue and a raw event table.

    spark-submit --packages <kafka connector> --py-files stayflow.zip stayflow/jobs/marketing_stream.py --servers host:9092 --out <folder>
"""

from __future__ import annotations

import argparse
import os

from stayflow import fixed_values as V
from stayflow.functions.messages import decode_marketing
from stayflow.session import build_session
from stayflow.sources.streams import kafka_topics
from stayflow.streaming.queries import batch_files, batch_jdbc, start
from stayflow.streaming.revenue import revenue_stream


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--servers", required=True)
    parser.add_argument("--out", required=True, help="folder that every executor can reach")
    parser.add_argument("--jdbc-url", help="append the raw events to a database; the password is read from JDBC_PASSWORD")
    parser.add_argument("--jdbc-table", default="marketing_events")
    parser.add_argument("--jdbc-user", default="")
    parser.add_argument("--max-messages", default="10000000", help="messages per batch")
    parser.add_argument("--console", action="store_true", help="print the changed windows instead of writing them")
    args = parser.parse_args()

    spark = build_session("marketing-stream")
    messages = kafka_topics(spark, args.servers, [V.TOPIC_MARKETING], starting="latest", maxOffsetsPerTrigger=args.max_messages)
    revenue = revenue_stream(messages).writeStream.outputMode("update")
    sink = revenue.format("console") if args.console else revenue.foreachBatch(batch_files(f"{args.out}/revenue"))
    start(sink, "marketing-revenue", f"{args.out}/checkpoints/revenue", trigger=V.TRIGGER)
    if args.jdbc_url:
        raw = batch_jdbc(args.jdbc_url, args.jdbc_table, args.jdbc_user, os.environ["JDBC_PASSWORD"])
    else:
        raw = batch_files(f"{args.out}/events")
    start(
        decode_marketing(messages).writeStream.foreachBatch(raw),
        "marketing-events", f"{args.out}/checkpoints/events", trigger=V.TRIGGER,
    )
    # The first query to end, for whatever reason, ends the job.
    spark.streams.awaitAnyTermination()


if __name__ == "__main__":
    main()
