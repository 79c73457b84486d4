from __future__ import annotations

import datetime as dt
import json
import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

from stayflow import fixed_values as V
from stayflow import schemas
from stayflow.functions import messages as M
from stayflow.sources import streams, text
from stayflow.streaming import bookings as B
from stayflow.streaming import dedup, latest_table, revenue, ttl_state
from stayflow.streaming.queries import batch_files, batches, start
from tests.conftest import rows


def name():
    return f"q{uuid.uuid4().hex[:8]}"


def marketing(*events):
    """(time, property, value) as messages."""
    return [
        (V.TOPIC_MARKETING, str(p), json.dumps({"event": "new_booking", "property_id": p, "booking_value": v, "timestamp": f"2024-01-01T{t}"}))
        for t, p, v in events
    ]


def put(spark, root, messages):
    """Add one file of messages to a topic folder."""
    df = spark.createDataFrame(messages, schemas.MESSAGE).coalesce(1)
    streams.write_file_topics(df, root)
    time.sleep(0.05)


def run(stream, sink, checkpoint, mode="append"):
    query = start(stream.writeStream.outputMode(mode).foreachBatch(sink), name(), checkpoint)
    query.awaitTermination()
    return query


def test_append_holds_back_open_windows(spark, tmp_path):
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, root, marketing(("10:00:00", 1, 5.0), ("10:01:00", 1, 7.0), ("10:30:00", 1, 1.0)))
    totals = revenue.revenue_stream(streams.file_topics(spark, root, [V.TOPIC_MARKETING]))
    run(totals, batch_files(out), str(tmp_path / "cp"))
    got = [tuple(r)[2:6] for r in batches(spark, out, totals.schema).collect()]
    assert got == [(1, 2, 12.0, 6.0)]


def test_update_keeps_the_newest_value_over_restarts(spark, tmp_path):
    root, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    source = [marketing(("10:00:00", 1, 5.0)), marketing(("10:02:00", 1, 7.0), ("10:01:00", 2, 1.0))]
    for part in source:
        put(spark, root, part)
        totals = revenue.revenue_stream(streams.file_topics(spark, root, [V.TOPIC_MARKETING]))
        run(totals, batch_files(out), checkpoint, "update")
    got = rows(revenue.newest_windows(batches(spark, out, totals.schema)).select("property_id", "booking_count", "total_revenue"), "property_id")
    assert got == [(1, 2, 12.0), (2, 1, 1.0)]


def test_late_rows_are_dropped_behind_the_watermark(spark, tmp_path):
    root, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    dropped = 0
    for part in [marketing(("10:00:00", 1, 1.0)), marketing(("11:00:00", 1, 1.0)), marketing(("10:48:00", 1, 9.0), ("10:51:00", 1, 2.0))]:
        put(spark, root, part)
        totals = revenue.revenue_stream(streams.file_topics(spark, root, [V.TOPIC_MARKETING]))
        query = run(totals, batch_files(out), checkpoint, "update")
        dropped += sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    assert dropped == 1
    kept = revenue.newest_windows(batches(spark, out, totals.schema))
    assert sorted(r.total_revenue for r in kept.collect()) == [1.0, 1.0, 2.0]


def test_a_replayed_batch_replaces_its_output(spark, tmp_path):
    df = spark.range(5)
    sink = batch_files(str(tmp_path / "out"))
    sink(df, 0)
    sink(df, 0)
    sink(df, 1)
    assert batches(spark, str(tmp_path / "out"), df.schema).count() == 10


def test_topics_are_separate_and_resume(spark, tmp_path):
    root, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    put(spark, root, [(V.TOPIC_BOOKINGS, "a", "1"), (V.TOPIC_INVOICES, "b", "2"), (V.TOPIC_MARKETING, "c", "3")])
    for _ in range(2):  # the second run finds nothing new
        run(streams.file_topics(spark, root, [V.TOPIC_BOOKINGS, V.TOPIC_MARKETING]), batch_files(out), checkpoint)
    got = rows(batches(spark, out, schemas.MESSAGE).select("topic", "key", "value"), "key")
    assert got == [(V.TOPIC_BOOKINGS, "a", "1"), (V.TOPIC_MARKETING, "c", "3")]


def booking(number, price, sent, **more):
    body = {"booking_id": f"BK-{number}", "property_id": 1, "guest_name": "Jan", "email": "j@x.pl", "check_in": "2026-01-01",
            "check_out": "2026-01-03", "nights": 2, "total_price": price, "timestamp": sent} | more
    return (V.TOPIC_BOOKINGS, f"BK-{number}", json.dumps(body))


def test_ingest_over_batches_keeps_the_last_message(spark, tmp_path):
    root, records, checkpoint = str(tmp_path / "in"), str(tmp_path / "records"), str(tmp_path / "cp")
    parts = [
        [booking(1, 10, "2026-01-01T10:00:00"), booking(2, 20, "2026-01-01T10:00:00"), booking(3, "n/a", "2026-01-01T10:00:00")],
        [booking(1, 12, "2026-01-01T11:00:00", guests=5)],
        [booking(2, 19, "2026-01-01T09:00:00"), (V.TOPIC_BOOKINGS, "x", "not json")],
    ]
    for part in parts:
        put(spark, root, part)
        run(streams.file_topics(spark, root, [V.TOPIC_BOOKINGS]), B.ingest_batch(records), checkpoint)
    table = B.booking_table(spark, records)
    got = rows(table.select("booking_id", F.col("total_price").cast("int"), "guests", "status", "pipeline"), "booking_id")
    assert got == [("BK-1", 12, 5, "confirmed", V.PIPELINE_LABEL), ("BK-2", 20, 2, "confirmed", V.PIPELINE_LABEL)]
    assert B.rejected_messages(spark, records).count() == 2


def test_confirm_only_named_bookings(spark):
    table = spark.createDataFrame([("a", "pending", False), ("b", "pending", False)], "id string, status string, invoice_sent boolean")
    events = spark.createDataFrame([("a",), ("a",), ("z",)], "id string")
    assert rows(B.confirm(table, events, "id"), "id") == [("a", "confirmed", True), ("b", "pending", False)]


def brute_force(data, ttl):
    kept, last = [], {}
    for key, when, tie in sorted(data, key=lambda r: (r[1], r[2])):
        if key not in last or when - last[key] >= ttl:
            last[key] = when
            kept.append((key, when))
    return sorted(kept)


@pytest.mark.parametrize(("hours", "seed"), [(24, 1), (24, 2), (5, 3)])
def test_first_per_ttl_against_brute_force(spark, hours, seed):
    rng = random.Random(seed)
    base = dt.datetime(2024, 1, 1, 3)
    data = []
    for i in range(400):
        key = "hot" if rng.random() < 0.5 else f"k{rng.randrange(6)}"
        data.append((key, base + dt.timedelta(minutes=rng.choice([30, 60, 90]) * rng.randrange(90)), i))
    df = spark.createDataFrame(data, "k string, ts timestamp_ntz, i long")
    kept = dedup.first_per_ttl(df, ["k"], "ts", "i", ttl_seconds=hours * 3600)
    assert sorted((r.k, r.ts) for r in kept.collect()) == brute_force(data, dt.timedelta(hours=hours))


def test_rows_without_a_time_or_a_key(spark):
    day = dt.datetime(2024, 1, 1)
    data = [(None, day, 1), (None, day + dt.timedelta(hours=23), 2), (None, day + dt.timedelta(hours=24), 3), (None, None, 4), ("a", None, 5),
            ("a", None, 5), ("a", day, 7), ("a", day, 6), ("a", dt.datetime(1969, 12, 31, 1), 8)]
    df = spark.createDataFrame(data, "k string, ts timestamp_ntz, i long")
    kept = dedup.first_per_ttl(df, ["k"], "ts", "i")
    assert sorted(r.i for r in kept.collect()) == [1, 3, 4, 5, 5, 6, 8]


def test_first_per_ttl_over_long_runs(spark):
    base = dt.datetime(2024, 1, 1)
    data = [("hot", base + dt.timedelta(minutes=7 * i), i) for i in range(9000)] + [("b", base + dt.timedelta(hours=24 * i), i) for i in range(40)]
    data += [("c", base + dt.timedelta(hours=24 * i, microseconds=-i), i) for i in range(40)]
    df = spark.createDataFrame(data, "k string, ts timestamp_ntz, i long")
    kept = dedup.first_per_ttl(df, ["k"], "ts", "i")
    assert sorted((r.k, r.ts) for r in kept.collect()) == brute_force(data, dt.timedelta(hours=24))


def test_first_per_ttl_of_nothing(spark):
    empty = spark.createDataFrame([], "k string, ts timestamp_ntz, i long")
    assert dedup.first_per_ttl(empty, ["k"], "ts", "i").count() == 0


def test_totals_without_late_rows_are_those_of_the_stream(spark, tmp_path):
    root, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    deliveries = [[("10:00:00", 1, 1.0), ("10:03:00", 1, 4.0)], [("11:00:00", 1, 1.0), ("09:50:00", 2, 3.0)],
                  [("10:48:00", 1, 9.0), ("10:51:00", 1, 2.0), ("10:01:00", 1, 7.0)], [("12:00:00", 2, 5.0)]]
    for part in deliveries:
        put(spark, root, marketing(*part))
        totals = revenue.revenue_stream(streams.file_topics(spark, root, [V.TOPIC_MARKETING]))
        run(totals, batch_files(out), checkpoint, "update")
    streamed = revenue.newest_windows(batches(spark, out, totals.schema))
    given = [(n, *r) for n, part in enumerate(deliveries) for r in part]
    rows_of = spark.createDataFrame(given, "delivered int, t string, property_id int, booking_value double").withColumn(
        "event_time", F.concat(F.lit("2024-01-01 "), "t").cast("timestamp"))
    batch = revenue.totals_without_late(rows_of, "delivered")
    assert batch.columns == streamed.columns
    assert rows(batch, *batch.columns[:3]) == rows(streamed, *batch.columns[:3])


def test_stream_dedup_drops_repeats_in_later_batches(spark, tmp_path):
    root, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    for part in [marketing(("10:00:00", 1, 1.0)), marketing(("10:05:00", 1, 1.0), ("10:06:00", 2, 1.0))]:
        put(spark, root, part)
        decoded = M.with_event_time(M.decode_marketing(streams.file_topics(spark, root, [V.TOPIC_MARKETING])))
        unique = dedup.stream_dedup(decoded, ["property_id"], "event_time")
        run(unique, batch_files(out), checkpoint)
    assert rows(batches(spark, out, decoded.schema).select("property_id"), "property_id") == [(1,), (2,)]


def key_reader(spark, out, schema):
    def read():
        try:
            return rows(batches(spark, out, schema).select("key"), "key")
        except Exception:  # nothing written yet
            return []

    return read


def wait(query, done, seconds=120):
    """Processing-time state never ends by itself: wait for the expected result."""
    deadline = time.time() + seconds
    while not done():
        assert time.time() < deadline and query.isActive, query.exception()
        time.sleep(0.3)


@pytest.mark.parametrize(("ttl", "pause", "expected"), [(3600, 0, ["a", "b", "c"]), (2, 5, ["a", "b", "b", "c"])])
def test_wall_clock_ttl(spark, tmp_path, ttl, pause, expected):
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, root, [("t", "a", "1"), ("t", "a", "2"), ("t", "b", "3")])
    stream = streams.file_topics(spark, root, ["t"])
    writer = ttl_state.first_seen(stream, ["key"], ttl).writeStream.foreachBatch(batch_files(out))
    read = key_reader(spark, out, stream.schema)
    query = start(writer, name(), str(tmp_path / "cp"), trigger="0 seconds")
    try:
        wait(query, lambda: len(read()) >= 2)
        time.sleep(pause)
        put(spark, root, [("t", "b", "4"), ("t", "c", "5")])
        wait(query, lambda: ("c",) in read())
    finally:
        query.stop()
    assert [k for (k,) in read()] == expected


def test_latest_value_is_kept_for_a_while(spark, tmp_path):
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, root, [("t", "a", "1"), ("t", "b", "1"), ("t", "b", "0")])
    numbered = streams.file_topics(spark, root, ["t"]).withColumn("place", F.col("value").cast("long"))
    changes = ttl_state.latest_kept(numbered, "key", "value", "place")
    read = key_reader(spark, out, changes.schema)
    query = start(changes.writeStream.outputMode("update").foreachBatch(batch_files(out)), name(), str(tmp_path / "cp"), trigger="0 seconds")
    try:
        wait(query, lambda: len(read()) >= 2)
        put(spark, root, [("t", "a", "1"), ("t", "a", "-5"), ("t", "b", "2"), ("t", "b", "1")])  # a does not change
        wait(query, lambda: len(read()) >= 3)
    finally:
        query.stop()
    got = rows(batches(spark, out, changes.schema).select("key", "value", "known"), "key", "value")
    assert got == [("a", "1", False), ("b", "1", False), ("b", "2", True)]


def test_the_latest_table_does_not_depend_on_the_order_of_rows(spark, tmp_path):
    rng, base = random.Random(2), dt.datetime(2024, 1, 1)
    given = [(f"k{rng.randrange(9)}", base + dt.timedelta(minutes=rng.randrange(600)), i) for i in range(200)] + [("none", None, 1)]
    expected = {}
    for key, when, i in given:
        if when is not None:
            expected[key] = max(expected.get(key, (base, -1)), (when, i))
    for turn in range(2):
        rng.shuffle(given)
        table = latest_table.LatestTable(spark, f"{tmp_path}/{turn}", {"k": "string"}, {"ts": "timestamp_ntz", "i": "long"}, {"note": "string"},
                                         buckets=4, compact_after=2)
        for number, at in enumerate(range(0, len(given), 70)):
            batch = spark.createDataFrame(given[at:at + 70], "k string, ts timestamp_ntz, i long").withColumn("note", F.lit("x"))
            table.sink()(batch, number)
            table.sink()(batch, number)
        now = F.lit("2024-01-01 10:30:00").cast("timestamp_ntz")
        alive = {k: v for k, v in expected.items() if v[0] > base + dt.timedelta(minutes=630) - dt.timedelta(hours=1)}
        assert {r.k: (r.ts, r.i) for r in table.alive("ts", now, 3600).collect()} == alive and alive


def test_totals_in_a_table_over_batches(spark, tmp_path):
    table = revenue.totals_table(spark, str(tmp_path), buckets=4, compact_after=2)
    sink = revenue.totals_sink(table)
    parts = [marketing(("10:00:00", 1, 5.0), ("10:01:00", 1, 7.0)), marketing(("09:00:00", 1, 1.0), ("10:02:00", 1, None)), marketing(("10:04:59", 1, 2.5)),
             marketing(("10:00:00", 2, 4.0))]
    for number, part in enumerate(parts):
        batch = spark.createDataFrame(part, schemas.MESSAGE)
        sink(batch, number)
        sink(batch, number)
    every = spark.createDataFrame([m for p in parts for m in p], schemas.MESSAGE)
    expected = revenue.revenue_batch(every)
    found = revenue.table_windows(table)
    assert found.columns == expected.columns
    assert rows(found, "window_start", "property_id") == rows(expected, "window_start", "property_id") and found.count() == 3


def test_log_tail_labels_files(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("one\n\ntwo\r\n")
    (tmp_path / "logs" / "b.txt").write_text("other\n")
    out = str(tmp_path / "out")
    lines = text.log_stream(spark, str(tmp_path / "logs"), "containerlogs")
    run(lines, batch_files(out), str(tmp_path / "cp"))
    got = batches(spark, out, lines.schema).collect()
    assert sorted(r.line for r in got) == ["", "one", "two\r"]
    assert all(r.job == "containerlogs" and r.file_path.endswith("a.log") for r in got)


def test_late_rows_per_delivery(spark):
    data = [(1, "2024-01-01 10:00:00"), (1, "2024-01-01 11:00:00"), (2, "2024-01-01 10:40:00"), (2, "2024-01-01 10:51:00"), (2, None)]
    given = spark.createDataFrame(data, "batch int, t string").select("batch", F.col("t").cast("timestamp_ntz").alias("ts"))
    out = revenue.late_rows(given, "batch", "ts").orderBy("batch").collect()
    assert [tuple(r) for r in out] == [(1, 2, 0), (2, 3, 1)]
