"""The bucketed table, and the request flow over it: stops, replays, buckets left unread, personal data."""

from __future__ import annotations

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from stayflow import fixed_values as V
from stayflow import schemas
from stayflow.functions.privacy import KeyRing
from stayflow.jobs import booking_stream
from stayflow.sources import streams
from stayflow.streaming import bookings as B
from stayflow.streaming import requests as R
from stayflow.streaming.bucketed import BucketedTable
from tests.conftest import rows

RING = KeyRing({1: b"first-key-for-the-tests-only-000", 2: b"second-key-for-the-tests-only-00"})
PAIRS = "id string, n long"


def newest(df):
    return df.groupBy("id").agg(*(F.max(c).alias(c) for c in df.columns if c != "id"))


def small_table(spark, path, **how):
    return BucketedTable(spark, str(path), "id", PAIRS, newest, **{"buckets": 8, "compact_after": 3} | how)


def pairs(spark, *values):
    return spark.createDataFrame(list(values), PAIRS)


def test_batches_replays_and_compaction(spark, tmp_path):
    table = small_table(spark, tmp_path)
    assert table.table().count() == 0 and table.current().number == -1
    expected = {}
    for batch in range(6):
        given = [(f"k{i % 20}", batch * (i % 3) + i) for i in range(batch, 40)]
        for key, n in given:
            expected[key] = max(n, expected.get(key, -1))
        assert table.append(pairs(spark, *given), "s", batch)
        assert not table.append(pairs(spark, ("k0", 10_000)), "s", batch)  # delivered again
    assert rows(table.table(), "id") == sorted(expected.items())
    parts = table.current().parts
    assert max(sum(b == x for x, _ in parts) for b in range(8)) <= 3 and any(p.endswith("whole") for _, p in parts)
    # Another source counts its own batches.
    assert table.append(pairs(spark, ("k0", 10_000)), "t", 0)
    assert dict(rows(table.table(), "id"))["k0"] == 10_000


def test_a_stop_before_the_switch_leaves_the_old_version(spark, tmp_path, monkeypatch):
    table = small_table(spark, tmp_path)
    table.append(pairs(spark, ("a", 1)), "s", 0)

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as patch:
        patch.setattr(BucketedTable, "_switch", stop)
        with pytest.raises(RuntimeError):
            table.append(pairs(spark, ("a", 9), ("b", 2)), "s", 1)
    assert rows(table.table(), "id") == [("a", 1)]
    assert table.append(pairs(spark, ("a", 3), ("b", 2)), "s", 1)
    assert rows(table.table(), "id") == [("a", 3), ("b", 2)]


def test_new_keys_leave_the_stored_buckets_unread(spark, tmp_path, monkeypatch):
    table = small_table(spark, tmp_path)
    table.append(pairs(spark, *((f"k{i}", i) for i in range(60))), "s", 0)
    read = []
    plain = BucketedTable._rows
    monkeypatch.setattr(BucketedTable, "_rows", lambda self, parts: read.append({b for b, _ in parts}) or plain(self, parts))
    new = [(f"new{i}", i) for i in range(50)]
    assert table.absent(pairs(spark, *new)).count() == 50
    assert len(read[-1]) <= 2  # at most what a filter mistakes
    given = [("k3", 0), ("k4", 0), *new]
    told = {r.id: r.maybe for r in table.maybe_stored(pairs(spark, *given)).collect()}
    assert told["k3"] and told["k4"] and sum(told.values()) <= 4
    found = table.absent(pairs(spark, *given))
    assert sorted(r.id for r in found.collect()) == sorted(k for k, _ in new)
    assert 0 < len(read[-1]) <= 4
    files = [f for f in table.table([5]).inputFiles()]
    assert files and all("/bucket=5/" in f for f in files)


def test_a_column_that_appears_halfway(spark, tmp_path):
    table = small_table(spark, tmp_path)
    table.append(pairs(spark, ("a", 1), ("b", 2)), "s", 0)
    wide = spark.createDataFrame([("b", 5, "late"), ("c", 7, None)], f"{PAIRS}, note string")
    assert table.append(wide, "s", 1, widen=True)
    assert rows(table.table(), "id") == [("a", 1, None), ("b", 5, "late"), ("c", 7, None)]
    table.append(spark.createDataFrame([("a", 2, "now")], f"{PAIRS}, note string"), "s", 2)
    assert rows(table.table(), "id")[0] == ("a", 2, "now")
    # Opened anew with the older columns, by reader or writer, the table still has the new one.
    table = small_table(spark, tmp_path)
    assert rows(table.table(), "id")[0] == ("a", 2, "now")
    assert small_table(spark, tmp_path).append(pairs(spark, ("d", 1)), "s", 3)
    assert rows(table.table(), "id")[3] == ("d", 1, None)


def message(number, price, sent, **more):
    body = {"booking_id": number, "property_id": 1, "guest_name": "Jan", "email": "j@x.pl", "check_in": "2026-01-01", "check_out": "2026-01-03",
            "nights": 2, "total_price": price, "timestamp": sent} | more
    return (json.dumps({k: v for k, v in body.items() if v is not None}),)


def test_messages_are_ordered_by_their_instant(spark, tmp_path):
    sink = B.ingest_batch(str(tmp_path), buckets=4)
    batches = [[message("a", 10, "2024-01-01T10:30:00+02:00", guests=2), message("a", 20, "2024-01-01T09:00:00Z", guests=5)],
               [message("a", 30, "2024-01-01T08:59:59Z", phone="1"), message("b", 1, None)]]
    for number, batch in enumerate(batches):
        sink(spark.createDataFrame(batch, "value string"), number)
    found = {r.booking_id: r for r in B.booking_table(spark, str(tmp_path), buckets=4).collect()}
    assert (found["a"].guests, int(found["a"].total_price), found["a"].phone) == (5, 20, "1")
    assert found["a"].created_at == dt.datetime(2024, 1, 1, 8, 30)
    # A message without a time is stamped when it comes in; reading again does not change it.
    assert B.booking_table(spark, str(tmp_path), buckets=4).where("booking_id = 'b'").first().created_at == found["b"].created_at
    # No message is read to read the bookings.
    assert all("/bookings/rows/" in f for f in B.booking_table(spark, str(tmp_path), buckets=4).inputFiles())


def test_the_bookings_do_not_depend_on_how_messages_are_batched(spark, tmp_path):
    given = [message(f"b{i % 7}", i % 5, f"2024-01-0{1 + i % 4}T10:00:00", guests=i % 3 or None, phone=str(i) if i % 4 else None) for i in range(60)]
    seen = []
    for name, size in (("one", 60), ("many", 17)):
        sink = B.ingest_batch(f"{tmp_path}/{name}", buckets=4, compact_after=2)
        for number, at in enumerate(range(0, 60, size)):
            sink(spark.createDataFrame(given[at:at + size], "value string"), number)
        seen.append(rows(B.booking_table(spark, f"{tmp_path}/{name}", buckets=4), "booking_id"))
    assert seen[0] == seen[1] and len(seen[0]) == 7


DAY = dt.date(2026, 1, 1)


def request(spark, *ids, **more):
    given = [(i, 1, f"Guest {i}", f"{i}@mail.example.com", "+48123456789", 2, 7, DAY, DAY + dt.timedelta(days=2), None, more.get("price", 10),
              dt.datetime(2025, 12, 1, 8)) for i in ids]
    kinds = R.REQUEST.replace("decimal(10,2)", "int")
    return spark.createDataFrame(given, kinds).withColumn("total_price", F.col("total_price").cast("decimal(10,2)"))


def published(spark, home):
    return spark.read.schema(f"{R.OUTBOX}").parquet(f"{home}/topics")


def publish(spark, home, number):
    batch = spark.read.schema(R.OUTBOX).parquet(f"{home}/outbox")
    R.publish_batch(home, RING, R.topic_files(f"{home}/topics"))(batch.select("seq", "topic", "key", "value"), number)


def test_a_stop_between_insert_and_outbox_loses_and_doubles_nothing(spark, tmp_path, monkeypatch):
    home = str(tmp_path)
    table = R.request_table(spark, f"{home}/table", buckets=4)
    create = R.create_batch(table, home, RING)
    create(request(spark, "a", "b"), 0)
    publish(spark, home, 0)

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as patch:
        patch.setattr(R, "write_outbox", stop)
        with pytest.raises(RuntimeError):
            create(request(spark, "b", "c"), 1)  # inserted, but its messages are not written
    create(request(spark, "b", "c"), 1)
    create(request(spark, "b", "c"), 1)
    publish(spark, home, 1)
    publish(spark, home, 1)
    publish(spark, home, 2)
    sent = published(spark, home).collect()
    assert sorted(r.key for r in sent if r.topic == V.TOPIC_BOOKINGS) == ["a", "b", "c"]
    assert len(sent) == 9 and len({r.seq for r in sent}) == 9
    assert rows(R.bookings(table, RING).select("id", "guest_name", "status", "nights"), "id") == [(i, f"Guest {i}", "pending", 2) for i in "abc"]


def test_messages_come_in_any_order(spark, tmp_path):
    home = str(tmp_path)
    out = R.publish_batch(home, RING, R.topic_files(f"{home}/topics"))
    ring = RING.on(spark)
    from stayflow.functions.privacy import encrypt
    given = spark.range(10).select(F.col("id").alias("seq"), F.lit("t").alias("topic"), F.lit("k").alias("key"), encrypt(F.col("id").cast("string"), ring).alias("value"))
    out(given.where("seq >= 5"), 0)
    out(given.where("seq < 7"), 1)  # later numbers were sent before
    assert sorted(int(r.value) for r in published(spark, home).collect()) == list(range(10))


def test_requests_that_break_a_rule_are_rejected(spark, tmp_path):
    home = str(tmp_path)
    table = R.request_table(spark, f"{home}/table", buckets=4)
    good = request(spark, "ok")
    bad = [good.withColumn(c, v).withColumn("id", F.lit(f"bad-{c}")) for c, v in (
        ("check_out", F.col("check_in")), ("check_in", F.lit(None).cast("date")), ("total_price", F.lit(-1).cast("decimal(10,2)")), ("email", F.lit("nobody")),
        ("guest_name", F.lit(" ")), ("guests", F.lit(0)), ("property_id", F.lit(None).cast("long")))]
    batch = good.withColumn("guests", F.lit(None).cast("int"))
    for b in [*bad, good.withColumn("id", F.lit(None).cast("string"))]:
        batch = batch.unionByName(b)
    R.create_batch(table, home, RING)(batch, 0)
    assert rows(R.bookings(table, RING).select("id", "guests"), "id") == [("ok", 1)]
    reasons = dict(rows(spark.read.parquet(f"{home}/rejects").select(F.coalesce("id", F.lit("")), "rejected")))
    assert reasons.pop("") == "id" and reasons.pop("bad-check_in") == "check_in,check_out"
    assert all(name == f"bad-{reason}" for name, reason in reasons.items()) and len(reasons) == 6


def test_no_personal_data_in_files_and_no_key_in_plans(spark, tmp_path):
    home = str(tmp_path)
    table = R.request_table(spark, f"{home}/table", buckets=4)
    batch = request(spark, "a", "b").unionByName(request(spark, "c").withColumn("check_out", F.lit(None).cast("date")))
    R.create_batch(table, home, RING)(batch, 0)
    for folder in ("table/rows", "outbox", "rejects"):
        for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{home}/{folder}").collect():
            assert not re.search("Guest|@mail|48123", str(r)), folder
    for key in RING.keys.values():
        plain = R.bookings(table, RING)._jdf.queryExecution().toString()
        assert key.decode() not in plain and key.hex() not in plain.lower() and key.hex(" ") not in plain.lower()
    assert rows(R.bookings(table, RING).select("email"), "email") == [("a@mail.example.com",), ("b@mail.example.com",)]


def test_the_job_end_to_end_with_topics_as_files(spark, tmp_path):
    """Requests to bookings, messages, confirmations and mails; an event for a booking that comes later waits for it."""
    home, topics = str(tmp_path / "out"), str(tmp_path / "topics")
    told = spark.createDataFrame([(V.TOPIC_BOOKINGS, "z", json.dumps({"booking_id": "z", "guest_name": "Z", "email": "z@x.pl", "timestamp": "2026-01-01T00:00:00",
                                  "check_in": "2026-01-01", "check_out": "2026-01-02", "property_id": 1, "nights": 1, "total_price": 5}))] * 2, schemas.MESSAGE)
    streams.write_file_topics(told, f"{topics}/sent=first")
    asked = request(spark, "a", "b", "a").select(F.lit(booking_stream.REQUESTS).alias("topic"), F.col("id").alias("key"), F.to_json(F.struct(*R.COLUMNS)).alias("value"))
    streams.write_file_topics(asked, f"{topics}/sent=asked")

    def read(*names):
        return streams.file_topics(spark, topics, list(names))

    def once():
        for run in booking_stream.queries(spark, read, home, RING, R.topic_files(topics), "Brand", trigger=None, one_by_one=True, buckets=4):
            run.awaitTermination()

    once()
    table = R.request_table(spark, f"{home}/requests/table", buckets=4)
    assert rows(R.waiting(table).select("id")) == [("z",)]
    late = request(spark, "z").select(F.lit(booking_stream.REQUESTS).alias("topic"), F.col("id").alias("key"), F.to_json(F.struct(*R.COLUMNS)).alias("value"))
    streams.write_file_topics(late, f"{topics}/sent=late")
    once()
    once()
    assert rows(R.bookings(table, RING).select("id", "status", "invoice_sent"), "id") == [(i, "confirmed", True) for i in "abz"]
    assert R.waiting(table).count() == 0
    mails = spark.read.option("recursiveFileLookup", "true").parquet(f"{home}/confirmations")
    assert sorted(r.recipient for r in mails.collect()) == ["a@mail.example.com", "b@mail.example.com", "z@x.pl"]
    offers = spark.read.option("recursiveFileLookup", "true").parquet(f"{home}/mails")
    assert sorted(r.topic for r in offers.collect()) == [V.TOPIC_INVOICES] * 3 + [V.TOPIC_MARKETING] * 3
