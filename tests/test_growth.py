"""What is stored, shuffled and held per row must not be more than the job needs."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from stayflow import fixed_values as V
from stayflow.functions import messages as M
from stayflow.functions.privacy import encrypt_columns
from stayflow.streaming import bookings as B
from stayflow.streaming import requests as R
from tests.conftest import rows
from tests.test_bucketed import RING, message, pairs, publish, published, request, small_table

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_outbox_has_one_row_per_booking(spark, tmp_path):
    home = str(tmp_path)
    table = R.request_table(spark, f"{home}/table", buckets=4)
    at = F.lit(dt.datetime(2025, 12, 1, 8, 0, 0, 123456))
    R.create_batch(table, home, RING)(request(spark, "a", "b", "c").withColumn("created_at", at), 0)
    kept = spark.read.schema(R.OUTBOX).parquet(f"{home}/outbox").collect()
    assert sorted(r.key for r in kept) == ["a", "b", "c"]
    R.write_outbox(table, f"{home}/again", RING, "requests", 0)
    assert {(r.seq, r.key) for r in kept} == {(r.seq, r.key) for r in spark.read.schema(R.OUTBOX).parquet(f"{home}/again").collect()}


def test_all_messages_of_an_outbox_row_are_published_once(spark, tmp_path):
    home = str(tmp_path)
    table = R.request_table(spark, f"{home}/table", buckets=4)
    at = F.lit(dt.datetime(2025, 12, 1, 8, 0, 0, 123456))
    R.create_batch(table, home, RING)(request(spark, "a", "b", "c").withColumn("created_at", at), 0)
    publish(spark, home, 0)
    publish(spark, home, 1)
    sent = published(spark, home).collect()
    assert sorted(r.seq for r in sent) == list(range(1, 10))
    expected = M.fan_out(R.bookings(table, RING)).collect()
    assert sorted((r.topic, r.key, r.value) for r in sent) == sorted((r.topic, r.key, r.value) for r in expected)
    assert any("08:00:00.123456" in r.value for r in sent if r.topic == V.TOPIC_BOOKINGS)


def test_the_outbox_names_stored_files_instead_of_holding_bookings_again(spark, tmp_path):
    home = str(tmp_path)
    table = R.request_table(spark, f"{home}/table", buckets=4)
    R.create_batch(table, home, RING)(request(spark, *(f"k{i}" for i in range(40))), 0)
    kept = [r.value for r in spark.read.schema(R.OUTBOX).parquet(f"{home}/outbox").collect()]
    files = {r.file for r in table.written("requests", 0).select(F.col("_metadata.file_path").alias("file")).collect()}
    assert len(kept) == 40 and {v.split(" ", 1)[1] for v in kept} == files and len(set(kept)) == len(files)
    assert not any(V.CIPHER_PREFIX in v for v in kept)


def test_places_that_come_doubled_or_in_parts_are_published_once(spark, tmp_path):
    home = f"{tmp_path}/a folder, 100 % + one"
    table = R.request_table(spark, f"{home}/table", buckets=1)
    many = request(spark, "x").drop("id").crossJoin(spark.range(40_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("id")))
    R.create_batch(table, home, RING)(many.select(*R.COLUMNS), 0)
    R.create_batch(table, home, RING)(request(spark, "a", "b", "k7"), 1)
    batch = spark.read.schema(R.OUTBOX).parquet(f"{home}/outbox").select("seq", "topic", "key", "value")
    some = batch.where(F.crc32(F.col("key").cast("binary")) % 3 == 0)
    out = R.publish_batch(home, RING, R.topic_files(f"{home}/topics"))
    out(some, 0)
    told = F.col("topic") == V.TOPIC_BOOKINGS
    assert rows(published(spark, home).where(told).select("key"), "key") == rows(some.select("key"), "key")
    out(some.unionByName(batch).unionByName(batch), 1)
    sent = published(spark, home)
    assert sent.count() == sent.select("seq").distinct().count() == 3 * 40_002
    assert sent.where(told).join(batch.select("seq", "key"), ["seq", "key"]).count() == 40_002


def test_bookings_in_an_outbox_of_last_rounds_form_are_published(spark, tmp_path):
    home = str(tmp_path)
    given = request(spark, "a", "b").withColumn("nights", F.lit(2))
    days = {c: F.unix_date(c).alias(c) for c in ("check_in", "check_out")} | {"created_at": F.unix_micros("created_at").alias("created_at")}
    note = F.to_json(F.struct(*(days.get(c, F.col(c)) for c in (f.split(" ")[0] for f in R.NOTE.split(", ")))))
    old = encrypt_columns(given, R.PERSONAL, RING.on(spark)).select(
        F.when(F.col("id") == "a", 1).otherwise(4).cast("long").alias("seq"), F.lit(R.ALL).alias("topic"), F.col("id").alias("key"), note.alias("value"))
    out = R.publish_batch(home, RING, R.topic_files(f"{home}/topics"))
    out(old.unionByName(old), 0)
    sent, expected = published(spark, home).collect(), M.fan_out(given).collect()
    assert sorted(r.seq for r in sent) == list(range(1, 7))
    assert sorted((r.topic, r.key, r.value) for r in sent) == sorted((r.topic, r.key, r.value) for r in expected)


def test_filters_are_asked_without_moving_keys(spark, tmp_path):
    table = small_table(spark, tmp_path, filter_words=1)
    table.append(pairs(spark, *((f"k{i}", i) for i in range(40))), "s", 0)
    asked = spark.range(1000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("id"))
    text = plan(table.maybe_stored(asked))
    assert text.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in text
    told = dict(rows(table.maybe_stored(asked).select("id", "maybe")))
    assert all(told[f"k{i}"] for i in range(40)) and sum(told.values()) < 100


def test_full_filters_rule_nothing_out(spark, tmp_path):
    table = small_table(spark, tmp_path, buckets=1, filter_words=1)
    given = spark.range(40_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("id"), F.col("id").alias("n"))
    table.append(given, "s", 0, merged=True)
    asked = spark.range(39_000, 41_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("id"), F.col("id").alias("n"))
    assert table.maybe_stored(asked.select("id")).where("maybe").count() == 2000
    assert table.absent(asked).count() == 1000


def test_buckets_with_one_part_are_read_without_a_shuffle(spark, tmp_path):
    table = small_table(spark, tmp_path)
    table.append(pairs(spark, *((f"k{i}", i) for i in range(60))), "s", 0)
    assert "Exchange" not in plan(table.table())
    table.append(pairs(spark, ("k1", 900)), "s", 1)
    assert rows(table.table(), "id") == sorted([(f"k{i}", i) for i in range(60) if i != 1] + [("k1", 900)])


def test_the_state_holds_each_time_and_digest_once(spark, tmp_path):
    sink = B.ingest_batch(str(tmp_path), buckets=2)
    sink(spark.createDataFrame([message("a", 10, "2024-01-01T08:00:00Z", phone="1"), message("a", 20, "2024-01-02T08:00:00Z", guests=3),
                                message("b", 5, "2024-01-01T08:00:00Z", phone="2", guests=1)], "value string"), 0)
    state = {r.booking_id: r for r in B.state_table(spark, str(tmp_path), buckets=2).table().collect()}
    assert state["a"].phone.value == "1" and state["a"].guests is None and state["a"]["last"].guests == 3
    assert state["b"].phone is None and state["b"].guests is None and state["b"]["last"].phone == "2"
    sink(spark.createDataFrame([message("b", 6, "2024-01-03T08:00:00Z")], "value string"), 1)
    found = rows(B.booking_table(spark, str(tmp_path), buckets=2).select("booking_id", "phone", "guests", F.col("total_price").cast("int")), "booking_id")
    assert found == [("a", "1", 3, 20), ("b", "2", 1, 6)]
    with pytest.raises(ValueError, match="older form"):
        B.enrich(spark.createDataFrame([("a", 1)], "booking_id string, guests int"))


def test_mails_of_bookings_are_those_of_their_messages(spark):
    day = dt.date(2026, 1, 2)
    given = spark.createDataFrame(
        [("a", 1, 'J "x" \\ ż\n', "j@x.pl", "1", day, day, 1, 99999999.99), ("b", 2, None, None, None, None, day, None, None),
         (None, None, "", "", "", day, None, 1, 0.1), ("c", 3, "N", "n@x.pl", None, day, day, 2, 12345678.0)],
        "id string, property_id long, guest_name string, email string, phone string, check_in date, check_out date, nights int, total_price double")
    given = given.withColumns({"total_price": F.col("total_price").cast("decimal(10,2)"), "created_at": F.lit(dt.datetime(2025, 1, 1))})
    slow, fast = M.outbox(M.fan_out(given), "Brand"), M.booking_mails(given, "Brand")
    assert slow.columns == fast.columns and sorted(map(repr, slow.collect())) == sorted(map(repr, fast.collect()))
    assert not re.search("from_json|to_json", plan(contract.queries()["outbox_messages"](spark, SF)))


def test_confirmed_bookings_are_computed_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 10)
    try:
        text = plan(contract.queries()["confirm_bookings"](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "_salt" in text and text.count("WindowGroupLimit") == 2


def test_the_property_report_groups_only_subtotals_again(spark):
    report = contract.queries()["property_report"](spark, SF)
    report.collect()
    text = plan(report)
    assert "ReusedExchange" in text
    assert all("status" not in line for line in text.splitlines() if "Expand" in line)
