from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from stayflow import fixed_values as V
from stayflow.operators import integrity, writes
from stayflow.operators.latest import latest_within, pick_first
from stayflow.sources import text
from tests.conftest import rows


def test_insert_if_absent_keeps_old_rows_and_first_new_ones(spark):
    old = spark.createDataFrame([("a", 1)], "id string, n int")
    new = spark.createDataFrame([("a", 9), ("b", 5), ("b", 4), ("c", 2)], "id string, n int")
    assert rows(writes.insert_if_absent(old, new, "id", [F.col("n")]), "id") == [("a", 1), ("b", 4), ("c", 2)]


def test_upsert_writes_only_the_fields_of_the_event(spark):
    old = spark.createDataFrame([("a", 10, 3, "x"), ("b", 20, 4, "y")], "id string, price int, guests int, note string")
    new = spark.createDataFrame(
        [("a", 1, 11, 9), ("a", 2, 12, 9), ("c", 1, 30, 9), ("b", 1, None, 9)], "id string, seq int, price int, guests int"
    )
    merged = writes.upsert(old, new, "id", [F.col("seq").desc()], ["price"])
    assert rows(merged, "id") == [("a", 12, 3, "x"), ("b", 20, 4, "y"), ("c", 30, None, None)]


def test_update_where_key(spark):
    table = spark.createDataFrame([(1, "pending"), (2, "pending")], "id int, status string")
    keys = spark.createDataFrame([(2,), (2,), (5,)], "id int")
    assert rows(writes.update_where_key(table, keys, "id", {"status": F.lit("confirmed")}), "id") == [
        (1, "pending"), (2, "confirmed"),
    ]


@pytest.mark.parametrize("n", [1, 7, 1000])
def test_assigned_ids_are_dense_and_ordered(spark, n):
    table = spark.range(n).select((F.col("id") * 37 % 1009).alias("k"))
    out = rows(writes.assign_ids(table, ["k"], "new_id", start_after=50), "k")
    assert [r[1] for r in out] == list(range(51, 51 + n))


def test_seed_only_into_an_empty_table(spark):
    seed = spark.createDataFrame([(1,)], "id int")
    full = spark.createDataFrame([(8,), (9,)], "id int")
    assert rows(writes.seed_if_empty(full, seed), "id") == [(8,), (9,)]
    assert rows(writes.seed_if_empty(full.filter("id < 0"), seed)) == [(1,)]


def test_missing_columns_and_insert_shape(spark):
    df = spark.createDataFrame([(1, "a")], "id int, name string")
    wider = writes.add_missing_columns(df, {"name": "string", "user_id": "int"})
    assert wider.columns == ["id", "name", "user_id"] and rows(wider) == [(1, "a", None)]
    assert writes.insert_shape(wider, ["user_id", "id", "absent"]).columns == ["user_id", "id"]


def test_daily_write_keeps_all_rows(spark, tmp_path):
    days = spark.range(100).select("id", F.format_string("2024-01-%02d", F.col("id") % 5 + 1).alias("dt"))
    writes.write_daily(days, str(tmp_path / "log"))
    assert rows(spark.read.schema("id long, dt string").parquet(str(tmp_path / "log")), "id") == rows(days, "id")


def test_latest_with_ttl_boundary(spark):
    data = [("a", "2024-01-01 10:00:00", 1), ("a", "2024-01-01 10:30:00", 2), ("b", "2024-01-01 10:00:00", 3)]
    df = spark.createDataFrame(data, "k string, ts string, v int").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    now = F.lit("2024-01-01 11:00:00").cast("timestamp_ntz")
    alive = latest_within(df, ["k"], "ts", now, 3600, [F.col("v").desc()])
    assert rows(alive.select("k", "v")) == [("a", 2)]  # b was written exactly one ttl ago and is gone


def test_pick_first_limits_rows_before_the_shuffle(spark, capsys):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    pick_first(df, ["k"], [F.col("id").desc()]).explain()
    plan = capsys.readouterr().out
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_double_bookings(spark):
    data = [(1, "2024-01-01", "2024-01-05"), (1, "2024-01-04", "2024-01-06"), (1, "2024-01-06", "2024-01-07"),
            (2, "2024-01-01", "2024-01-02"), (2, "2024-01-01", "2024-01-03"), (3, "2024-01-05", "2024-01-05")]
    df = spark.createDataFrame(data, "property_id int, a string, b string").select(
        "property_id", F.to_date("a").alias("check_in"), F.to_date("b").alias("check_out")
    )
    found = integrity.double_bookings(df).select("property_id", F.col("check_in").cast("string"), "conflict")
    assert rows(found, "property_id") == [(1, "2024-01-04", "earlier stay"), (2, "2024-01-01", "same day")]


def test_backfill_ignores_blank_and_takes_the_highest_user(spark):
    bookings = spark.createDataFrame(
        [(1, None, None, "x@a.pl"), (2, None, None, None), (3, 8, "own", "x@a.pl"), (4, None, None, "no@a.pl")],
        "id int, user_id long, username string, mail string",
    )
    users = spark.createDataFrame([(5, "u5", "x@a.pl"), (6, "u6", "x@a.pl"), (7, "u7", None)], "id long, username string, mail string")
    out = integrity.backfill_owner(bookings, users, "mail", "mail").select("id", "user_id", "username", "linked")
    assert rows(out, "id") == [(1, 6, "u6", True), (2, None, None, False), (3, 8, "own", False), (4, None, None, False)]


def test_orphan_references_are_counted_per_reference(spark):
    refs = spark.createDataFrame([(1,), (1,), (2,), (None,)], "p int")
    targets = spark.createDataFrame([(2,)], "id int")
    assert rows(integrity.orphan_references(refs, "p", targets, "id")) == [(1, 2)]


def test_retention_reads_the_last_days_only(spark, tmp_path):
    now = dt.datetime(2024, 3, 20, 10, 30)
    given = [(i, now - dt.timedelta(hours=9 * i)) for i in range(60)] + [(100, dt.datetime(2024, 3, 6, 10, 30)), (101, dt.datetime(2024, 3, 6, 10, 29, 59))]
    rows = spark.createDataFrame(given, "i long, ts timestamp_ntz").withColumn("dt", F.date_format("ts", "yyyy-MM-dd"))
    writes.write_daily(rows, str(tmp_path))
    daily = spark.read.schema("i long, ts timestamp_ntz, dt string").parquet(str(tmp_path))
    kept = writes.kept_days(daily, "ts", now, 14)
    cut = dt.datetime(2024, 3, 6, 10, 30)
    assert sorted(r.i for r in kept.collect()) == sorted(i for i, ts in given if ts >= cut)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*dt#", plan)
    # Only the border day's rows are compared by their time; the rest is told by the folder.
    days = sorted({r.dt for r in kept.select("dt").distinct().collect()})
    assert days[0] == "2024-03-06"
    expired = writes.expired_days(daily, now, 14)
    assert expired and expired[-1] < "2024-03-06" and set(expired).isdisjoint(days)


def test_a_metrics_text_has_its_header_first(spark, tmp_path):
    lines = [f'cert_days_remaining{{secret="{i}"}} {i}' for i in range(50)] + [f'cert_not_after_seconds{{secret="{i}"}} {i}' for i in range(50)] + V.CERT_HEADER
    text.in_order(spark.createDataFrame([(x,) for x in lines], "value string").repartition(7)).write.text(str(tmp_path / "out"))
    found = [x for f in sorted((tmp_path / "out").glob("part-*.txt")) for x in f.read_text().splitlines()]
    assert sorted(found) == sorted(lines)
    for metric in ("cert_days_remaining", "cert_not_after_seconds"):
        own = [x for x in found if metric in x]
        assert [x.split()[1] for x in own[:2]] == ["HELP", "TYPE"] and not any(x.startswith("#") for x in own[2:])
        assert found.index(own[0]) + 51 == found.index(own[-1])
