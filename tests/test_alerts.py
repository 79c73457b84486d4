from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from stayflow.operators import alerts
from tests.conftest import rows


def samples(spark, data):
    return spark.createDataFrame(data, "t string, series string, state string, value double").select(
        F.col("t").cast("timestamp_ntz").alias("ts"), F.lit("m").alias("metric"),
        F.map_filter(F.create_map(F.lit("series"), "series", F.lit("state"), "state"), lambda _, v: v.isNotNull()).alias("labels"),
        "value",
    )


def by_series():
    return F.col("labels")["series"]
RULE = alerts.Rule("Low", "value < 10", 600, "critical", "%s is at %s")


def at(minute, value, series="a", state=None):
    return (f"2024-01-01 10:{minute:02d}:00", series, state, float(value))


def test_one_false_sample_resets_the_hold(spark):
    data = [at(0, 1), at(5, 1), at(8, 50), at(9, 1), at(18, 1)]
    out = alerts.evaluate(samples(spark, data), [RULE], by_series(), max_gap="1 hour").orderBy("started_at").collect()
    assert [(r.held_seconds, r.state) for r in out] == [(300, "pending"), (540, "pending")]


def test_firing_after_the_hold(spark):
    data = [at(0, 1), at(5, 2), at(10, 3), at(11, 99), at(0, 1, "b")]
    out = alerts.evaluate(samples(spark, data), [RULE], by_series()).orderBy("series").collect()
    assert [(r.series, r.state, r.summary, r.steps) for r in out] == [("a", "firing", "a is at 3.0", 3), ("b", "pending", "b is at 1.0", 1)]


def test_a_false_sample_inside_a_step_counts(spark):
    data = [at(0, 1), ("2024-01-01 10:00:30", "a", None, 50.0), at(10, 1)]
    out = alerts.evaluate(samples(spark, data), [RULE], by_series()).collect()
    assert len(out) == 1 and out[0].held_seconds == 0


def test_rules_do_not_touch_each_other(spark):
    rules = [RULE, replace(RULE, name="VeryLow", condition="value < 2", hold_seconds=60)]
    out = alerts.evaluate(samples(spark, [at(0, 1), at(2, 5), at(4, 1)]), rules, by_series())
    assert rows(out.groupBy("alertname").count(), "alertname") == [("Low", 1), ("VeryLow", 2)]


def test_label_matchers(spark):
    data = [at(0, 1, "a", "up"), at(0, 1, "b", "upper"), at(0, 1, "c", None)]
    whole = replace(RULE, matcher=alerts.label_matches("state", "up|down"))
    assert [r.series for r in alerts.evaluate(samples(spark, data), [whole], by_series()).collect()] == ["a"]
    other = replace(RULE, matcher=alerts.label_differs("state", "up"))
    assert sorted(r.series for r in alerts.evaluate(samples(spark, data), [other], by_series()).collect()) == ["b", "c"]


def test_aggregate_rule(spark):
    data = [at(0, 1), at(0, 20, "b"), at(1, 1), at(3, 2, "b")]
    out = alerts.evaluate_aggregate(samples(spark, data), F.max("value"), F.col("value") < 10, 120, "1 minute").collect()
    assert [(r.steps, r.held_seconds, r.state) for r in out] == [(2, 120, "firing")]


def test_a_silence_ends_a_run(spark):
    data = [at(0, 1), at(4, 1), at(12, 1), at(14, 1)]
    out = alerts.evaluate(samples(spark, data), [RULE], by_series()).orderBy("started_at").collect()
    assert [(r.held_seconds, r.state) for r in out] == [(240, "pending"), (120, "pending")]


def test_times_and_value_come_from_matching_samples(spark):
    data = [("2024-01-01 10:00:00", "a", "no", 99.0), ("2024-01-01 10:00:10", "a", "up", 1.0), ("2024-01-01 10:00:20", "a", "up", 2.0),
            ("2024-01-01 10:00:50", "a", "no", 77.0)]
    rule = replace(RULE, hold_seconds=30, matcher=alerts.label_matches("state", "up"))
    out = alerts.evaluate(samples(spark, data), [rule], by_series()).collect()
    assert [(r.held_seconds, r.state, r.last_value) for r in out] == [(10, "pending", 2.0)]


def test_equality_rule(spark):
    data = [at(0, 1), at(1, 1), at(2, 1), at(3, 0)]
    out = alerts.evaluate(samples(spark, data), [alerts.SEALED], by_series()).collect()
    assert [(r.held_seconds, r.state) for r in out] == [(120, "firing")]


def fired(spark, data):
    return spark.createDataFrame(data, "f string, l string, severity string").select(
        F.lit("Low").alias("alertname"), F.col("f").cast("timestamp_ntz").alias("fired_at"),
        F.col("l").cast("timestamp_ntz").alias("last_at"), "severity",
    )


def test_notifications_repeat_until_resolved(spark):
    data = [("2024-01-01 00:10:00", "2024-01-01 09:00:00", "warning")]
    out = alerts.notifications(fired(spark, data), ["alertname"]).orderBy("notify_at").collect()
    assert [(str(r.notify_at)[11:], r.kind) for r in out] == [
        ("00:10:30", "firing"), ("04:10:30", "repeat"), ("08:10:30", "repeat"), ("09:05:30", "resolved")]


def test_later_alerts_of_an_open_group_wait_for_the_next_look(spark):
    data = [("2024-01-01 00:10:00", "2024-01-01 00:30:00", "warning"), ("2024-01-01 00:12:00", "2024-01-01 00:40:00", "critical"),
            ("2024-01-01 02:00:00", "2024-01-01 02:00:00", "warning")]
    out = alerts.notifications(fired(spark, data), ["alertname"]).orderBy("notify_at").collect()
    assert [(str(r.notify_at)[11:], r.kind, r.alerts, r.receiver) for r in out] == [
        ("00:10:30", "firing", 1, "email-default"), ("00:15:30", "firing", 2, "email-critical"), ("00:45:30", "resolved", 2, "email-critical"),
        ("02:00:30", "firing", 1, "email-default"), ("02:05:30", "resolved", 1, "email-default")]


def test_counter_restart(spark):
    data = [("2024-01-01 10:00:00", 10, 1), ("2024-01-01 10:01:00", 40, 2), ("2024-01-01 10:02:00", 5, 3), ("2024-01-01 10:06:00", 9, 4)]
    counters = spark.createDataFrame(data, "t string, v int, id int").select(F.lit("a").alias("k"), F.col("t").cast("timestamp_ntz").alias("ts"), "v", "id")
    out = alerts.counter_rate(counters, ["k"], "ts", "v", "id").orderBy("window_start").collect()
    assert [(r.samples, round(r.rate * 300, 6)) for r in out] == [(3, 35.0), (1, 0.0)]


def test_stale_keys(spark):
    df = spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-02-20"), ("b", "2024-01-20")], "k string, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    now = F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")
    assert [(r.k, r.state) for r in alerts.stale_keys(df, "k", "t", now).collect()] == [("b", "firing")]
    soon = F.lit("2024-02-24 00:30:00").cast("timestamp_ntz")
    assert [(r.k, r.state) for r in alerts.stale_keys(df, "k", "t", soon).collect()] == [("b", "pending")]


def test_counter_across_cells(spark):
    values = [(3 * i, (i * 7919) % 50) for i in range(300)]
    counters = spark.createDataFrame(values, "s long, v long").select(
        F.lit("a").alias("k"), F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "v", F.col("s").alias("id"))
    got = {cells: [(r.samples, r.rate) for r in alerts.counter_rate(counters, ["k"], "ts", "v", "id", cell_seconds=cells).orderBy("window_start").collect()]
           for cells in (10, 300)}
    assert got[10] == got[300] and len(got[10]) == 3
