"""Alert runs over a stream against the batch query."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from stayflow.operators import alerts
from stayflow.streaming import alert_runs
from stayflow.streaming.queries import batch_files, batches
from tests.test_streaming import run

RULES = [alerts.Rule("Low", "value < 14", 600, "warning", "%s: %s"), alerts.Rule("Zero", "value = 0", 120, "critical", "%s", "metric = 'a'")]
SAMPLE = "ts timestamp, metric string, labels map<string,string>, value double"


def test_runs_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    rng, base = random.Random(9), dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = []
    for series in range(4):
        at = base
        for _ in range(150):
            at += dt.timedelta(seconds=rng.choice([5, 30, 61, 200, 299, 301, 900]) if rng.random() < 0.5 else 20)
            rows.append((at, "ab"[series % 2], {"series": str(series)}, rng.choice([0.0, 0.0, 0.0, 7.0, 7.0, 20.0, None])))
    rows.sort(key=lambda r: r[0])
    end = rows[-1][0] + dt.timedelta(hours=3)
    # The last sample only moves the watermark on.
    parts = [rows[:200], rows[200:420], rows[420:], [(end, "end", {"series": "end"}, 99.0)], [(end + dt.timedelta(hours=1), "end", {"series": "end"}, 99.0)]]
    series = F.concat_ws("/", F.col("metric"), F.col("labels")["series"])
    source, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    for part in parts:
        spark.createDataFrame(part, SAMPLE).coalesce(1).write.mode("append").parquet(source)
        runs = alert_runs.run_stream(spark.readStream.schema(SAMPLE).parquet(source), RULES, series)
        run(runs, batch_files(out), checkpoint)
    streamed = batches(spark, out, runs.schema).drop("batch")
    expected = alerts.evaluate(spark.createDataFrame(rows, SAMPLE), RULES, series, max_gap="300 seconds")
    assert set(streamed.columns) == set(expected.columns)
    told = sorted(map(tuple, streamed.select(expected.columns).collect()))
    assert told == sorted(map(tuple, expected.collect())) and len(told) > 40
    assert len({r[0] for r in told}) == 2
