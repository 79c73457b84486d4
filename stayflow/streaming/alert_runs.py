"""Runs of alert rules over a stream of samples: the rows of `operators.alerts.evaluate`, each told once it is over.

Samples are first aggregated by series and step in Spark's own state, which lets go of a step when the watermark has
passed it. Only steps reach the state per rule and series: a few numbers of the open run. A run is over with the first step in
which the condition does not hold, with the first step after too long a silence, or when the watermark shows the silence.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stayflow.operators.alerts import Rule, step_values, summary_text

_STATE = T.StructType([T.StructField(n, T.LongType()) for n in ("started", "last", "steps", "seen")] + [T.StructField("value", T.DoubleType())])
_RUN = "alertname string, series string, started long, last long, steps long, value double"


class _Runs(StatefulProcessor):
    """State of a rule and series; started is -1 while no run is open. Times are in microseconds."""

    def __init__(self, gap_us: int, step_us: int):
        self.gap_us, self.step_us = gap_us, step_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", _STATE)

    def _told(self, key, runs: list[tuple]) -> Iterator[pd.DataFrame]:
        if runs:
            yield pd.DataFrame([(*key, *run) for run in runs], columns=["alertname", "series", "started", "last", "steps", "value"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        steps = pd.concat(list(rows)).sort_values("first")  # the steps of a series that one batch closes
        started, last, count, seen, value = self.state.get() if self.state.exists() else (-1, -1, 0, -1, 0.0)
        over = []
        for ok, first, end, now in zip(steps["ok"], steps["first"], steps["last"], steps["value"]):
            if started >= 0 and (not ok or first > seen + self.gap_us):
                over.append((started, last, count, value))
                started = -1
            if ok:
                started, count = (int(first), 0) if started < 0 else (started, count)
                last, count, value = int(end), count + 1, float(now)
            seen = int(end)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # A step behind the silence can come as late as its own end.
        self.handle.registerTimer((seen + self.gap_us + self.step_us) // 1000 + 1)
        self.state.update((started, last, count, seen, value))
        yield from self._told(key, over)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        started, last, count, _, value = self.state.get()
        self.state.clear()
        yield from self._told(key, [(started, last, count, value)] if started >= 0 else [])

    def close(self) -> None:
        pass


def run_stream(samples: DataFrame, rules: list[Rule], series: Column, step_seconds: int = 60, gap_seconds: int = 300, watermark: str = "10 minutes") -> DataFrame:
    """Runs that are over, with the columns of `evaluate`; append mode. `samples` is a stream of (ts, metric, labels, value)."""
    timed = samples.filter("value IS NOT NULL").withColumn("series", series).withWatermark("ts", watermark)
    steps = timed.groupBy("series", F.window("ts", f"{step_seconds} seconds").alias("w")).agg(*step_values(rules))
    per_rule = F.array(*[
        F.struct(F.lit(r.name).alias("alertname"), F.col(f"_ok{i}").alias("ok"), F.unix_micros(f"_first{i}").alias("first"),
                 F.unix_micros(f"_last{i}").alias("last"), F.col(f"_value{i}").cast("double").alias("value"))
        for i, r in enumerate(rules)
    ])
    told = steps.select("series", F.window_time("w").alias("closed"), F.inline(per_rule)).filter("ok IS NOT NULL")
    runs = told.groupBy("alertname", "series").transformWithStateInPandas(
        statefulProcessor=_Runs(gap_seconds * 1_000_000, step_seconds * 1_000_000), outputStructType=_RUN, outputMode="Append", timeMode="EventTime")
    held = F.call_function("div", F.col("last"), F.lit(1_000_000)) - F.call_function("div", F.col("started"), F.lit(1_000_000))
    hold, severity = F.lit(None).cast("long"), F.lit(None).cast("string")
    for r in rules:
        own = F.col("alertname") == r.name
        hold, severity = F.when(own, r.hold_seconds).otherwise(hold), F.when(own, r.severity).otherwise(severity)
    return runs.select(
        "alertname", severity.alias("severity"), "series", F.timestamp_micros("started").alias("started_at"), F.timestamp_micros("last").alias("last_at"),
        "steps", F.col("value").alias("last_value"), held.alias("held_seconds"),
        F.when(held >= hold, "firing").otherwise("pending").alias("state")).withColumn("summary", summary_text(rules))
