"""Threshold rules with a hold time, over metric samples (ts, metric, labels, value).

Samples are first reduced to one row per series and evaluation step, before any shuffle moves them. What is
ordered per series afterwards grows with the time range, not with the number of samples.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayflow import fixed_values as V
from stayflow.functions.messages import fill


@dataclass(frozen=True)
class Rule:
    """`condition` is SQL over `value`, `labels` and `metric`; `matcher` selects the samples it looks at."""

    name: str
    condition: str
    hold_seconds: int
    severity: str
    summary: str
    matcher: str = "true"


# Rules on days left, on targets, and on a state gauge.
CERT_RULES = [
    Rule("CertExpiringSoon", "value < 14", 3600, "warning", "Certyfikat %s wygasa za %s dni"),
    Rule("CertExpiringCritical", "value < 3", 900, "critical", "Certyfikat %s wygasa za %s dni (krytycznie)"),
    Rule("CertExpired", "value <= 0", 300, "critical", "Certyfikat %s WYGASL"),
]
TARGET_DOWN = Rule("TargetDown", "value = 0", 300, "warning", "Scrape target %s nieosiagalny (%s)")
SEALED = Rule("Sealed", "value = 1", 120, "critical", "%s jest ZAPIEKETOWONY - aplikacje nie dostaną sekretów ani nie odszyfrują PII")
NO_LEADER_HOLD_SECONDS = 300
LAG_LIMIT = 1000
LAG_HOLD_SECONDS = 600
NOT_MOUNTED = Rule("MountNotMounted", "value = 1", 300, "critical", "Mount %s nie jest zamontowany (%s)")


def label_matches(label: str, pattern: str) -> str:
    """Whole-value regular expression match; a missing label counts as empty text."""
    return f"coalesce(labels['{label}'], '') rlike '^(?:{pattern})$'"


def label_differs(label: str, value: str) -> str:
    """True also for samples without the label."""
    return f"coalesce(labels['{label}'], '') <> '{value}'"


def step_start(ts: Column | str, step: str) -> Column:
    return F.window(ts, step)["start"]


def number_runs(steps: DataFrame, keys: list[str], rules: list[str], max_gap: str) -> DataFrame:
    """Add `_run<rule>` for each rule: the number of false steps and of silences so far; equal numbers are one run.

    A rule has the columns `_ok<rule>`, `_first<rule>` and `_last<rule>` (the times of its own samples in the step).
    Steps that a rule does not look at (NULL) neither end nor extend a run, unless they add up to more than `max_gap`.
    """
    ordered = Window.partitionBy(*keys).orderBy("step")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    seen = steps.withColumns({f"_seen{r}": F.last(f"_last{r}", ignorenulls=True).over(before) for r in rules})
    ends = {
        r: F.when(~F.col(f"_ok{r}") | (F.col(f"_first{r}") > F.col(f"_seen{r}") + F.expr(f"INTERVAL {max_gap}")), 1) for r in rules
    }
    until = ordered.rowsBetween(Window.unboundedPreceding, 0)
    return seen.withColumns({f"_run{r}": F.count(end).over(until) for r, end in ends.items()})


def summarize_runs(true_steps: DataFrame, keys: list[str], run: str, hold: Column) -> DataFrame:
    """One row per run. It is firing once it has lasted `hold` seconds and pending before that."""
    runs = true_steps.groupBy(*keys, run).agg(
        F.min("first_ts").alias("started_at"),
        F.max("last_ts").alias("last_at"),
        F.count(F.lit(1)).alias("steps"),
        F.max_by("value", "step").alias("last_value"),
    )
    seconds = F.unix_timestamp("last_at") - F.unix_timestamp("started_at")
    return runs.drop(run).withColumns(
        {
            "held_seconds": seconds,
            "state": F.when(seconds >= hold, "firing").otherwise("pending"),
        }
    )


def step_values(rules: list[Rule]) -> list[Column]:
    """Aggregates of a series' step: for rule i whether its condition held throughout, and times and last value of its samples."""
    reductions = []
    for i, rule in enumerate(rules):
        own = F.expr(rule.matcher)
        seen_at = F.when(own, F.col("ts"))
        reductions += [
            F.bool_and(F.when(own, F.expr(rule.condition))).alias(f"_ok{i}"),
            F.min(seen_at).alias(f"_first{i}"), F.max(seen_at).alias(f"_last{i}"),
            F.max_by("value", seen_at).alias(f"_value{i}"),
        ]
    return reductions


def summary_text(rules: list[Rule]) -> Column:
    """The text of a run (alertname, series, last_value)."""
    text = F.lit(None).cast("string")
    for rule in rules:
        args = [F.col("series"), F.col("last_value")][: rule.summary.count("%s")]
        text = F.when(F.col("alertname") == rule.name, fill(rule.summary, *args)).otherwise(text)
    return text


def evaluate(
    samples: DataFrame, rules: list[Rule], series: Column, step: str = "1 minute", max_gap: str = V.STALENESS
) -> DataFrame:
    """Runs of every rule with state, severity and summary text.

    All rules are evaluated in one pass: the samples of a step are reduced to one flag per rule (did its
    condition hold for each of them?) and the times and last value of the samples that the rule's matcher selects,
    the runs of all rules are numbered in one ordering of the series, and only true steps are then split by rule.
    A series that is silent for longer than `max_gap` stops being true. A series has one sample per instant;
    samples without a value are left out.
    """
    keyed = samples.filter("value IS NOT NULL").withColumns({"series": series, "step": step_start("ts", step)})
    reduced = keyed.groupBy("series", "step").agg(*step_values(rules))
    numbered = number_runs(reduced, ["series"], [str(i) for i in range(len(rules))], max_gap)
    per_rule = F.array(
        *[
            F.struct(
                F.lit(r.name).alias("alertname"), F.lit(r.severity).alias("severity"),
                F.lit(r.hold_seconds).alias("hold_seconds"), F.col(f"_ok{i}").alias("ok"), F.col(f"_run{i}").alias("run"),
                F.col(f"_first{i}").alias("first_ts"), F.col(f"_last{i}").alias("last_ts"), F.col(f"_value{i}").alias("value"),
            )
            for i, r in enumerate(rules)
        ]
    )
    true_steps = numbered.select("series", "step", F.inline(per_rule)).filter("ok")
    runs = summarize_runs(true_steps, ["alertname", "severity", "series", "hold_seconds"], "run", F.col("hold_seconds"))
    return runs.withColumn("summary", summary_text(rules)).drop("hold_seconds")


def firing(
    samples: DataFrame, rules: list[Rule], series: Column, step: str = "1 minute", max_gap: str = V.STALENESS
) -> DataFrame:
    """The firing runs and the time at which each began to fire."""
    holds = F.lit(0)
    for rule in rules:
        holds = F.when(F.col("alertname") == rule.name, rule.hold_seconds).otherwise(holds)
    runs = evaluate(samples, rules, series, step, max_gap).filter("state = 'firing'")
    return runs.withColumn("fired_at", F.col("started_at") + F.make_dt_interval(secs=holds))


def evaluate_aggregate(
    samples: DataFrame, value: Column, condition: Column, hold_seconds: int, step: str, max_gap: str = V.STALENESS
) -> DataFrame:
    """Runs of a condition on an aggregate over all series of a step. Give it only the samples that are aggregated."""
    steps = (
        samples.groupBy(step_start("ts", step).alias("step"))
        .agg(value.alias("value"), F.min("ts").alias("_first"), F.max("ts").alias("_last"))
        .filter(F.col("value").isNotNull())
        .withColumns({"_ok": condition, "rule": F.lit("all")})
    )
    true_steps = number_runs(steps, ["rule"], [""], max_gap).filter("_ok").withColumnsRenamed({"_first": "first_ts", "_last": "last_ts"})
    return summarize_runs(true_steps, ["rule"], "_run", F.lit(hold_seconds)).drop("rule")


def stale_keys(
    rows: DataFrame, key: str, ts: str, now: Column, days: int = V.STALE_DAYS, hold_seconds: int = V.STALE_HOLD_SECONDS
) -> DataFrame:
    """Keys whose last row is more than `days` old, firing once that has been so for `hold_seconds`."""
    last = rows.groupBy(key).agg(F.max(ts).alias("last_ts"))
    age = F.unix_timestamp(now) - F.unix_timestamp("last_ts")
    old = last.withColumn("age_seconds", age).filter(F.col("age_seconds") > days * 86400)
    return old.withColumn("state", F.when(F.col("age_seconds") >= days * 86400 + hold_seconds, "firing").otherwise("pending"))


def _micros(ts: Column | str) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def notifications(firing: DataFrame, group: list[str]) -> DataFrame:
    """What is sent for each alert group while it is open, with its receiver.

    A group opens with its first alert and closes when its last alert is resolved, a timeout after the alert's last
    true sample. The first notification goes out after the group wait; the group is then looked at once per group
    interval. New alerts are announced at the next look, a group without news is repeated after the repeat interval,
    and the first look after the group has closed sends that it is resolved. `alerts` counts those announced so far.
    Critical groups go to their own receiver.
    """
    look, repeat = V.GROUP_INTERVAL_SECONDS, V.REPEAT_INTERVAL_SECONDS
    order = Window.partitionBy(*group).orderBy("fired_at", "last_at")
    ends = firing.withColumn("resolved_at", F.col("last_at") + F.make_dt_interval(secs=F.lit(V.RESOLVE_TIMEOUT_SECONDS)))
    before = F.max("resolved_at").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = ends.withColumn("_open", F.coalesce(F.col("fired_at") > before, F.lit(True)))
    opened = opened.withColumn("_session", F.count_if("_open").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    session = Window.partitionBy(*group, "_session")
    timed = opened.withColumns(
        {
            "_first_at": F.min("fired_at").over(session) + F.make_dt_interval(secs=F.lit(V.GROUP_WAIT_SECONDS)),
            "resolved_at": F.max("resolved_at").over(session),
        }
    )
    looks = lambda ts: F.ceil((_micros(ts) - _micros("_first_at")) / F.lit(look * 1_000_000)).cast("long")
    news = timed.withColumn("_look", F.greatest(looks("fired_at"), F.lit(0))).groupBy(
        *group, "_session", "_first_at", "resolved_at", "_look"
    ).agg(F.count(F.lit(1)).alias("alerts"), F.max(F.col("severity") == "critical").alias("critical"))
    so_far = session.orderBy("_look").rowsBetween(Window.unboundedPreceding, 0)
    told = news.withColumns(
        {
            "alerts": F.sum("alerts").over(so_far),
            "critical": F.max("critical").over(so_far),
            "_next": F.lead("_look").over(session.orderBy("_look")),
            "_closed": looks("resolved_at"),
        }
    )
    until = F.greatest(F.coalesce("_next", "_closed") - 1, F.col("_look"))
    sent = F.transform(
        F.sequence("_look", until, F.lit(repeat // look).cast("long")),
        lambda n: F.struct(n.alias("_at"), F.when(n == F.col("_look"), "firing").otherwise("repeat").alias("kind")),
    )
    closing = F.array(F.struct(F.col("_closed").alias("_at"), F.lit("resolved").alias("kind")))
    every = F.when(F.col("_next").isNull(), F.concat(sent, closing)).otherwise(sent)
    return told.select(*group, "resolved_at", "alerts", "critical", "_first_at", F.inline(every)).select(
        *group,
        (F.col("_first_at") + F.make_dt_interval(secs=F.col("_at") * look)).alias("notify_at"),
        "kind",
        "resolved_at",
        "alerts",
        F.when(F.col("critical"), "email-critical").otherwise("email-default").alias("receiver"),
    )


def counter_rate(
    samples: DataFrame, keys: list[str], ts: str, value: str, tie: str, width_seconds: int = 300, cell_seconds: int = 10
) -> DataFrame:
    """Increase per second of a counter in each window; a drop is a restart from zero.

    Samples are grouped by cells of a window, so a busy series is many small groups, and a cell's samples are put in order
    where they are grouped. Of a cell only the first and last value and the increase between them go on, and those are
    ordered by window. Shorter cells make smaller groups.
    """
    if width_seconds % cell_seconds:
        raise ValueError("a window is a whole number of cells")

    def rise(now: Column, before: Column) -> Column:
        return F.when(before.isNull(), 0).when(now < before, now).otherwise(now - before)

    celled = samples.withColumn("_cell", F.window(ts, f"{cell_seconds} seconds")["start"])
    inside = celled.groupBy(*keys, "_cell").agg(F.sort_array(F.collect_list(F.struct(ts, tie, value))).alias("_all"))
    n = F.size("_all")
    steps = F.zip_with(F.slice("_all", 1, n - 1), F.slice("_all", F.lit(2), n - 1), lambda a, b: rise(b[value], a[value]))
    kind = "decimal(38,2)" if isinstance(samples.schema[value].dataType, T.DecimalType) else "double"
    cells = inside.select(
        *keys, "_cell", n.alias("_n"), F.aggregate(steps, F.lit(0).cast(kind), lambda total, step: (total + step).cast(kind)).alias("_rise"),
        F.col("_all")[0][value].alias("_first"), F.element_at("_all", -1)[value].alias("_last"),
    ).withColumn("window_start", F.window("_cell", f"{width_seconds} seconds")["start"])
    across = Window.partitionBy(*keys, "window_start").orderBy("_cell")
    joined = cells.withColumn("_between", rise(F.col("_first"), F.lag("_last").over(across)))
    return joined.groupBy(*keys, "window_start").agg(
        F.sum("_n").alias("samples"),
        ((F.sum("_rise") + F.sum("_between")).cast("double") / F.lit(float(width_seconds))).alias("rate"),
    )
