"""Alert rules over metric samples."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from stayflow.operators import alerts
from stayflow.plans.catalog import query
from stayflow.sources import views
from stayflow.sources.tables import table


#: Longest silences in a run, for the test tables: their series have few samples, hours or days apart.
SERIES_GAP, STEP_GAP = "3 days", "2 hours"


def runs_sql(source: str, rules: list[tuple[str, str, int, str, str]]) -> str:
    """Runs of each rule by the textbook query: rules are (name, condition, hold, severity, matcher)."""
    parts = [
        f"""SELECT '{name}' AS alertname, '{severity}' AS severity, {hold} AS hold_seconds, series, step,
            min(ts) AS first_ts, max(ts) AS last_ts, (array_agg(value ORDER BY ts DESC, value DESC))[1] AS value,
            bool_and({condition}) AS ok FROM src WHERE {matcher} AND value IS NOT NULL GROUP BY ALL"""
        for name, condition, hold, severity, matcher in rules
    ]
    return f"""WITH src AS ({source}), steps AS ({' UNION ALL '.join(parts)}),
known AS (SELECT *, lag(last_ts) OVER (PARTITION BY alertname, series ORDER BY step) AS seen FROM steps),
numbered AS (SELECT *, sum(CASE WHEN NOT ok OR first_ts > seen + INTERVAL {SERIES_GAP} THEN 1 ELSE 0 END)
               OVER (PARTITION BY alertname, series ORDER BY step) AS run FROM known),
runs AS (SELECT alertname, severity, series, hold_seconds, min(first_ts) AS started_at, max(last_ts) AS last_at,
           count(*) AS steps, arg_max(value, step) AS last_value,
           CAST(floor(epoch(max(last_ts))) - floor(epoch(min(first_ts))) AS BIGINT) AS held_seconds
         FROM numbered WHERE ok GROUP BY alertname, severity, series, hold_seconds, run)"""


SAMPLES = """SELECT ts, value, event_type, event_type || '/' || user_id AS series,
  time_bucket(INTERVAL 1 MINUTE, ts) AS step,
  CASE event_type WHEN 'signup' THEN 'mounted' WHEN 'view' THEN '' ELSE 'detached' END AS state FROM events"""

CERT_RUNS = runs_sql(SAMPLES, [
    ("CertExpiringSoon", "value < 14", 3600, "warning", "true"),
    ("CertExpiringCritical", "value < 3", 900, "critical", "true"),
    ("CertExpired", "value <= 0", 300, "critical", "true"),
])

RUN_COLUMNS = """alertname, severity, series, started_at, last_at, steps, last_value, held_seconds,
       CASE WHEN held_seconds >= hold_seconds THEN 'firing' ELSE 'pending' END AS state"""


def _series():
    return F.concat_ws("/", F.col("metric"), F.col("labels")["series"])


@query(CERT_RUNS + f""" SELECT {RUN_COLUMNS}, CASE alertname
  WHEN 'CertExpiringSoon' THEN 'Certyfikat ' || series || ' wygasa za ' || last_value || ' dni'
  WHEN 'CertExpiringCritical' THEN 'Certyfikat ' || series || ' wygasa za ' || last_value || ' dni (krytycznie)'
  ELSE 'Certyfikat ' || series || ' WYGASL' END AS summary FROM runs""")
def alert_threshold_hold(spark, sf_dir):
    return alerts.evaluate(views.metric_samples(spark, sf_dir), alerts.CERT_RULES, _series(), max_gap=SERIES_GAP)


LABEL_RUNS = runs_sql(SAMPLES, [
    ("TargetDown", "value < 20", 300, "warning", "regexp_full_match(state, 'detached|unknown')"),
    ("MountNotMounted", "value > 20", 300, "critical", "state <> 'mounted'"),
])


@query(LABEL_RUNS + f""" SELECT {RUN_COLUMNS}, CASE alertname
  WHEN 'TargetDown' THEN 'Scrape target ' || series || ' nieosiagalny (' || last_value || ')'
  ELSE 'Mount ' || series || ' nie jest zamontowany (' || last_value || ')' END AS summary FROM runs""")
def alert_label_regex(spark, sf_dir):
    rules = [
        replace(alerts.TARGET_DOWN, condition="value < 20", matcher=alerts.label_matches("state", "detached|unknown")),
        replace(alerts.NOT_MOUNTED, condition="value > 20", matcher=alerts.label_differs("state", "mounted")),
    ]
    return alerts.evaluate(views.metric_samples(spark, sf_dir), rules, _series(), max_gap=SERIES_GAP)


GAUGES = """SELECT ts, CASE WHEN value < 20 THEN 0.0 WHEN value < 40 THEN 1.0 ELSE value END AS value,
  event_type || '/' || user_id AS series, time_bucket(INTERVAL 1 MINUTE, ts) AS step, event_type,
  CASE event_type WHEN 'signup' THEN 'mounted' WHEN 'view' THEN '' ELSE 'detached' END AS state FROM events"""
EQUAL_RUNS = runs_sql(GAUGES, [
    ("TargetDown", "value = 0", 300, "warning", "event_type IN ('click', 'purchase')"),
    ("Sealed", "value = 1", 120, "critical", "true"),
    ("MountNotMounted", "value = 1", 300, "critical", "state <> 'mounted'"),
])


@query(EQUAL_RUNS + f""" SELECT {RUN_COLUMNS}, CASE alertname
  WHEN 'TargetDown' THEN 'Scrape target ' || series || ' nieosiagalny (' || last_value || ')'
  WHEN 'Sealed' THEN series || ' jest ZAPIEKETOWONY - aplikacje nie dostaną sekretów ani nie odszyfrują PII'
  ELSE 'Mount ' || series || ' nie jest zamontowany (' || last_value || ')' END AS summary FROM runs""")
def alert_equality(spark, sf_dir):
    """State gauges 0 and 1, made from low values; a rule looks at the series its matcher selects."""
    state = F.when(F.col("value") < 20, 0.0).when(F.col("value") < 40, 1.0).otherwise(F.col("value").cast("double"))
    rules = [
        replace(alerts.TARGET_DOWN, matcher="metric rlike '^(?:click|purchase)$'"),
        alerts.SEALED,
        replace(alerts.NOT_MOUNTED, matcher=alerts.label_differs("state", "mounted")),
    ]
    gauges = views.metric_samples(spark, sf_dir).withColumn("value", state)
    return alerts.evaluate(gauges, rules, _series(), max_gap=SERIES_GAP)


def aggregate_runs_sql(value: str, width: str, condition: str, hold: int, where: str = "true") -> str:
    return f"""WITH steps AS (
  SELECT time_bucket(INTERVAL {width}, ts) AS step, {value} AS value, min(ts) AS first_ts, max(ts) AS last_ts
  FROM events WHERE {where} GROUP BY ALL),
known AS (SELECT *, {condition} AS ok, lag(last_ts) OVER (ORDER BY step) AS seen FROM steps WHERE value IS NOT NULL),
numbered AS (SELECT *, sum(CASE WHEN NOT ok OR first_ts > seen + INTERVAL {STEP_GAP} THEN 1 ELSE 0 END) OVER (ORDER BY step) AS run
             FROM known)
SELECT min(first_ts) AS started_at, max(last_ts) AS last_at, count(*) AS steps, arg_max(value, step) AS last_value,
       CAST(floor(epoch(max(last_ts))) - floor(epoch(min(first_ts))) AS BIGINT) AS held_seconds,
       CASE WHEN floor(epoch(max(last_ts))) - floor(epoch(min(first_ts))) >= {hold} THEN 'firing' ELSE 'pending' END AS state
FROM numbered WHERE ok GROUP BY run"""


@query(aggregate_runs_sql("max(value)", "15 MINUTE", "value < 60", alerts.NO_LEADER_HOLD_SECONDS, "event_type = 'purchase'"))
def alert_max_series(spark, sf_dir):
    samples = views.metric_samples(spark, sf_dir).filter("metric = 'purchase'")
    return alerts.evaluate_aggregate(
        samples, F.max("value"), F.col("value") < 60, alerts.NO_LEADER_HOLD_SECONDS, "15 minutes", STEP_GAP
    )


LAG = "max(value) FILTER (WHERE event_type = 'click') - max(value) FILTER (WHERE event_type = 'view')"


@query(aggregate_runs_sql(LAG, "1 HOUR", "value > 30", alerts.LAG_HOLD_SECONDS, "event_type IN ('click', 'view')"))
def alert_lag_diff(spark, sf_dir):
    ahead = F.max(F.when(F.col("metric") == "click", F.col("value")))
    behind = F.max(F.when(F.col("metric") == "view", F.col("value")))
    return alerts.evaluate_aggregate(
        views.metric_samples(spark, sf_dir).filter("metric IN ('click', 'view')"), ahead - behind, F.col("value") > 30,
        alerts.LAG_HOLD_SECONDS, "1 hour", STEP_GAP
    )


@query("""WITH last AS (SELECT o_custkey, max(o_orderdate) AS last_ts FROM orders GROUP BY ALL)
SELECT *, CASE WHEN age_seconds >= 35 * 86400 + 3600 THEN 'firing' ELSE 'pending' END AS state FROM (
  SELECT o_custkey, last_ts, CAST(epoch(TIMESTAMP '2001-08-01 00:30:00') - epoch(last_ts) AS BIGINT) AS age_seconds FROM last)
WHERE age_seconds > 35 * 86400""")
def stale_keys(spark, sf_dir):
    now = F.lit("2001-08-01 00:30:00").cast("timestamp_ntz")
    return alerts.stale_keys(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", now)


@query(CERT_RUNS + """, firing AS (
  SELECT alertname, severity, series AS secret, started_at + to_seconds(hold_seconds) AS fired_at, last_at,
         last_at + INTERVAL 5 MINUTE AS done_at FROM runs WHERE held_seconds >= hold_seconds),
marked AS (SELECT *, max(done_at) OVER (PARTITION BY alertname, secret ORDER BY fired_at, last_at
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open_until FROM firing),
sessions AS (SELECT *, sum(CASE WHEN fired_at <= open_until THEN 0 ELSE 1 END) OVER (PARTITION BY alertname, secret
    ORDER BY fired_at, last_at ROWS UNBOUNDED PRECEDING) AS session FROM marked),
opened AS (SELECT *, epoch_us(min(fired_at) OVER w) + 30000000 AS first_us, max(done_at) OVER w AS resolved_at
    FROM sessions WINDOW w AS (PARTITION BY alertname, secret, session)),
news AS (SELECT alertname, secret, session, first_us, resolved_at, severity = 'critical' AS critical,
    greatest(0, CAST(ceil((epoch_us(fired_at) - first_us) / 300e6) AS BIGINT)) AS look FROM opened),
told AS (SELECT alertname, secret, session, first_us, resolved_at, look, count(*) AS n, bool_or(critical) AS critical
    FROM news GROUP BY ALL),
looks AS (SELECT alertname, secret, session, first_us, resolved_at, UNNEST(generate_series(0,
    CAST(ceil((epoch_us(resolved_at) - first_us) / 300e6) AS BIGINT))) AS nth FROM (SELECT DISTINCT alertname, secret, session, first_us, resolved_at FROM told)),
announced AS (SELECT l.*, max(t.look) AS last_news, sum(t.n) AS alerts, bool_or(t.critical) AS critical
    FROM looks l JOIN told t ON t.alertname = l.alertname AND t.secret = l.secret AND t.session = l.session AND t.look <= l.nth
    GROUP BY ALL),
kinds AS (SELECT *, CASE WHEN nth = max(nth) OVER (PARTITION BY alertname, secret, session) THEN 'resolved'
    WHEN nth = last_news THEN 'firing' WHEN (nth - last_news) % 48 = 0 THEN 'repeat' END AS kind FROM announced)
SELECT alertname, secret, make_timestamp(CAST(first_us + nth * 300000000 AS BIGINT)) AS notify_at, kind, resolved_at,
       CAST(alerts AS BIGINT) AS alerts, CASE WHEN critical THEN 'email-critical' ELSE 'email-default' END AS receiver
FROM kinds WHERE kind IS NOT NULL""")
def alert_notifications(spark, sf_dir):
    firing = alerts.firing(views.metric_samples(spark, sf_dir), alerts.CERT_RULES, _series(), max_gap=SERIES_GAP)
    return alerts.notifications(firing.withColumnRenamed("series", "secret"), ["alertname", "secret"])


@query("""WITH c AS (SELECT event_type, event_id, ts, CAST(value AS DECIMAL(12,2)) AS value,
             time_bucket(INTERVAL 5 MINUTE, ts) AS window_start FROM events),
d AS (SELECT *, lag(value) OVER (PARTITION BY event_type, window_start ORDER BY ts, event_id) AS before FROM c)
SELECT event_type, window_start, count(*) AS samples,
       CAST(sum(CASE WHEN before IS NULL THEN 0 WHEN value < before THEN value ELSE value - before END) AS DOUBLE) / 300 AS rate
FROM d GROUP BY ALL""")
def counter_rate(spark, sf_dir):
    counters = table(spark, sf_dir, "events").select(
        "event_type", "event_id", "ts", F.col("value").cast("decimal(12,2)").alias("value")
    )
    return alerts.counter_rate(counters, ["event_type"], "ts", "value", "event_id")
