"""First message per key, with keys that are forgotten after a while."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayflow import fixed_values as V
from stayflow.operators.latest import pick_first
from stayflow.session import work_dir


def _micros(rows: DataFrame, ts: str) -> Column:
    """The time as microseconds since 1970, whatever the session's time zone."""
    if isinstance(rows.schema[ts].dataType, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`)")
    return F.unix_micros(ts)


def _runs(instants: DataFrame, ttl: int) -> DataFrame:
    """Cells (key, period) with their run: a key's periods between two pauses of at least `ttl`.

    After such a pause the next row is always kept, so runs do not depend on each other. Only cells are put in order per
    key: as many as the time range has periods, however many rows there are. Inside a run no period is empty.
    """
    cells = instants.groupBy("_key", "_period").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    over = Window.partitionBy("_key").orderBy("_period")
    pause = F.col("_first") - F.lag("_last").over(over)
    cells = cells.withColumn("_fresh", F.coalesce(pause >= ttl, F.lit(True)))
    cells = cells.withColumn("_run", F.sum(F.col("_fresh").cast("int")).over(over.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    same = F.lead("_run", 2).over(over) == F.col("_run")
    return cells.withColumn("_beyond", F.when(same, F.lead("_first", 2).over(over)))


def _successors(inside: DataFrame, ttl: int) -> DataFrame:
    """(_key, _at, _next): the first instant of the run that is `ttl` or more behind each one.

    It lies in the next period, or is the first of the one after that. Per key and period, instants and questions are put in
    one order, latest first, and a question takes the last instant before it; a busy key is so many groups as it has periods.
    """
    instants = inside.select("_key", "_period", "_at", F.col("_at").alias("_real"), F.lit(None).cast("long").alias("_asker"), F.lit(None).cast("long").alias("_beyond"))
    asked = inside.select("_key", (F.col("_period") + 1).alias("_period"), (F.col("_at") + ttl).alias("_at"), F.lit(None).cast("long").alias("_real"),
                          F.col("_at").alias("_asker"), "_beyond")
    order = Window.partitionBy("_key", "_period").orderBy(F.desc("_at"), F.col("_asker").isNotNull())
    last = F.last("_real", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = instants.unionByName(asked).withColumn("_next", F.coalesce(last, "_beyond")).where("_asker is not null and _next is not null")
    return found.select("_key", F.col("_asker").alias("_at"), "_next")


def first_per_ttl(rows: DataFrame, keys: list[str], ts: str, tie: str, ttl_seconds: int = V.TTL_PROCESSED) -> DataFrame:
    """Keep a row when its key was not kept in the `ttl_seconds` before it. Exact, over event time.

    NULL is a key like any other. A row without a time has no place in the order: it is always kept and makes nothing a
    repeat. Of rows with one key and time the first by `tie` is taken.

    Every instant of a key points to the first one that could be kept after it. The kept ones are those met on the way from
    the first instant of a run; their number doubles with each round, in which pointers are joined with themselves, so a
    run of n kept rows takes log n rounds. Runs that are shorter than the lifetime keep their first row and take no
    part. All joins are on key and instant, so a busy key is spread like many others.
    """
    spark, home, ttl = rows.sparkSession, work_dir(rows.sparkSession, "first-per-ttl"), ttl_seconds * 1_000_000

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{home}/{name}")
        return spark.read.schema(df.schema).parquet(f"{home}/{name}")

    placed = rows.where(F.col(ts).isNotNull()).withColumns({
        "_key": F.struct(*(F.col(k) for k in keys)), "_at": _micros(rows, ts)})
    single = stored(pick_first(placed, ["_key", "_at"], [F.col(tie).asc()]).withColumn(
        "_period", F.call_function("div", F.col("_at") - F.pmod(F.col("_at"), F.lit(ttl)), F.lit(ttl))), "single")
    cells = stored(_runs(single.select("_key", "_period", "_at"), ttl), "cells")
    runs = cells.groupBy("_key", "_run").agg(F.min("_first").alias("_start"), F.max("_last").alias("_end"))
    kept = runs.select("_key", F.col("_start").alias("_at"))
    long = runs.where(F.col("_end") - F.col("_start") >= ttl).select("_key", "_run")
    reached = stored(runs.where(F.col("_end") - F.col("_start") >= ttl).select("_key", F.col("_start").alias("_at")), "reached-0")
    inside = single.select("_key", "_period", "_at").join(cells.join(long, ["_key", "_run"]).select("_key", "_period", "_beyond"), ["_key", "_period"])
    steps, turn, later = None, 0, []
    while not reached.isEmpty():
        if steps is None:
            steps = stored(_successors(inside, ttl), "steps-0")
        turn += 1
        met = stored(reached.join(steps, ["_key", "_at"]).select("_key", F.col("_next").alias("_at")), f"met-{turn}")
        if met.isEmpty():
            break
        later.append(f"{home}/met-{turn}")
        reached = spark.read.schema(met.schema).parquet(f"{home}/reached-0", *later)
        onward = steps.select("_key", F.col("_at").alias("_next"), F.col("_next").alias("_second"))
        steps = stored(steps.join(onward, ["_key", "_next"]).select("_key", "_at", F.col("_second").alias("_next")), f"steps-{turn}")
    if later:
        kept = kept.unionByName(spark.read.schema(kept.schema).parquet(*later))
    chosen = single.join(kept, ["_key", "_at"], "left_semi").select(*rows.columns)
    return chosen.unionByName(rows.where(F.col(ts).isNull()))


def stream_dedup(stream: DataFrame, keys: list[str], ts: str, ttl: str = "24 hours") -> DataFrame:
    """Streaming form with bounded state: a key is remembered until the watermark passes its expiry."""
    return stream.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(keys)
