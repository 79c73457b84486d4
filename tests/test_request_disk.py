"""What a batch of requests leaves on disk: one shuffle while it is written, and none afterwards."""

from __future__ import annotations

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from stayflow import fixed_values as V
from stayflow.functions import messages as M
from stayflow.operators.writes import few_folders, no_shuffle_left
from stayflow.streaming import requests as R
from tests.conftest import rows
from tests.test_bucketed import RING, pairs, publish, published, request, small_table

LEFT = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@pytest.fixture
def writes(spark, monkeypatch):
    """(path, plan, whether what is shuffled goes away) of each write."""
    seen, write = [], DataFrameWriter.parquet

    def parquet(self, path, *args, **more):
        df = self._df
        seen.append((path, df._jdf.queryExecution().executedPlan().toString(), df.sparkSession.conf.get(LEFT)))
        write(self, path, *args, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    return seen


def test_requests_are_shuffled_once_and_no_shuffle_stays(spark, tmp_path, writes):
    table = R.request_table(spark, f"{tmp_path}/table", buckets=4)
    R.create_batch(table, str(tmp_path), RING)(request(spark, "a", "b", "a"), 0)
    publish(spark, str(tmp_path), 0)
    told = {path.removeprefix(f"{tmp_path}/").split("/part=")[0].split("/batch=")[0]: (text.count("Exchange "), left) for path, text, left in writes}
    assert told["table/rows"] == (1, "true")
    assert told["table/keys"][1] == told["published"][1] == "true"
    assert spark.conf.get(LEFT) == "false"


def test_other_tables_still_deal_their_rows_to_buckets(spark, tmp_path, writes):
    table = small_table(spark, tmp_path)
    table.append(pairs(spark, *((f"k{i}", i) for i in range(60))), "s", 0)
    assert any("REBALANCE" in text for path, text, _ in writes if "/rows/" in path)
    assert table.table().count() == 60


def test_ids_that_come_twice_in_many_tasks_are_stored_and_told_once(spark, tmp_path):
    home = str(tmp_path)
    table = R.request_table(spark, f"{home}/table", buckets=4)
    ids = spark.range(6000).select(F.concat(F.lit("k"), (F.col("id") % 4000).cast("string")).alias("id"), F.col("id").alias("n"))
    given = request(spark, "x").drop("id", "total_price").crossJoin(ids).withColumn("total_price", (1 + F.col("n")).cast("decimal(10,2)"))
    create = R.create_batch(table, home, RING)
    create(given.select(*R.COLUMNS).repartition(6), 0)
    stored = R.bookings(table, RING)
    assert rows(stored.agg(F.count("*"), F.countDistinct("id"), F.sum("total_price").cast("int"))) == [(4000, 4000, sum(range(1, 4001)))]
    create(given.select(*R.COLUMNS).unionByName(request(spark, "new")), 1)
    publish(spark, home, 0)
    publish(spark, home, 1)
    sent = published(spark, home)
    assert sent.count() == sent.select("seq").distinct().count() == 3 * 4001
    wanted = M.fan_out(R.bookings(table, RING)).select("topic", "key", "value")
    assert sent.select("topic", "key", "value").exceptAll(wanted).isEmpty()
    assert sent.where(F.col("topic") == V.TOPIC_BOOKINGS).select("key").distinct().count() == 4001


def test_so_many_folders_are_written_without_a_sort(spark):
    # Spark sorts what is left as soon as a task has as many writers as the setting says.
    with few_folders(spark, len(V.TOPICS)):
        assert int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")) > len(V.TOPICS)


def test_a_setting_is_put_back_after_a_failure(spark):
    with pytest.raises(RuntimeError):
        with no_shuffle_left(spark):
            assert spark.conf.get(LEFT) == "true"
            raise RuntimeError("stopped")
    assert spark.conf.get(LEFT) == "false"
