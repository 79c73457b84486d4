from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stayflow.operators import joins


@pytest.fixture(scope="module")
def facts(spark):
    rng = random.Random(1)
    keys = [7] * 400 + [None] * 50 + [rng.randrange(40) for _ in range(300)]
    rows = [(k, i % 3, i // 10) for i, k in enumerate(keys)]  # with equal copies
    return spark.createDataFrame(rows, "k int, a int, b int").repartition(6)


@pytest.fixture(scope="module")
def lookup(spark):
    return spark.createDataFrame([(k, f"name{k}") for k in range(0, 60, 2)] + [(7, "hot")], "k int, name string")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot_rows", [20, 1000])
def test_salted_join_gives_the_same_rows(facts, lookup, how, hot_rows):
    def listed(df):
        return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)

    plain = facts.join(lookup, ["k"], how)
    assert listed(joins.salted_join(facts, lookup, ["k"], how, hot_rows)) == listed(plain)


def test_hot_key_is_spread(spark, facts, lookup):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = joins.salted_join(facts, lookup, ["k"], "inner", hot_rows=20)
        parts = joined.filter("k = 7").select(F.spark_partition_id().alias("p")).distinct().count()
        assert parts > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_size_decides(spark, facts, lookup):
    small = spark.range(50).select(F.col("id").cast("int").alias("k"))
    assert joins.fits_broadcast(small)
    assert not joins.fits_broadcast(lookup)  # rows from the driver have no size estimate
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 10)
    try:
        assert not joins.fits_broadcast(small)
        assert joins.lookup_join(facts, small, ["k"]).count() == facts.filter("k < 50").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
