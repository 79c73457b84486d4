"""Faults found in the first round."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayflow.functions import privacy as P
from stayflow.operators import kpis
from stayflow.sources import text

OLD, RING = P.KeyRing({1: b"k" * 32}), P.KeyRing({1: b"k" * 32, 2: b"q" * 32})


def test_offsets_in_exponent_form_and_near_labels(spark):
    name = "kafka_topic_partition_current_offset"
    lines = spark.createDataFrame([(x,) for x in (
        f'{name}{{partition="0",topic="a"}} 1.234567e+06', f'{name}{{subtopic="u",topic="b"}} 42', f'{name}{{subtopic="u"}} 7',
        f'{name}{{topic="c"}} NaN', f'{name}{{topic="d"}} 12 1700000000', 'other{topic="a"} 1')], "value string")
    assert sorted(map(tuple, text.parse_offsets(lines).collect())) == [("a", 1234567), ("b", 42), ("d", 12)]


def test_rotation_leaves_unreadable_values_alone(spark):
    foreign = P.KeyRing({1: b"x" * 32})
    rows = spark.createDataFrame([("plain",)], "v string").select(
        F.col("v").alias("plain"), P.encrypt(F.col("v"), OLD).alias("old"), P.encrypt(F.col("v"), foreign).alias("foreign"),
        P.encrypt(F.col("v"), RING).alias("new"), F.lit("vault:v1:damaged").alias("damaged"), F.lit(None).cast("string").alias("none"))
    names = rows.columns
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    out = rows.select(*names, *(P.rewrap(F.col(n), RING).alias(f"{n}_to") for n in names),
                      *(P.unreadable(F.col(n), RING).alias(f"{n}_bad") for n in names)).first()
    assert out.foreign_to == out.foreign and out.damaged_to == out.damaged and out.new_to == out.new and out.none_to is None
    assert [n for n in names if out[f"{n}_bad"]] == ["foreign", "damaged"]
    opened = spark.createDataFrame([(out.plain_to, out.old_to)], "a string, b string").select(*(P.decrypt(F.col(c), RING) for c in "ab"))
    assert tuple(opened.first()) == ("plain", "plain")
    assert out.plain_to.startswith("vault:v2:") and out.old_to.startswith("vault:v2:")


def test_null_keys_are_not_subtotals(spark):
    rows = spark.createDataFrame([(None, "2024-01-02", "x", 2, 10), (1, "2024-01-02", None, 1, 5)],
                                 "property_id int, check_in string, status string, nights int, total_price int")
    rows = rows.withColumns({"check_in": F.to_date("check_in"), "total_price": F.col("total_price").cast("decimal(10,2)")})
    got = {(r.property_id, r.month, r.status): r.bookings for r in kpis.property_report(rows).collect()}
    assert got[-1, "all", "all"] == 2 and got[None, "all", "all"] == 1 and got[1, "2024-01", None] == 1
    assert len(got) == 7
