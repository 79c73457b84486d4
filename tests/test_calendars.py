from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stayflow.operators import calendars
from tests.conftest import rows


def stays(spark, data):
    return spark.createDataFrame(data, "property_id int, a string, b string").select(
        "property_id", F.to_date("a").alias("check_in"), F.to_date("b").alias("check_out")
    )


def test_bounds(spark):
    one = stays(spark, [(1, "2024-01-02", "2024-01-04")])
    days = [str(r.day) for r in calendars.occupied_days(one, []).collect()]
    assert sorted(days) == ["2024-01-02", "2024-01-03", "2024-01-04"]
    nights = [str(r.day) for r in calendars.occupied_days(one, [], inclusive_checkout=False).collect()]
    assert sorted(nights) == ["2024-01-02", "2024-01-03"]


@pytest.mark.parametrize("inclusive", [True, False])
def test_against_brute_force(spark, inclusive):
    rng = random.Random(3)
    base = dt.date(2024, 1, 1)
    data = []
    for _ in range(200):
        a = base + dt.timedelta(days=rng.randrange(60))
        data.append((rng.randrange(4), str(a), str(a + dt.timedelta(days=rng.randrange(-1, 9)))))
    expected = Counter()
    for p, a, b in data:
        day, end = dt.date.fromisoformat(a), dt.date.fromisoformat(b)
        while day < end or (inclusive and day == end):
            expected[p, day] += 1
            day += dt.timedelta(days=1)
    got = {(r.property_id, r.day): r.booked for r in calendars.occupied_days(stays(spark, data), ["property_id"], inclusive).collect()}
    assert got == dict(expected)


def test_status_order_and_weekdays(spark):
    months = spark.createDataFrame([("2024-02-15",)], "d string").select(F.to_date("d").alias("month"))
    days = calendars.date_dimension(months, F.lit("2024-02-10").cast("date"))
    taken = calendars.occupied_days(stays(spark, [(1, "2024-02-09", "2024-02-11")]), [])
    shown = {str(r.day): r for r in calendars.availability(days, taken, [], ["2024-02-11", "2024-02-20"]).collect()}
    assert len(shown) == 29 and shown["2024-02-01"].weekday == 3 and shown["2024-02-01"].first_offset == 3
    assert [shown[f"2024-02-{d}"].status for d in ("09", "10", "11", "12", "20")] == ["past", "booked", "booked", "free", "selected"]


def test_occupancy_counts_overlaps_once_and_clips(spark):
    data = [(1, "2023-12-30", "2024-01-03"), (1, "2024-01-02", "2024-01-05"), (2, "2023-01-01", "2023-01-05")]
    out = calendars.occupancy(stays(spark, data), "property_id", "2024-01-01", "2024-01-10")
    assert rows(out, "property_id") == [(1, 4, 0.4), (2, 0, 0.0)]
