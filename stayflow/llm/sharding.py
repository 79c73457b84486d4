"""Shuffled sharding: a Feistel permutation over global row numbers tells the shard and the slot of every row.

Rows get numbers 0 to n - 1: they are dealt into a fixed number of hash buckets, counted per bucket, and numbered
within their bucket; a bucket starts where the counts before it end. No task orders more than one bucket, and what
is broadcast is one row per bucket. The permutation is a Feistel network on pairs below (a, b), where a * b is the
smallest product found that is not below n. A number that lands at n or above is permuted again (cycle walking):
as there are only a * b - n such numbers, that many steps always suffice. Shard is the permuted number modulo the
number of shards and slot the quotient, so shard sizes differ by one row at most and slots have no gaps.

All rows are kept: null ids, null or empty texts and repeated rows are numbered like any others (rows that are equal
in all of `order` in any order among themselves). An empty table gives an empty result. Columns of the input that are
called like the result columns are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayflow.llm.texts import digest60, fresh

BUCKETS = 4096
ROUNDS = 8
SEARCH = 1000


def domain(n: int) -> tuple[int, int]:
    """Sides a, b with the smallest a * b >= n among SEARCH values of a from the square root on."""
    root = math.isqrt(n - 1) + 1 if n > 1 else 1
    return min(((-n % a, a, -(-n // a)) for a in range(root, root + SEARCH)))[1:]


def div(x: Column, y: int) -> Column:
    """Whole quotient of two long values, without a detour over doubles."""
    return F.call_function("div", x, F.lit(y))


def number_rows(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add the column `name`: 0 to n - 1, by bucket of the first column in `order`, then by `order`."""
    bucket, before, place = fresh(rows, "bucket", "before", "place")
    rows = rows.withColumn(bucket, F.pmod(digest60(F.col(order[0])), F.lit(BUCKETS)))
    counts = rows.groupBy(bucket).agg(F.count("*").alias(before))
    earlier = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)  # BUCKETS rows at most
    starts = counts.select(F.col(bucket), F.coalesce(F.sum(before).over(earlier), F.lit(0)).alias(before))
    placed = rows.withColumn(place, F.row_number().over(Window.partitionBy(bucket).orderBy(*order)))
    numbered = placed.join(F.broadcast(starts), bucket)
    return numbered.withColumn(name, F.col(before) + F.col(place) - 1).drop(bucket, before, place)


def permute(number: Column, n: int, key: str) -> Column:
    """The Feistel permutation of 0 to n - 1 that belongs to `key`."""
    a, b = domain(n)

    def once(x: Column) -> Column:
        def turn(s: Column, k: Column) -> Column:
            left = F.when(k % 2 == 0, F.pmod(s["l"] + digest60(F.lit(key), k, s["r"]), F.lit(a))).otherwise(s["l"])
            right = F.when(k % 2 == 1, F.pmod(s["r"] + digest60(F.lit(key), k, s["l"]), F.lit(b))).otherwise(s["r"])
            return F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

        start = F.struct(div(x, b).alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))
        turns = F.array(*(F.lit(i) for i in range(ROUNDS)))
        return F.aggregate(turns, start, turn, lambda s: s["l"] * F.lit(b) + s["r"])

    moved = once(number)
    if a * b == n:
        return moved
    steps = F.sequence(F.lit(1), F.lit(a * b - n))
    walk = lambda x: F.when(x < n, x).otherwise(
        F.aggregate(steps, x, lambda y, _: F.when(y < n, y).otherwise(once(y))))
    return F.element_at(F.transform(F.array(moved), walk), 1)


def shard(rows: DataFrame, shards: int, order: list[str], key: str = "shuffle",
          shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """`rows` with shard (int) and slot (long). The same rows, `order` and `key` give the same result."""
    rows = rows.drop(shard_col, slot_col)
    (number,) = fresh(rows, "number")
    n = max(1, rows.count())
    moved = number_rows(rows, order, number).withColumn(number, permute(F.col(number), n, key))
    return moved.withColumns({
        shard_col: F.pmod(F.col(number), F.lit(shards)).cast("int"),
        slot_col: div(F.col(number), shards),
    }).drop(number)
