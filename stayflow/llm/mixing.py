"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, the target of its source over the words of its
source. Prefix sums of expected copies, plus one random offset per source, cross whole numbers; a document is emitted
once for every whole number that its step crosses. Documents are taken in order of size class, then hash, then size,
so the words taken come as near to the target as the copies do.

The prefix sum is made of counts: documents are counted per cell (source, size class, hash bucket), cells are summed
per source (at most some 700 classes x BUCKETS rows each), and a document is numbered within its cell only. A source,
or a size, that holds a third of all rows is spread over hundreds of cells.

Null sources are a source of their own, the last. Null or empty texts have size 0 and are taken like others. A source
without words has target 0 and none of its documents is taken. Repeated rows are separate documents; rows equal in
source, size, id and tie-breaker are taken in any order among themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayflow.llm.texts import digest60, fresh

BUCKETS = 256
WEIGHTS = (3, 1, 2)


def size_class(size: Column) -> Column:
    """Sizes below 64 are classes of their own; above, the five bits after the first one count."""
    bits = F.length(F.bin(size))
    shift = F.greatest(bits - 6, F.lit(0))
    return F.when(size < 64, size).otherwise(shift * 32 + F.call_function("shiftright", size, shift)).cast("int")


def targets(sources: DataFrame, share: float, most: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources (source, missing, words) with rate (expected copies) and target.

    Each source is filled in proportion to its weight up to `most` times its words. With the sources ordered by
    cap over weight, the level of the uncapped ones is the largest of (rest of the total) / (rest of the weights).
    One row per source; they are ordered in one task.
    """
    by_name = Window.orderBy("missing", "source")
    pick = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    ranked = sources.withColumn("weight", pick).withColumn("cap", F.col("words") * F.lit(float(most)))
    every = Window.partitionBy()
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), "missing", "source")
    total = F.sum("words").over(every) * F.lit(float(share))
    before = F.coalesce(F.sum("cap").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    leveled = ranked.withColumn("level", (total - before) / rest)
    target = F.least("cap", F.max("level").over(every) * F.col("weight"))
    return leveled.select("source", "missing", "words", target.alias("target")).withColumn(
        "rate", F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(0.0))


def plan_copies(rows: DataFrame, size: Column, source_col: str, order: list[str], share: float = 1.5, most: float = 2.0,
                weights: tuple[int, ...] = WEIGHTS, seed: str = "mix") -> tuple[DataFrame, dict[str, str]]:
    """`rows` with copies, size, source_size and target, and the names these columns got."""
    src, miss, cls, buc, siz, place, copies, words, target, told = fresh(
        rows, "source_key", "source_missing", "size_class", "bucket", "size", "place", "copies", "source_size", "target", "cell")
    keyed = rows.withColumn(siz, size).withColumns({
        src: F.coalesce(F.col(source_col), F.lit("")), miss: F.col(source_col).isNull(),
        cls: size_class(F.col(siz)), buc: F.pmod(digest60(F.col(order[0])), F.lit(BUCKETS)).cast("int"),
    })
    cell = [src, miss, cls, buc]
    cells = keyed.groupBy(*(F.col(c).alias(n) for c, n in zip(cell, ("source", "missing", "class", "part")))).agg(
        F.count("*").alias("n"), F.sum(siz).alias("words"))
    goals = targets(cells.groupBy("source", "missing").agg(F.sum("words").alias("words")), share, most, weights)
    ahead = Window.partitionBy("source", "missing").orderBy("class", "part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("source", "missing", "class", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    cells = cells.join(goals, ["source", "missing"])
    placed = keyed.withColumn(place, F.row_number().over(Window.partitionBy(*cell).orderBy(siz, *order)))
    cells = cells.select(F.struct("*").alias(told))
    joined = placed.join(cells, [F.col(c) == F.col(f"{told}.{n}") for c, n in zip(cell, ("source", "missing", "class", "part"))])
    start = (digest60(F.lit(seed), F.col(miss), F.col(src)) % 1024 + 0.5) / 1024
    rate = F.col(f"{told}.rate")
    crossed = lambda at: F.floor(start + at * rate)
    last = F.col(f"{told}.ahead") + F.col(place)
    taken = F.least(crossed(last) - crossed(last - 1), F.ceil(rate)).cast("long")
    out = joined.select(*(f"`{c}`" for c in rows.columns), F.col(siz), taken.alias(copies),
                        F.col(f"{told}.words").alias(words), F.col(f"{told}.target").alias(target))
    return out, {"size": siz, "copies": copies, "source_size": words, "target": target}


def emit(planned: DataFrame, copies: str) -> DataFrame:
    """One row for every copy taken."""
    (copy,) = fresh(planned, "copy")
    taken = planned.where(F.col(copies) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).drop(copy)
