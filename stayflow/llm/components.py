"""Connected components of a graph of links, as joins that run until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayflow.session import work_dir


def smallest_reachable(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, label of all nodes that a link touches: the smallest start label that can be reached.

    nodes (node, label) has each node once; links (a, b) may come in any order and repeatedly. Each turn takes the
    smallest label among the neighbours and then the label that the holder of this label has, so a path of n links
    takes about log n turns. A hub's links are split by Spark's skew join, and minima are combined before the shuffle.
    """
    spark = links.sparkSession
    folder = work_dir(spark, "components")
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both.write.parquet(f"{folder}/links")
    both = spark.read.parquet(f"{folder}/links")
    touched = nodes.join(both.select(F.col("a").alias("node")).distinct(), "node").select("node", "label", F.col("label").alias("start"))
    touched.write.parquet(f"{folder}/0")
    turn = 0
    while True:
        now = spark.read.parquet(f"{folder}/{turn}")
        near = both.join(now.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        closer = now.join(near, "node").select("node", "start", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        holders = now.groupBy(F.col("start").alias("holder")).agg(F.min("label").alias("held"))
        jumped = closer.join(holders, closer.label == holders.holder, "left")
        turn += 1
        jumped.select("node", "start", F.least("label", F.coalesce("held", "label")).alias("label"), "was").write.parquet(f"{folder}/{turn}")
        if spark.read.parquet(f"{folder}/{turn}").where("label <> was").isEmpty():
            return spark.read.parquet(f"{folder}/{turn}").select("node", "label")
