"""Corpus pipeline: documents to shuffled, mixed, clean shards.

Each stage gets what the one before kept and returns the columns of documents; the last adds the shard and the slot.
Rows that repeat a doc_id (the mix emits some documents twice) are sharded each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayflow.llm import decontaminate, language, mixing, near_dedup, sharding
from stayflow.llm.texts import fresh, id_remainder, word_count
from stayflow.session import work_dir
from stayflow.sources.tables import table

SHARDS = 24

#: SQL can express neither the trained network of the first stage nor its verdicts.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found with a score that reaches the threshold of `language.accepted`.

    The network learns from rows outside the held-out third; the threshold is set by all labelled rows. If no row
    outside that third has id, text and label, there is no network: all texts with a letter stay.
    """
    learn = F.coalesce(id_remainder(F.col("doc_id"), 3) != 1, F.lit(False))
    verdict, score = fresh(docs, "predicted_language", "predicted_score")
    net = language.fit(docs, learn)
    if net is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    folder = work_dir(spark, "language")
    language.predict(docs, net, lang_col=verdict, score_col=score).write.parquet(folder)
    judged = spark.read.parquet(folder)
    return judged.where(language.accepted(judged, net, "lang", "text", verdict, score)).select(docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return near_dedup.drop_duplicates(docs, as_read=True)


def remove_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, up to one edit in ten characters."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: 150 % of all words, sources by weight, none beyond twice its words."""
    planned, name = mixing.plan_copies(docs, word_count(F.col("text")), "source", ["doc_id"])
    return mixing.emit(planned, name["copies"]).select(docs.columns)


def shuffle_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns of documents with shard and slot."""
    return sharding.shard(docs, SHARDS, ["doc_id", "text"])


STAGES = [
    ("language", identify_language),
    ("near_dedup", remove_near_duplicates),
    ("decontaminate", remove_benchmark_leaks),
    ("mix", mix_sources),
    ("shard", shuffle_into_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each result written to the shared folder and read again."""
    folder = work_dir(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
