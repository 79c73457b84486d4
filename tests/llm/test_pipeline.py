"""The stages of the corpus pipeline, each on its own input, and the registration."""

from __future__ import annotations

from collections import Counter

import __spark_entry__ as contract
import corpus_pipeline
from stayflow.llm import decontaminate, near_dedup

SF = "/root/testdata/sf0.001"


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontaminate", "mix", "shard"]
    named = stages["language"](spark, docs, SF)
    assert named.columns == docs.columns and named.count() <= docs.count()
    single = stages["near_dedup"](spark, named, SF)
    assert all(r.kept for r in near_dedup.components(single).collect())
    clean = stages["decontaminate"](spark, single, SF)
    assert decontaminate.find(clean, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    mixed = stages["mix"](spark, clean, SF)
    assert mixed.columns == docs.columns and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 2


def test_all_text_queries_are_registered():
    names = [n for n in contract.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in contract.queries()
