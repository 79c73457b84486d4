"""No side of op11's joins is broadcast, however small Spark takes it to be."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayflow.llm import spelling


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_what_grows_with_the_words_is_never_broadcast(spark, tmp_path):
    # 20,000 words are 160,000 rows when filed; Spark sizes them like the words, far below its threshold.
    number = F.lpad(F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), 6, "k")
    spark.range(20_000).select(number.alias("word"), F.lit(3).cast("long").alias("n")).write.parquet(f"{tmp_path}/words")
    words = spark.read.parquet(f"{tmp_path}/words")
    near = spelling.near_words(words)
    assert "Broadcast" not in plan(near)
    docs = words.select(F.col("n").alias("doc_id"), F.concat_ws(" ", "word", "word", "word").alias("text"))
    grouped = spelling.group_variants(docs)
    assert "Broadcast" not in plan(grouped)
    assert grouped.count() == 20_000
    found = {r.word: r.n_near for r in grouped.where("word in ('kkkkka', 'kkkkbc', 'kbjjjj')").collect()}
    assert found == {"kkkkka": 18, "kkkkbc": 27, "kbjjjj": 37}
