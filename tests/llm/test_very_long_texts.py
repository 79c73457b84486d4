"""Hundreds of kilobytes in one line, in one word, and in very many lines, among short, null and empty texts, through each operator."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from stayflow.llm import (decontaminate, language, line_crf, mixing, near_dedup, pii, prefix_trie, quality_rules, sharding, spelling,
                          substring, url_filter, wavelet)
from stayflow.llm.texts import word_count

LONG = 200_000
TEXTS = [None, "", "a short text", "x" * LONG, "some words here " * (LONG // 16), "ab\n" * (LONG // 3), "some words here " * (LONG // 16)]
WORDS, LINES = 3 * (LONG // 16), LONG // 3


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("source", F.lit("s")).withColumn("lang", F.lit("aa")).repartition(2)


def by_id(df):
    rows = {r.doc_id: r for r in df.collect()}
    assert sorted(rows) == list(range(len(TEXTS)))
    return rows


def test_substring(docs):
    out = by_id(substring.remove_repeats(docs))
    assert [out[i].n_words for i in range(7)] == [0, 0, 3, 1, WORDS, LINES, WORDS]
    assert [out[i].n_removed for i in range(7)] == [0, 0, 0, 0, 0, 0, WORDS]


def test_shards_and_mix(docs):
    out = by_id(sharding.shard(docs, 3, ["doc_id"]))
    assert sorted((r.shard, r.slot) for r in out.values()) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 0), (2, 1)]
    planned, name = mixing.plan_copies(docs, word_count(F.col("text")), "source", ["doc_id"])
    assert {r.doc_id: r[name["size"]] for r in planned.collect()} == {0: 0, 1: 0, 2: 3, 3: 1, 4: WORDS, 5: LINES, 6: WORDS}


def test_near_duplicates_and_leaks(spark, docs):
    out = by_id(near_dedup.components(docs))
    assert [out[i].component_id for i in range(7)] == [0, 1, 2, 3, 4, 5, 4]
    items = spark.createDataFrame([(1, "words here some words here some words"), (3, "not in any of these texts at all")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find(docs, items).collect()}
    assert found == {(4, 1), (6, 1)}


def test_classifiers(docs):
    net = language.train([("some words here and there", "aa"), ("zü sch ei ung der die", "bb")] * 20)
    out = by_id(language.predict(docs.drop("lang"), net))
    assert [out[i].lang_pred for i in (0, 1)] == ["und", "und"] and out[4].lang_pred == out[6].lang_pred == "aa" and out[3].lang_pred != "und"
    field = line_crf.train([("a good line of words", 1), ("## $$", 0)] * 30)
    scores = by_id(line_crf.score(docs, field))
    assert all(0 <= r.score <= 1 for r in scores.values()) and scores[4].score == scores[6].score


def test_quality_measures(docs):
    out = by_id(quality_rules.measure(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))))
    assert [(out[i].n_words, out[i].word_chars, out[i].n_dup_lines, out[i].n_repeat_words) for i in (1, 2, 3, 4, 5)] == [
        (0, 0, 0, 0), (3, 10, 0, 0), (1, LONG, 0, 0), (WORDS, 13 * (LONG // 16), 0, WORDS), (LINES, 2 * LINES, LINES - 1, LINES)]


def test_urls(spark):
    rules = [url_filter.UrlRule("allow", "org/"), url_filter.UrlRule("block", "com/")]
    urls = [None, "", "http://a.org/x", "http://b.com/y", "http://c.net/" + "z" * 4000]
    out = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert [out[i].verdict for i in (2, 3)] == ["allow", "block"] and len(out[4].path) == 4001


def test_tokens(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    wavelet.write_shards(docs, f"{tmp_path}/t", path, end_id=1, by_word=True)
    out = by_id(wavelet.read_summaries(spark, f"{tmp_path}/t"))
    tokenizer = Tokenizer.from_file(path)
    for i in (0, 2, 4, 5):
        ids = np.array([*tokenizer.encode(TEXTS[i] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (out[i].n_tokens, out[i].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


def test_words_spans_and_turns(spark, docs):
    out = {r.word: r.n for r in spelling.group_variants(docs).select("word", "n").collect()}
    assert out == {"words": 2 * WORDS // 3}
    spans = by_id(pii.find_personal(docs))
    assert all(r.spans == "" and r.n_email == 0 for r in spans.values())
    turns = spark.createDataFrame([(1, 0, "user", TEXTS[3]), (2, 0, "user", TEXTS[3]), (2, 1, "bot", None)], "conv_id long, turn long, role string, text string")
    nodes = sorted(map(tuple, prefix_trie.build(turns).collect()), key=lambda r: r[1])
    ends = [hashlib.sha256(t).hexdigest() for t in (b"", b"1", b"2")]
    assert nodes == [(1, 0, None, 2, 1, 1, LONG, ends[0]), (1, 1, 1, 2, 1, 1, LONG, ends[1]), (2, 2, 1, 1, 0, 1, 0, ends[2])]
