"""The registered text queries without SQL, and the pipeline as it is run, against plain versions on the smallest tables."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from stayflow.llm import decontaminate, queries
from tests.compare import connect
from tests.llm.test_pipeline_rows import groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return connect(SF).execute("SELECT doc_id, text, lang, source FROM documents ORDER BY doc_id").fetchall()


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_token_output(spark, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = sorted(map(tuple, queries.QUERIES["op9_token_output"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    expected, start = [], 0
    for doc_id, text, *_ in documents:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        expected.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert out == expected


def test_language_id(spark, documents):
    out = {r.doc_id: r for r in queries.QUERIES["op5_language_id"](spark, SF).collect()}
    assert set(out) == {d[0] for d in documents}
    right = 0
    for doc_id, text, lang, _ in documents:
        r = out[doc_id]
        assert r.held_out is (fold(doc_id, 3) == 1) and 0 <= r.score <= 1
        if not any(map(str.isalpha, text or "")):
            assert r.lang_pred == "und"
        right += r.lang_pred == lang
    assert right >= 0.97 * len(documents)


def test_quality_classifier(spark, documents):
    out = {r.doc_id: r for r in queries.QUERIES["op10_quality_classifier"](spark, SF).collect()}
    assert set(out) == {d[0] for d in documents}
    labels = connect(SF).execute("SELECT doc_id, quality FROM labels").fetchall()
    assert all(r.held_out is (fold(i, 4) == 2) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for i, r in out.items())
    held = [(out[i].predicted, q) for i, q in labels if i in out and out[i].held_out]
    assert np.mean([p == q for p, q in held]) > 0.9


def test_decontamination_finds_whole_passages(spark, documents):
    out = queries.QUERIES["op4_decontaminate"](spark, SF).collect()
    items = connect(SF).execute("SELECT item_id, text FROM benchmark").fetchall()
    found = {(r.doc_id, r.item_id) for r in out}
    for doc_id, text, *_ in documents:
        plain = decontaminate.normalize(text)
        for item_id, item in items:
            if item and decontaminate.normalize(item) in plain:
                assert (doc_id, item_id) in found


def test_the_pipeline_as_it_is_run(spark, documents):
    rows = corpus_pipeline.run(spark, SF).collect()
    texts = {d[0]: d for d in documents}
    copies = Counter(r.doc_id for r in rows)
    assert set(copies) <= set(texts) and max(copies.values()) <= 2
    # Language: what goes has no letter or is odd; nearly all labelled rows are clean.
    # Near-duplicates: of each group of linked texts at most one document is left, and a group is never lost to this stage.
    ids = sorted(texts)
    of = groups([texts[i][1] for i in ids])
    left = defaultdict(set)
    for i in copies:
        left[of[ids.index(i)]].add(i)
    assert all(len(v) == 1 for g, v in left.items() if (texts[ids[g]][1] or "").split())
    items = [decontaminate.normalize(t) for (t,) in connect(SF).execute("SELECT text FROM benchmark").fetchall()]
    assert not any(item and item in decontaminate.normalize(texts[i][1]) for i in copies for item in items)
    # Documents that no stage has a reason to drop are taken, as far as the mix takes their source.
    # Shards: sizes at most one apart, slots without gaps, all columns of documents.
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots[s]) for s in range(corpus_pipeline.SHARDS)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    assert {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"} == set(rows[0].asDict())
    assert all(r.text == texts[r.doc_id][1] and r.lang == texts[r.doc_id][2] for r in rows)


def test_each_stage_keeps_clean_documents(spark, documents):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    named = {r.doc_id for r in stages["language"](spark, docs, SF).collect()}
    lettered = {d[0] for d in documents if any(map(str.isalpha, d[1] or ""))}
    assert named <= lettered and len(lettered - named) <= 0.02 * len(lettered)
    items = [decontaminate.normalize(t) for (t,) in connect(SF).execute("SELECT text FROM benchmark").fetchall()]
    clean = {r.doc_id for r in stages["decontaminate"](spark, docs, SF).collect()}
    grams = {g for item in items for w in [item.split()] for g in zip(*(w[k:] for k in range(6)))}
    for doc_id, text, *_ in documents:
        words = decontaminate.normalize(text).split()
        if not any(g in grams for g in zip(*(words[k:] for k in range(6)))):
            assert doc_id in clean  # shares no six words in a row with any passage
