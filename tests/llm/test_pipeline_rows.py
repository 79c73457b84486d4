"""What the stages of the corpus pipeline keep, on small fixtures."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from stayflow.llm import language, near_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)
KINDS = {"aa": ["th", "er", "on", "ing"], "bb": ["zü", "sch", "ei", "ung"], "cc": ["que", "ció", "ll", "ora"]}


def made(rng, parts, n):
    return " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(n))


def corpus():
    """Clean labelled rows of several lengths, and junk without a label: ids from 1000 are random letters, from 2000 no letters."""
    rng = random.Random(5)
    rows = [(i, made(rng, KINDS[lang], 1 + 60 * (i % 5)), lang, "s", 0) for i in range(300) for lang in [sorted(KINDS)[i % 3]]]
    rows += [(1000 + i, made(rng, list("abcdefghijklmnopqrstuvwxyz0123456789+/"), 150), None, "s", 0) for i in range(30)]
    return rows + [(2000, None, None, "s", 0), (2001, "", None, "s", 0), (2002, "12 !?", None, "s", 0)]


def kept(spark, rows):
    return {r.doc_id for r in STAGES["language"](spark, spark.createDataFrame(rows, DOCS), "").collect()}


def test_language_score_rejects_junk_and_keeps_clean_rows(spark):
    ids = kept(spark, corpus())
    assert ids >= set(range(300))
    assert len(ids & set(range(1000, 1030))) <= 3
    assert not ids & {2000, 2001, 2002}


def test_an_untrained_network_keeps_other_rows(spark, monkeypatch):
    rows = corpus()
    trained = kept(spark, rows)

    def untrained(samples, seed=7):
        net = language.Network.new(sorted({lang for _, lang in samples}), seed)
        net.name = "untrained"
        return net

    monkeypatch.setattr(language, "train", untrained)
    assert kept(spark, rows) != trained


def test_without_labels_all_texts_with_a_letter_stay(spark):
    rows = [(i, text, None, source, n) for i, text, _, source, n in corpus()] + [(2003, "é", None, "s", 0), (2004, "人 1", None, "s", 0)]
    assert kept(spark, rows) == set(range(300)) | set(range(1000, 1030)) | {2003, 2004}
    assert kept(spark, []) == set()


def test_thresholds_lie_between_chance_and_the_scores_of_right_rows(spark):
    rows = [(i, "x" * 9, "aa", "aa", 0.9) for i in range(150)] + [(200, "x" * 9, "aa", "aa", 0.3), (201, "x" * 9, "aa", "bb", 0.4)]
    rows += [(300, "x" * 300, "bb", "bb", 0.7), (301, "x" * 70, None, "bb", 0.6)]
    judged = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    net = language.Network.new(["aa", "bb"])
    found = language.thresholds(judged, net, "lang", "text", "lang_pred", "score")
    assert found == {3: pytest.approx(0.7, abs=1e-3), 8: pytest.approx(0.6, abs=1e-3)}
    left = judged.where(language.accepted(judged, net, "lang")).collect()
    assert {r.doc_id for r in left} == set(range(150)) | {300}


def groups(texts, length=5):
    """Brute force: for each text the first place among the texts that it is linked with, itself if none."""
    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[p:p + length]) for p in range(len(w) - length + 1)} or ({tuple(w)} if w else set())

    sets, of = [shingles(t) for t in texts], list(range(len(texts)))
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = max(of[a], of[b]), min(of[a], of[b])
                of = [new if x == old else x for x in of]
    return of


def test_one_row_of_each_group_whatever_the_ids(spark):
    rng = random.Random(8)
    base = [made(rng, list("abcdefgh"), 60) for _ in range(8)]
    near = [t + " one more" for t in base]
    rows = [(7, base[0]), (7, base[0]), (3, near[0]), (7, base[1]), (8, near[1]), (8, base[2]), (9, near[2]), (9, base[3])]
    rows += [(None, base[4]), (None, near[4]), (None, base[4]), (None, base[0]), (None, base[5]), (12, near[5])]
    rows += [(1, base[6]), (1, base[7]), (2, near[6]), (2, near[7]), (5, None), (5, None), (None, None), (6, ""), (6, " ")]
    rows = [(i, t, None, "s", n) for n, (i, t) in enumerate(rows)]
    out = near_dedup.drop_duplicates(spark.createDataFrame(rows, DOCS).repartition(3))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    left = out.collect()
    of = groups([r[1] for r in rows])
    assert sorted(of[r.n_chars] for r in left) == sorted(set(of))
    for r in left:
        assert (r.doc_id, r.text) == rows[r.n_chars][:2]
        ids = [rows[n][0] for n in range(len(rows)) if of[n] == of[r.n_chars]]
        assert r.doc_id == min((i for i in ids if i is not None), default=None)
