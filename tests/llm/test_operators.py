"""Small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from stayflow.llm import (decontaminate, language, line_crf, mixing, near_dedup, quality_rules, sharding, substring,
                          url_filter, wavelet)
from stayflow.llm.texts import word_count

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, bucket int, label string, spans int"


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = words(1, 300)
    texts = [None, "", "  \n ", base, base, base + " tail", words(2, 120) + " " + " ".join(base.split()[50:130]), "x",
             "x", words(3, 20_000), "short text"]
    rows = [(i, t, "en" if i % 2 else None, [None, "a", "b"][i % 3], 0, "k", 1, "l", 2) for i, t in enumerate(texts)]
    rows += [(None, base, None, None, None, None, None, None, None), rows[3]]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, str(r)))


def brute_substring(rows, window=50):
    starts = {}
    cut = [(i, (t or "").split()) for i, t in rows]
    for i, w in cut:
        for p in range(len(w) - window + 1):
            starts.setdefault(tuple(w[p:p + window]), set()).add(i)
    out = []
    for i, w in cut:
        gone = set()
        for p in range(len(w) - window + 1 if i is not None else 0):
            if any(x is not None and x < i for x in starts[tuple(w[p:p + window])]):
                gone |= set(range(p, p + window))
        out.append((i, " ".join(x for p, x in enumerate(w) if p not in gone), len(w), len(gone)))
    return sorted(out, key=lambda r: (r[0] is None, str(r)))


def test_substring_matches_brute_force(docs):
    expected = brute_substring([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert by_id(substring.remove_repeats(docs)) == expected
    assert substring.remove_repeats(docs.limit(0)).count() == 0


def test_difference_covers():
    for period, cover in substring.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_shards_have_no_gaps_and_keep_all_rows(docs):
    dealt = sharding.shard(docs, 4, ["doc_id", "text"]).collect()
    assert len(dealt) == docs.count()
    for shard in range(4):
        slots = sorted(r.slot for r in dealt if r.shard == shard)
        assert slots == list(range(len(slots))) and len(slots) in (len(dealt) // 4, len(dealt) // 4 + 1)
    assert sharding.shard(docs.limit(0), 4, ["doc_id", "text"]).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 997])
def test_feistel_is_a_permutation(spark, n):
    moved = spark.range(n).select(sharding.permute(F.col("id"), n, "k").alias("x"))
    assert sorted(r.x for r in moved.collect()) == list(range(n))
    a, b = sharding.domain(n)
    assert a * b >= n


def test_mix_reaches_targets_and_keeps_columns(docs, spark):
    planned, name = mixing.plan_copies(docs, word_count(F.col("text")), "source", ["doc_id", "text"])
    rows = planned.collect()
    assert len(rows) == docs.count() and all(0 <= r[name["copies"]] <= 2 for r in rows)
    total = sum(r[name["size"]] for r in rows)
    targets = {r.source: r[name["target"]] for r in rows}
    assert sum(targets.values()) == pytest.approx(1.5 * total)
    for source, target in targets.items():
        own = [r for r in rows if r.source == source]
        assert abs(sum(r[name["copies"]] * r[name["size"]] for r in own) - target) <= max(r[name["size"]] for r in own)
    assert mixing.emit(planned, name["copies"]).count() == sum(r[name["copies"]] for r in rows)
    empty, name = mixing.plan_copies(docs.limit(0), word_count(F.col("text")), "source", ["doc_id"])
    assert mixing.emit(empty, name["copies"]).count() == 0


def brute_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_decontamination_matches_full_alignment():
    rng = random.Random(5)
    items = [(i, words(100 + i, n)) for i, n in enumerate((1, 2, 4, 15, 30))] + [(9, None), (10, "")]
    texts = []
    for n in range(40):
        i, text = items[rng.randrange(5)]
        chars = list(text)
        for _ in range(rng.randrange(0, max(1, len(chars) // 6))):
            p = rng.randrange(len(chars))
            chars[p:p + 1] = rng.choice([["z"], [], [chars[p], "q"]])
        texts.append(decontaminate.normalize(words(500 + n, 30) + " " + "".join(chars) + " " + words(900 + n, 20)))
    texts += ["", decontaminate.normalize(words(77, 2000))]
    index = decontaminate.Index(items, 0.1)
    got = {(t, i): e for t, i, e, _, _ in index.search(texts)}
    expected = {}
    for t, text in enumerate(texts):
        for i, (_, item) in enumerate(items[:5]):
            edits = brute_distance(decontaminate.normalize(item), text) if len(text) < 2000 else 99
            if edits <= index.edits[i]:
                expected[t, i] = edits
    assert got == expected


def test_decontamination_drops_only_leaks(spark, docs):
    leak = words(1, 300)[30:200].upper()
    bench = spark.createDataFrame([(1, leak), (1, leak), (2, None), (3, "")], "item_id long, text string")
    found = {r.doc_id for r in decontaminate.find(docs, bench).collect()}
    assert found == {3, 4, 5, None}
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [0, 1, 2, 6, 7, 8, 9, 10]
    assert decontaminate.find(docs, bench.limit(0)).count() == 0


def test_language_network_and_und(spark, docs):
    rng = random.Random(2)
    make = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(60))
    kinds = {"aa": ["th", "er", "on"], "bb": ["zü", "sch", "ei"]}
    rows = [(i, make(kinds[lang]), lang) for i in range(200) for lang in [["aa", "bb"][i % 2]]]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language.fit(table, F.col("doc_id") < 100)
    odd = spark.createDataFrame([(900, None, None), (901, "", None), (902, "12 !?", None), (903, "é", None)], table.schema)
    out = {r.doc_id: r for r in language.predict(table.union(odd), net).collect()}
    assert sum(out[i].lang_pred == lang for i, _, lang in rows[100:]) >= 99
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (900, 901, 902))
    assert out[903].lang_pred in ("aa", "bb") and all(0 <= r.score <= 1 for r in out.values())
    assert language.fit(docs.limit(0), F.lit(True)) is None
    assert {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}


def test_gradients_agree_with_differences():
    net = language.Network.new(["a", "b"])
    data = np.frombuffer(b"hello wide", np.uint8)
    begin, size, label = np.array([0, 6]), np.array([5, 4]), np.array([0, 1])
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    grads = net.step(data, begin, size, label)

    def loss():
        total = 0.0
        for k in (0, 1):
            one = net.weights
            f = net.states(language._bytes_of(data, begin[k:k + 1], size[k:k + 1], False), size[k:k + 1], "f")
            b = net.states(language._bytes_of(data, begin[k:k + 1], size[k:k + 1], True), size[k:k + 1], "b")
            for t in range(size[k]):
                logits = f[t, 0] @ one["of"] + b[size[k] - 1 - t, 0] @ one["ob"] + one["bias"]
                total -= logits[label[k]] - np.log(np.exp(logits).sum())
        return total / size.sum()

    for name in ("uf", "ub", "of", "bias"):
        at = (1,) * net.weights[name].ndim
        net.weights[name][at] += 1e-3
        up = loss()
        net.weights[name][at] -= 2e-3
        down = loss()
        net.weights[name][at] += 1e-3
        assert grads[name][at] == pytest.approx((up - down) / 2e-3, abs=2e-3)


def test_quality_cascade_order_does_not_change_the_verdict(docs):
    text = F.coalesce("text", F.lit(""))
    rules = quality_rules.default_rules(F.col("t"))
    rows = docs.select("doc_id", text.alias("t"))
    ordered = quality_rules.order_rules(rows, rules, F.col("doc_id"), "t")
    assert {r.name for r in ordered} == {r.name for r in rules}
    one = by_id(rows.select("doc_id", quality_rules.first_rejection(rules).isNull()))
    assert by_id(rows.select("doc_id", quality_rules.first_rejection(rules[::-1]).isNull())) == one
    assert quality_rules.measure(docs.limit(0).select(text.alias("text"))).count() == 0


def test_near_dedup_matches_brute_force(spark, docs):
    rng = random.Random(8)
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    for i in range(60):
        w = words(40 + i % 6, 60).split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = "new"
        rows.append((100 + i, " ".join(w)))
    table = spark.createDataFrame(rows + [(None, "x")], "doc_id long, text string")
    sets = []
    for i, t in rows:
        w = (t or "").split()
        sets.append({tuple(w[p:p + 5]) for p in range(max(1, len(w) - 4))} if w else set())
    label = {n: n for n in range(len(rows))}
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    low = min(label[a], label[b], key=lambda n: rows[n][0])
                    if label[a] != low or label[b] != low:
                        label[a] = label[b] = low
                        changed = True
    expected = sorted((rows[n][0], len(sets[n]), rows[label[n]][0]) for n in range(len(rows)))
    got = near_dedup.components(table).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == expected
    assert [r.kept for r in got if r.doc_id is None] == [True]
    left = near_dedup.drop_duplicates(docs)
    assert left.columns == docs.columns
    assert near_dedup.components(table.limit(0)).count() == 0


def test_url_rules_and_odd_urls(spark):
    rules = [url_filter.UrlRule("allow", "org/"), url_filter.UrlRule("block", "a.org/x/")]
    urls = [None, "", "no scheme", "http://A.org/x/1?q#f", "http://b.a.org/y", "http://notorg/", "http://a.org", "s://c.net/p", "s://c.net/p"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = {r.page_id: r for r in url_filter.judge(pages, rules).collect()}
    assert [(out[i].host, out[i].path) for i in (0, 1, 2, 3)] == [("", "")] * 3 + [("a.org", "/x/1")]
    assert [out[i].rule for i in range(9)] == [None, None, None, "a.org/x/", "org/", None, None, None, None]
    assert out[7].verdict == out[8].verdict and {r.verdict for r in out.values()} <= {"allow", "block"}
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def test_wavelet_matrix_lookups():
    ids = np.random.default_rng(3).integers(0, 40_000, 3000).astype(np.uint32)
    ids[::7] = 5
    m = wavelet.WaveletMatrix.build(ids)
    assert np.array_equal(m.decode(), ids) and [m.access(i) for i in range(0, 3000, 371)] == ids[::371].tolist()
    assert m.count(5) == (ids == 5).sum() and m.rank(5, 1234) == (ids[:1234] == 5).sum()
    assert [m.select(5, k) for k in (0, 3, m.count(5) - 1)] == np.flatnonzero(ids == 5)[[0, 3, -1]].tolist()
    assert m.count(39_999_999) == 0


def test_token_files_match_the_tokenizer(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = spark.createDataFrame([(50, "İs ǅ éx ́y a b\x85c <|endoftext|>q 12's \U0001F600x"), (51, " ")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(odd)
    folder = str(tmp_path / "tokens")
    wavelet.write_shards(rows, folder, path, end_id=1, by_word=True)
    got = wavelet.read_summaries(spark, folder).orderBy("start").collect()
    held = sorted(((r.doc_id, r.text or "") for r in rows.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    at = 0
    for r, (i, text) in zip(got, held, strict=True):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert tuple(r) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_line_field(spark, docs):
    good, bad = [words(i, 40) + "\n" + words(i + 1, 30) for i in range(80)], ["$$$ &&& a%%% b***\n### c$$$" for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 80)) for i in range(120) if i % 4 != 2] + [(None, 1), (3, None)], "doc_id long, quality int")
    field = line_crf.fit(table, labels)
    out = {r.doc_id: r.score for r in line_crf.score(table, field).collect()}
    assert all((out[i] >= 0.7) == (i < 80) for i in out)
    assert all(0 <= r.score <= 1 for r in line_crf.score(docs, field).collect())
    assert line_crf.fit(table, labels.limit(0)) is None and line_crf.score(docs, None).first().score == 0.5


def test_marginals_match_enumeration():
    from itertools import product

    evidence, tie = np.array([[0.3, -1.0, 0.7]]), np.array([[0.4, -0.2], [-0.5, 0.6]])
    good, _, total = line_crf.marginals(evidence, np.array([3]), tie)
    weight = {y: np.exp(sum((e if v else -e) / 2 for e, v in zip(evidence[0], y)) + tie[y[0], y[1]] + tie[y[1], y[2]]) for y in product((0, 1), repeat=3)}
    z = sum(weight.values())
    assert total[0] == pytest.approx(np.log(z))
    assert good[0].tolist() == pytest.approx([sum(w for y, w in weight.items() if y[t]) / z for t in range(3)])
