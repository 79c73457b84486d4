"""Spelling variants, personal data and the prefix trie against brute force, on nulls, long texts, ties and empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from stayflow.llm import pii, prefix_trie, queries, spelling
from tests.compare import connect

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, word string, tile int, n int, found string, kind int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, 2, "f", 3) for i, t in rows], DOCS)


# Spelling variants.

def brute_words(rows, one_in):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if one_in and h % one_in == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(rows, one_in):
    words = brute_words(rows, one_in)
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def spelled(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abÀé") for _ in range(rng.randint(4, 9))) for _ in range(12)]
    rows = []
    for i in range(60):
        picked = []
        for _ in range(60):
            w = rng.choice(stems)
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "a", "ÿ", w[at] * 2]) + w[at + rng.randint(0, 1):]
            picked.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i % 40 if i % 7 else None, rng.choice([" ", ",", "1"]).join(picked)))
    long = "xy" * 60_000
    rows += [(100 + i, t) for i, t in enumerate([None, "", "12 ! œ", long + "z", long + "z", long + "z", long, long, long, "ab" * 3])]
    return rows + rows[:5]


@pytest.mark.parametrize("one_in", [0, 3, 97])
def test_variants_match_brute_force(spark, one_in):
    rows = spelled(one_in)
    found = spelling.group_variants(documents(spark, rows).repartition(3), one_in=one_in)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    out = found.collect()
    assert len(out) == len({r.word for r in out})
    assert {tuple(r) for r in out} == brute_variants(rows, one_in)


def test_keys_with_many_words_are_cut_into_tiles_without_loss(spark, monkeypatch):
    monkeypatch.setattr(spelling, "TILE", 3)
    rows = spelled(5)
    found = {tuple(r) for r in spelling.group_variants(documents(spark, rows)).collect()}
    assert found == brute_variants(rows, 0)


def test_crc_continues_and_runs_end_with_their_text():
    texts = ["AbÀc1de", "ÿx", "", "a" * 100]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])
    runs, points = spelling.letter_runs(data, offsets)
    found = [runs.data[a:b].tobytes().decode() for a, b in zip(runs.starts, runs.ends)]
    assert found == ["abÀc", "de", "ÿx", "a" * 100] and points.tolist() == [4, 2, 2, 100]
    assert runs.first.tolist() == [0, 2, 3, 3, 4]
    heads = np.array([zlib.crc32(b"7:")] * 4, np.uint32)
    assert spelling.crc_after(runs.data, runs.starts, runs.ends, heads).tolist() == [zlib.crc32(f"7:{w}".encode()) for w in found]


def test_no_words(spark):
    assert spelling.group_variants(documents(spark, [(1, None), (None, "a b c")])).count() == 0
    assert spelling.group_variants(documents(spark, [(1, "x")]).limit(0)).count() == 0


# Prefix trie.

CONVS = "conv_id long, turn long, role string, text string, place string, digest int, members int"


def brute_trie(rows, heads, group):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [(role, text) for *_, role, text in sorted(t)] for c, t in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        skip = zlib.crc32(str(c).encode()) % heads if group else 0
        first = own.get(c - c % group, []) if group else []
        rebuilt[c] = tuple(first[:skip] + turns[skip:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
        ends[rebuilt[c]].append(c)
    out = []
    for node, inside in members.items():
        below = [x for x in members if x[:len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(y[:-1] == x for y in members if len(y) == len(x) + 1)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        told = hashlib.sha256(",".join(map(str, ends.get(node, []))).encode()).hexdigest()
        out.append((inside[0], len(node), members[node[:-1]][0] if node else None, len(inside), len(children), len(leaves), saved, told))
    return sorted(out, key=str)


def conversations(seed, n=260):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if c % 13 == 7 and c > 20:
            continue  # some numbers, and one group's first, are absent
        if c == 100:
            continue
        for turn in range(rng.randint(1, 6)):
            rows.append((c + 7_000_000_000 * (c % 17 == 0), turn if rng.random() < 0.95 else None, rng.choice(["user", "bot", None]),
                         rng.choice(["hé", "yes", None, "", f"own {c}"])))
    rows += [(5, 9, "user", "x" * 300_000), (5, 9, "user", "x" * 300_000), (None, 0, "user", "nobody"), (-3, 0, "user", "hé"), (-3, 1, "bot", "yes")]
    # A third of all conversations is alike, with many turns.
    rows += [(c, t, "user", f"step {t}") for c in range(10_000, 10_040) for t in range(12)]
    return rows


def trie_rows(spark, rows, **how):
    df = spark.createDataFrame([(*r, "p", 1, 2) for r in rows], CONVS).repartition(5)
    return sorted((tuple(r) for r in prefix_trie.build(df, **how).collect()), key=str)


@pytest.mark.parametrize("group", [0, 100])
def test_trie_matches_brute_force(spark, group):
    rows = conversations(group)
    assert trie_rows(spark, rows, heads=6, group=group) == brute_trie(rows, 6, group)


def test_shards_that_cut_conversations_give_the_same_trie():
    rng = random.Random(4)
    alike = [rng.randrange(1, 1 << 60) for _ in range(40)]

    def nodes(shard_turns, shard_convs):
        found = defaultdict(lambda: [set(), set()])
        shard = prefix_trie.Shard()

        def take():
            batch = shard.nodes()
            for a, b, d, members, ends in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5))):
                assert not found[a, b, d][0] & set(members)
                found[a, b, d][0].update(members)
                found[a, b, d][1].update(ends)

        for c in range(30):
            shard.end()
            if len(shard.ids) >= shard_convs:
                take()
                shard = prefix_trie.Shard()
            shard.open(c)
            for t in range(0, 5 + c % 3 * 30, 5):
                if shard.turns >= shard_turns:
                    rest = shard.rest()
                    if shard.ids:
                        take()
                    shard = rest
                digest = np.array([[alike[(t + k) % 40] if (t + k) < 7 * (c % 5) else 1000 * c + t + k, 1] for k in range(5)], np.uint64)
                shard.add(digest, np.ones(5, np.int64))
        shard.end()
        take()
        return {k: (frozenset(m), frozenset(e)) for k, (m, e) in found.items()}

    whole = nodes(10_000, 10_000)
    assert nodes(7, 10_000) == whole and nodes(40, 4) == whole


def test_trie_of_nothing(spark):
    assert trie_rows(spark, [(None, 1, "user", "x")]) == []
    assert prefix_trie.build(spark.createDataFrame([], CONVS)).count() == 0
    # All own turns are replaced by those of an absent conversation: a member of the root that ends there.
    lone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    assert trie_rows(spark, [(lone, 0, "a", "b")], group=100) == [
        (lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


# Personal data.

BASE = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_base(text):
    out = []
    for kind, pattern in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            fits = [True, kind == 1 and all(int(p) <= 255 for p in m.group().split(".")),
                    13 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0, 9 <= len(digits) <= 15]
            if fits[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_match_the_patterns():
    rng = random.Random(3)
    for letters in ("a1@.+- ()%_5 9.é", "0123456789 .+-", "ab@.-"):
        for _ in range(4000):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 50)))
            assert pii.base_spans(text) == brute_base(text), text


@pytest.mark.parametrize("text", ["1" * 300_000, "a" * 300_000, "a@" * 100_000, "+1" * 100_000, "(at)" * 100_000, "1.1 " * 100_000, "12-" * 100_000])
def test_long_texts_take_linear_time(text):
    assert pii.base_spans(text) == [] and len(pii.candidates(text)) <= len(text) // 14


def test_expectation_maximisation_finds_the_reliabilities():
    rng = np.random.default_rng(2)
    n, right = 20_000, np.array([0.95, 0.8, 0.7, 0.9, 0.9, 0.6])
    truth = rng.random(n) < 0.4
    given = np.where(rng.random((n, 6)) < right, 1, -1) * np.where(truth, 1, -1)[:, None]
    given[rng.random((n, 6)) < 0.2] = 0
    kinds, counts = np.unique(given, axis=0, return_counts=True)
    chance, told, share = pii.reliabilities(kinds, counts.astype(float))
    assert abs(share - 0.4) < 0.03
    assert np.abs(told[:, 1, 2] - right)[1:].max() < 0.06 and np.abs(told[:, 0, 0] - right)[1:].max() < 0.06
    by_row = {tuple(k): c for k, c in zip(kinds.tolist(), chance)}
    assert np.mean([(by_row[tuple(g)] >= 0.5) == t for g, t in zip(given.tolist(), truth)]) > 0.95


def test_added_spans_touch_nothing_and_the_likelier_come_first():
    base = [(2, 10, 20), (3, 15, 25)]
    others = [(0.95, 3, 0, 5), (0.99, 2, 4, 9), (0.97, 1, 24, 30), (0.5, 0, 40, 50), (0.91, 0, 25, 28)]
    assert pii.added(base, others, 0.9) == [(2, 4, 9), (0, 25, 28)]


def test_personal_data_on_a_fixture(spark):
    rng = random.Random(6)
    plain = ["the meeting at home. Then on", "version 1.2.3.400 of it", "1234567890123456 and", "pages 10-20", "nothing"]
    rows = [(i, f"call me {rng.choice(plain)} or a{i}.b@mail{i % 7}.example.com, +49 170 {1000000 + i * 77} é 192.0.2.{i % 250}") for i in range(150)]
    rows += [(200 + i, f"please write e-mail to jane{i}(at)mail.example(dot)com today") for i in range(60)]
    rows += [(300, None), (301, ""), (302, "clean text at home. Then 12 of 30"), (None, "x@y.zz"), (5, "x@y.zz")]
    out = pii.find_personal(documents(spark, rows).repartition(4)).collect()
    assert out[0].asDict().keys() == {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"}
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t or "")
    assert Counter(r.doc_id for r in out) == {i: len(t) for i, t in texts.items()}
    for r in out:
        for t in texts[r.doc_id]:
            base = brute_base(t)
            joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
            if hashlib.sha256(joined.encode()).hexdigest() == r.base_sha256:
                break
        else:
            raise AssertionError(r)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in base) for x in range(4)]
        spans = set(r.spans.split(",")) - {""}
        assert spans >= set(joined.split(",")) - {""}
        if r.doc_id is not None and 200 <= r.doc_id < 260:
            assert len(spans) == 1 and r.spans.startswith("email:23:")
        else:
            assert len(spans) == len(base)
    assert pii.find_personal(documents(spark, rows).limit(0)).count() == 0


def test_registered_queries_on_the_given_tables(spark):
    docs = connect(SF).execute("SELECT doc_id, text FROM documents").fetchall()
    out = {r.doc_id: r for r in queries.QUERIES["op12_personal_data"](spark, SF).collect()}
    assert len(out) == len(docs)
    for i, text in docs:
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in brute_base(text or ""))
        assert out[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(out[i].spans.split(",")) >= set(joined.split(","))
