"""Documents that hold only a part of a long benchmark item."""

from __future__ import annotations

import random

from stayflow.llm import decontaminate
from tests.llm.test_operators import brute_distance, words


def test_parts_of_long_items_are_found_as_by_full_alignment():
    rng = random.Random(4)
    items = [(0, words(40, 150)), (1, words(41, 40)), (2, words(42, 20))]
    texts = []
    for n in range(30):
        item = items[n % 3][1]
        size = rng.choice([120, 180, 200, 249, 320, len(item)])
        at = rng.randrange(max(1, len(item) - size))
        part = list(item[at:at + size])
        for _ in range(rng.randrange(0, 1 + len(part) // 12)):
            p = rng.randrange(len(part))
            part[p:p + 1] = rng.choice([["z"], [], [part[p], "q"]])
        texts.append(decontaminate.normalize(words(600 + n, 8) + " " + "".join(part) + " " + words(700 + n, 8)))
    index = decontaminate.Index(items, 0.1)
    got = {(t, i): (e, a, b) for t, i, e, a, b in index.search(texts)}
    expected = {}
    for t, text in enumerate(texts):
        for i, (_, item) in enumerate(items):
            whole = brute_distance(item, text)
            cuts = [item[a:a + 200] for a in [*range(0, len(item) - 200, 50), len(item) - 200]] if len(item) > 200 else []
            if whole <= len(item) // 10:
                expected[t, i] = whole
            elif (least := min((brute_distance(c, text) for c in cuts), default=99)) <= 20:
                expected[t, i] = least
    assert {k: e for k, (e, _, _) in got.items()} == expected
    assert sum(brute_distance(items[i][1], texts[t]) > len(items[i][1]) // 10 for t, i in expected) >= 3


def test_half_of_a_long_item_is_a_leak(spark):
    item = words(50, 200)
    rows = [(1, words(51, 30) + " " + item[300:900] + " " + words(52, 30)), (2, words(53, 200)), (3, item[:249]), (4, item[10:150])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.edits) for r in decontaminate.find(docs, bench).collect()} == {(1, 7, 0), (3, 7, 0)}
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()) == [2, 4]
