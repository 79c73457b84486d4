"""The line classifier on texts with very many lines."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from stayflow.llm import line_crf

RNG = np.random.default_rng(3)
FIELD = line_crf.train([("a good line of words here\\nand more of it" * (1 + i % 3), 1) for i in range(40)] + [("!! $$ 1\\n## ##\\n\\nX" * (1 + i % 4), 0) for i in range(40)])


def scored(texts):
    raw = [t.encode() for t in texts]
    return line_crf.score_texts(FIELD, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]))


def by_the_matrix(text):
    """Scores from the matrix of all features and the padded forward-backward."""
    raw = text.encode()
    x, size, first = line_crf.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    good, _, _ = line_crf.marginals(FIELD.evidence(x)[None], np.array([len(size)]), FIELD.tie)
    return (good[0] * size).sum() / size.sum()


@pytest.mark.parametrize("lines", [1, 2, 3, 40, 700])
def test_one_text_and_groups_give_the_same_scores(lines):
    texts = ["\n".join(RNG.choice(["good words here", "## $$", "", "x", "1 2 3"], lines)) for _ in range(5)]
    expected = [by_the_matrix(t) for t in texts]
    assert np.allclose(scored(texts), expected) and np.allclose([scored([t])[0] for t in texts], expected)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(line_crf, "CELLS", 1)
        assert np.allclose(scored(texts), expected)


def test_many_lines_need_little_memory():
    long, texts = "ab\n" * 500_000, ["a few words"] * 127
    tracemalloc.start()
    found = scored([*texts, long])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 << 20
    assert np.allclose(found[:127], found[0]) and 0 <= found[127] <= 1
    assert abs(found[127] - by_the_matrix("ab\n" * 2000)) < 1e-2
