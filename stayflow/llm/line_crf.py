"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. A line's evidence is a linear function of its own features and of those of the lines before
and after it; a transition score ties neighbouring labels. Forward-backward gives each line's chance of being good,
and a document's score is the mean of these chances, weighted by the length of the lines.

Labels are known for documents, so in training all lines of a document carry its label. The field is trained on the
driver in numpy with Adam on at most TRAIN_DOCS labelled documents chosen by hash over the whole table, in pieces of
TRAIN_LINES lines; scoring reads every line of every text.

Texts are scored in groups of few lines; what is held of a text of many lines is some numbers a line.

A null or empty text is one empty line and gets that line's chance. Without labelled documents every score is 0.5.
Documents that repeat an id are judged each; a label that repeats an id counts once per row.
"""

from __future__ import annotations

from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayflow.llm.texts import bounded_sample, slices, split_words, window_hashes

TRAIN_DOCS = 3000
TRAIN_LINES = 64
STEPS = 250
BATCH = 256
#: Lines, with padding, that are worked on at a time.
CELLS = 1 << 15

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!?:;,.-_()[]{}\"'/\\=+~^@"]] = True


def _codes(low: int, high: int) -> np.ndarray:
    return (np.arange(256) >= low) & (np.arange(256) <= high)


_KINDS = [_codes(65, 90), _codes(97, 122), _codes(48, 57), _codes(128, 255), _SYMBOL, _MARK, np.arange(256) == ord("!")]


def own_features(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Per line: its own features, column by column, its length in bytes, its text; and the first line of each text.

    Lines end at line feeds.
    """
    feeds = np.flatnonzero(data == 10)
    kinds = np.concatenate([np.zeros(len(offsets) - 1, np.int64), np.ones(len(feeds), np.int64)])
    at = np.concatenate([offsets[:-1], feeds + 1])
    who = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, feeds, side="right") - 1])
    order = np.lexsort((kinds, at, who))
    starts, text = at[order], who[order]
    limits = np.append(starts[1:], 0)
    last = np.append(text[1:] != text[:-1], True)
    limits = np.where(last, offsets[text + 1], limits)
    first = np.searchsorted(text, np.arange(len(offsets)))
    size = np.maximum(limits - starts, 0)

    words = split_words(data, offsets)
    word_from, word_to = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, limits)
    n = np.maximum(word_to - word_from, 0)
    columns = []
    filled = np.maximum(size, 1)
    for kind in _KINDS:
        total = np.concatenate([[0], np.cumsum(kind[data])])
        columns.append((total[limits] - total[starts]) / filled)

    def share(flags: np.ndarray) -> np.ndarray:
        """Share of a line's words that are flagged."""
        total = np.concatenate([[0], np.cumsum(flags)])
        return (total[word_to] - total[word_from]) / np.maximum(n, 1)

    hashes, owner = words.hashes(), words.owner()
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    columns.append(share(same))
    # Words in three-word windows that occur again in the text.
    again = np.zeros(len(hashes), bool)
    grams = window_hashes(hashes, 3, 9)
    if len(grams):
        whole = np.flatnonzero(owner[:len(grams)] == owner[2:])
        order = whole[np.lexsort((grams[whole], owner[whole]))]
        equal = (grams[order][1:] == grams[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        twice = order[np.append(equal, False) | np.insert(equal, 0, False)]
        for k in range(3):
            again[twice + k] = True
    columns.append(share(again))
    odd = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    columns.append(share(odd[words.ends] > odd[words.starts]))
    columns.append(size / np.maximum(n, 1) / 10)
    columns.append(np.log1p(size) / 5)
    columns.append(np.log1p(n) / 3)
    columns.append((n == 0).astype(float))
    columns.append(np.log1p(words.counts)[text] / 5)
    return columns, np.maximum(size, 1), text, first


def _neighbours(column: np.ndarray, text: np.ndarray) -> list[np.ndarray]:
    """A column of the line itself, the line before and the line after; 0 where the text has none."""
    inner = text[1:] == text[:-1]
    before, after = np.zeros_like(column), np.zeros_like(column)
    before[1:][inner] = column[:-1][inner]
    after[:-1][inner] = column[1:][inner]
    return [column, before, after]


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per line: features of the line and its neighbours, length in bytes; and the first line of each text."""
    columns, size, text, first = own_features(data, offsets)
    around = [_neighbours(c.astype(np.float64), text) for c in columns]
    return np.stack([*(a[part] for part in range(3) for a in around), np.ones(len(size))], axis=1), size, first


class LineField:
    """weights: evidence for good; tie: transition scores [from, to] with 0 bad and 1 good."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, tie: np.ndarray):
        self.mean, self.scale, self.weights, self.tie = mean, scale, weights, tie

    def evidence(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def evidence_of(self, columns: list[np.ndarray], text: np.ndarray) -> np.ndarray:
        """The same from the lines' own columns, one at a time, without a matrix of all features."""
        slope = self.weights / self.scale
        total = np.full(len(text), (1 - self.mean[-1]) * slope[-1])
        for k, column in enumerate(columns):
            for part, values in enumerate(_neighbours(column.astype(np.float64), text)):
                at = part * len(columns) + k
                total += (values - self.mean[at]) * slope[at]
        return total


def marginals(evidence: np.ndarray, lengths: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over padded sequences (sequence, line): chances of good, of each pair of labels, log of the sum."""
    n, width = evidence.shape
    score = np.stack([-evidence / 2, evidence / 2], axis=2)
    live = np.arange(width) < lengths[:, None]
    ahead = np.zeros((n, width, 2))
    ahead[:, 0] = score[:, 0]
    for t in range(1, width):
        step = np.logaddexp(ahead[:, t - 1, :1] + tie[0], ahead[:, t - 1, 1:] + tie[1]) + score[:, t]
        ahead[:, t] = np.where(live[:, t, None], step, ahead[:, t - 1])
    behind = np.zeros((n, width, 2))
    for t in range(width - 2, -1, -1):
        after = behind[:, t + 1] + score[:, t + 1]
        step = np.logaddexp(tie[:, 0] + after[:, :1], tie[:, 1] + after[:, 1:])
        behind[:, t] = np.where(live[:, t + 1, None], step, 0)
    total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
    good = np.exp(ahead[:, :, 1] + behind[:, :, 1] - total[:, None])
    pairs = np.exp(ahead[:, :-1, :, None] + tie + (score + behind)[:, 1:, None, :] - total[:, None, None, None])
    return good, pairs * live[:, 1:, None, None], total


def _padded(values: np.ndarray, first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = first[which + 1] - first[which]
    at = first[which][:, None] + np.minimum(np.arange(int(lengths.max())), lengths[:, None] - 1)
    return values[at], lengths


def train(samples: list[tuple[str | None, int]], seed: int = 11) -> LineField:
    rng = np.random.default_rng(seed)
    raw = [(text or "").encode() for text, _ in samples]
    x, _, first = features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]))
    label = np.array([q for _, q in samples], np.float64)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    mean[-1], scale[-1] = 0, 1
    x = (x - mean) / scale
    starts, owner = [], []
    for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
        for at in range(a, b, TRAIN_LINES):
            starts.append((at, min(at + TRAIN_LINES, b)))
            owner.append(i)
    pieces, owner = np.array(starts), np.array(owner)
    theta = {"w": np.zeros(x.shape[1]), "tie": np.array([[0.5, -0.5], [-0.5, 0.5]])}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in theta.items()}
    for step in range(1, STEPS + 1):
        pick = rng.choice(len(pieces), min(BATCH, len(pieces)), replace=False)
        lengths = pieces[pick, 1] - pieces[pick, 0]
        at = pieces[pick, :1] + np.minimum(np.arange(int(lengths.max())), lengths[:, None] - 1)
        live = np.arange(at.shape[1]) < lengths[:, None]
        good, pairs, _ = marginals(x[at] @ theta["w"], lengths, theta["tie"])
        y = label[owner[pick]]
        # Each piece counts once, however many lines it has.
        weight = live / lengths[:, None]
        slope = (good - y[:, None]) * weight
        seen = np.zeros((2, 2))
        seen[1, 1], seen[0, 0] = (y * (lengths - 1) / lengths).sum(), ((1 - y) * (lengths - 1) / lengths).sum()
        grads = {"w": np.einsum("nt,ntk->k", slope, x[at]) / len(pick) + 1e-3 * theta["w"],
                 "tie": ((pairs / lengths[:, None, None, None]).sum(axis=(0, 1)) - seen) / len(pick) + 1e-2 * theta["tie"]}
        for name, g in grads.items():
            m, v = moments[name]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            theta[name] -= 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return LineField(mean, scale, theta["w"], theta["tie"])


def chances_of_one(evidence: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """The chance of each line of one text to be good: forward-backward over differences of the two labels' scores.

    Only the difference between good and bad is carried along, so a text needs two numbers a line, however many it has.
    """
    (bb, bg), (gb, gg) = tie.tolist()
    given = evidence.tolist()
    add = lambda a, b: max(a, b) + log1p(exp(-abs(a - b)))
    ahead, at = [], 0.0
    for i, e in enumerate(given):
        at = e + (add(bg, at + gg) - add(bb, at + gb) if i else 0.0)
        ahead.append(at)
    out, back = np.empty(len(given)), 0.0
    for i in range(len(given) - 1, -1, -1):
        out[i] = ahead[i] + back
        after = given[i] + back
        back = add(gb, gg + after) - add(bb, bg + after)
    return 1 / (1 + np.exp(-np.clip(out, -700, 700)))


def score_texts(field: LineField, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Scores of texts. Texts are padded to the longest of a group that has CELLS lines at most; a longer text is one by itself."""
    columns, size, text, first = own_features(data, offsets)
    evidence = field.evidence_of(columns, text)
    lines = np.diff(first)
    out = np.zeros(len(lines))
    order = np.argsort(lines, kind="stable")
    at = 0
    while at < len(order):
        longest = lines[order[at:at + 128]]
        fits = int((longest * np.arange(1, len(longest) + 1) <= CELLS).sum())  # lines grow, so do the cells
        which = order[at:at + max(fits, 1)]
        at += len(which)
        if len(which) == 1:
            own = slice(first[which[0]], first[which[0] + 1])
            good, weight = chances_of_one(evidence[own], field.tie)[None], size[own][None]
        else:
            padded, lengths = _padded(evidence, first, which)
            good, _, _ = marginals(padded, lengths, field.tie)
            weight = _padded(size, first, which)[0] * (np.arange(padded.shape[1]) < lengths[:, None])
        out[which] = (good * weight).sum(axis=1) / weight.sum(axis=1)
    return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> LineField | None:
    """A field from labelled documents; `labels` has the ids to learn from. None without any."""
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label is not null and id is not null")
    marked = bounded_sample(marked, F.col("id"), TRAIN_DOCS)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(marked, "id")
    samples = [(r.text, r.label) for r in rows.orderBy("id", "text", "label").collect()]
    return train(samples) if samples else None


def score(docs: DataFrame, field: LineField | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with the score; a column of this name is replaced."""
    docs = docs.drop(score_col)
    if field is None:
        return docs.withColumn(score_col, F.lit(0.5))

    def work(batches):
        for batch in batches:
            for rows, data, offsets in slices(batch, text_col):
                scores = pa.array(score_texts(field, data, offsets), pa.float64())
                yield pa.RecordBatch.from_arrays([*rows.columns, scores], [*rows.schema.names, score_col])

    return docs.mapInArrow(work, docs.withColumn(score_col, F.lit(0.0)).schema)
