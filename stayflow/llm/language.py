"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads each word byte by byte in both directions, labels every byte with the chances of the languages, and
a document's chances are the mean over all its bytes. The state starts anew with each word (and after SEGMENT bytes of
a longer one), so equal words get equal labels: a task runs the network once per different word, keeps
up to KNOWN_WORDS answers, and counts a word as often as it occurs. Every byte of every text is thus labelled, at the price of the vocabulary.

The network is trained on the driver in numpy, by backpropagation through time with Adam, on at most TRAIN_DOCS
labelled documents chosen by hash over the whole table and WORDS_EACH words per language from them; prediction uses
text only. Null texts and texts without a letter are `und` with score 0, and so are all texts if nothing is labelled.
Repeated rows are judged alike; labels with null text or null language are not learnt from.

`accepted` tells the texts whose score is high enough for their length: see there for the threshold.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayflow.llm.texts import bounded_sample, slices, split_words

TRAIN_DOCS = 1500
WORDS_EACH = 12_000
STEPS = 160
BATCH = 512
HIDDEN = 8
SEGMENT = 48
KNOWN_WORDS = 500_000
SLICE = 1 << 20
UNKNOWN = "und"
#: Scores are counted in steps of 1 / SCORE_STEPS; the lowest LOWEST of the rightly judged ones do not set the threshold.
SCORE_STEPS = 1000
LOWEST = 0.01


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words cut into segments of at most SEGMENT bytes, longest first: where they begin, their lengths, their words."""
    lengths = ends - starts
    pieces = np.maximum(1, -(-lengths // SEGMENT))
    word = np.repeat(np.arange(len(starts)), pieces)
    nth = np.arange(len(word)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = starts[word] + nth * SEGMENT
    size = np.minimum(ends[word] - begin, SEGMENT)
    order = np.argsort(-size, kind="stable")
    return begin[order], size[order], word[order]


def _bytes_of(data: np.ndarray, begin: np.ndarray, size: np.ndarray, reverse: bool) -> np.ndarray:
    at = np.arange(int(size.max()))
    place = (size[:, None] - 1 - at) if reverse else np.broadcast_to(at, (len(size), len(at)))
    inside = (at < size[:, None])
    return np.where(inside, data[np.clip(begin[:, None] + place, 0, len(data) - 1)], 0)


class Network:
    """Parameters by name; `f` and `b` are the two directions."""

    def __init__(self, languages: list[str], weights: dict[str, np.ndarray]):
        self.languages, self.weights = languages, weights
        self.name = ""  # set when trained, to tell networks apart in a reused worker

    @classmethod
    def new(cls, languages: list[str], seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        weights = {}
        for d in "fb":
            weights[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * HIDDEN))
            weights[f"u{d}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 3 * HIDDEN))
            weights[f"o{d}"] = rng.normal(0, 0.1, (HIDDEN, len(languages)))
        weights["bias"] = np.zeros(len(languages))
        return cls(languages, {k: v.astype(np.float32) for k, v in weights.items()})

    def states(self, letters: np.ndarray, size: np.ndarray, direction: str, keep: list | None = None) -> np.ndarray:
        """States after each byte, (time, word, hidden). Words are ordered longest first."""
        x, u = self.weights[f"x{direction}"], self.weights[f"u{direction}"]
        n, length = letters.shape
        out = np.zeros((length, n, HIDDEN), np.float32)
        h = np.zeros((n, HIDDEN), np.float32)
        for t in range(length):
            live = int(np.searchsorted(-size, -t, side="left"))  # words longer than t
            h = h[:live]
            inputs, inner = x[letters[:live, t]], h @ u
            gates = _sigmoid(inputs[:, :2 * HIDDEN] + inner[:, :2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            new = np.tanh(inputs[:, 2 * HIDDEN:] + r * inner[:, 2 * HIDDEN:])
            if keep is not None:
                keep.append((h, z, r, new, inner[:, 2 * HIDDEN:]))
            h = new + z * (h - new)
            out[t, :live] = h
        return out

    def chances(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Sum over the bytes of each segment of the chances of the languages."""
        forward = self.states(_bytes_of(data, begin, size, False), size, "f")
        backward = self.states(_bytes_of(data, begin, size, True), size, "b")
        total = np.zeros((len(size), len(self.languages)))
        for t in range(int(size[0])):
            live = int(np.searchsorted(-size, -t, side="left"))
            logits = forward[t, :live] @ self.weights["of"] + self.weights["bias"]
            logits += backward[size[:live] - 1 - t, np.arange(live)] @ self.weights["ob"]
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            total[:live] += e / e.sum(axis=1, keepdims=True)
        return total

    def step(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy over all bytes."""
        w, n, total = self.weights, len(size), float(size.sum())
        letters = {d: _bytes_of(data, begin, size, d == "b") for d in "fb"}
        kept: dict[str, list] = {"f": [], "b": []}
        states = {d: self.states(letters[d], size, d, kept[d]) for d in "fb"}
        grads = {k: np.zeros_like(v) for k, v in w.items()}
        outer = {d: np.zeros_like(states[d]) for d in "fb"}
        for t in range(int(size[0])):
            live = int(np.searchsorted(-size, -t, side="left"))
            rows, back = np.arange(live), size[:live] - 1 - t
            f, b = states["f"][t, :live], states["b"][back, rows]
            logits = f @ w["of"] + b @ w["ob"] + w["bias"]
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            d = e / e.sum(axis=1, keepdims=True)
            d[rows, label[:live]] -= 1
            d = (d / total).astype(np.float32)
            grads["of"] += f.T @ d
            grads["ob"] += b.T @ d
            grads["bias"] += d.sum(axis=0)
            outer["f"][t, :live] += d @ w["of"].T
            outer["b"][back, rows] += d @ w["ob"].T
        for d in "fb":
            u, dh = w[f"u{d}"], np.zeros((n, HIDDEN), np.float32)
            for t in reversed(range(int(size[0]))):
                h, z, r, new, inner = kept[d][t]
                live = len(h)
                g = dh[:live] + outer[d][t, :live]
                a_new = g * (1 - z) * (1 - new * new)
                a_z = g * (h - new) * z * (1 - z)
                a_r = a_new * inner * r * (1 - r)
                a = np.concatenate([a_z, a_r, a_new], axis=1)
                np.add.at(grads[f"x{d}"], letters[d][:live, t], a)
                a[:, 2 * HIDDEN:] *= r
                grads[f"u{d}"] += h.T @ a
                dh[:live] = g * z + a @ u.T
        return grads


def train(samples: list[tuple[str, str]], seed: int = 7) -> Network:
    """A network from (text, language) pairs."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for _, lang in samples})
    net = Network.new(languages, seed)
    if len(languages) < 2:
        return net
    raw = [text.encode() for text, _ in samples]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])
    words = split_words(data, offsets)
    label = np.array([languages.index(lang) for _, lang in samples])[words.owner()]
    per = [rng.permutation(np.flatnonzero(label == k))[:WORDS_EACH] for k in range(len(languages))]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.weights.items()}
    for step in range(1, STEPS + 1):
        at = np.concatenate([rng.choice(p, BATCH // len(per) + 1) for p in per if len(p)])
        begin, size, word = _segments(data, words.starts[at], words.ends[at])
        rate = 0.02 * (1 - step / (STEPS + 1)) + 0.001
        for name, g in net.step(data, begin, size, label[at][word]).items():
            m, v = moments[name]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            net.weights[name] -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    net.name = hashlib.md5(b"".join(w.tobytes() for w in net.weights.values())).hexdigest()
    return net


class _Known:
    """What a task knows of words, by their 64-bit hash: arrays in order of the hashes, of at most KNOWN_WORDS words."""

    def __init__(self, width: int):
        self.hashes, self.values = np.zeros(0, np.uint64), np.zeros((0, width), np.float32)

    def add(self, hashes: np.ndarray, values: np.ndarray) -> None:
        if len(self.hashes) + len(hashes) > KNOWN_WORDS:
            self.__init__(values.shape[1])
        order = np.argsort(np.concatenate([self.hashes, hashes]), kind="stable")
        self.hashes, self.values = np.concatenate([self.hashes, hashes])[order], np.concatenate([self.values, values])[order]


def _word_chances(net: Network, known: _Known, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum over the bytes of each word of the chances of the languages; a word that the task knows is looked up."""
    out = np.zeros((len(hashes), len(net.languages)), np.float32)
    new = np.ones(len(hashes), bool)
    if len(known.hashes):
        at = np.minimum(np.searchsorted(known.hashes, hashes), len(known.hashes) - 1)
        new = known.hashes[at] != hashes
        out[~new] = known.values[at[~new]]
    if new.any():
        begin, size, word = _segments(data, starts[new], ends[new])
        found = np.zeros((int(new.sum()), len(net.languages)), np.float32)
        for at in range(0, len(begin), 4096):
            part = slice(at, at + 4096)
            np.add.at(found, word[part], net.chances(data, begin[part], size[part]))
        out[new] = found
        known.add(hashes[new], found)
    return out


def _judge(net: Network, known: _Known, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    words, n = split_words(data, offsets), len(offsets) - 1
    total = np.zeros((n, len(net.languages)))
    if len(words.starts):
        hashes, first, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        per_word = _word_chances(net, known, hashes, data, words.starts[first], words.ends[first])
        owner = words.owner()
        for k in range(len(net.languages)):
            total[:, k] = np.bincount(owner, per_word[which, k], n)
    lower = np.concatenate([[0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122))])
    letters = lower[offsets[1:]] > lower[offsets[:-1]]
    for i in np.flatnonzero(~letters & (offsets[1:] > offsets[:-1])):
        letters[i] = any(map(str.isalpha, data[offsets[i]:offsets[i + 1]].tobytes().decode()))
    sums = total.sum(axis=1)
    score = np.where(letters & (sums > 0), total.max(axis=1) / np.maximum(sums, 1e-9), 0.0)
    best = total.argmax(axis=1)
    return [net.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)], np.clip(score, 0, 1)


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network from the rows for which `learn` holds; None without labelled rows."""
    rows = docs.where(learn & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    samples = [(r.text, r.lang) for r in bounded_sample(rows, F.col("id"), TRAIN_DOCS).collect()]
    return train(samples) if samples else None


def predict(docs: DataFrame, net: Network | None, text_col: str = "text", lang_col: str = "lang_pred",
            score_col: str = "score") -> DataFrame:
    """`docs` with the predicted language and its score; columns of these names are replaced."""
    docs = docs.drop(lang_col, score_col)
    if net is None or not net.languages:
        return docs.withColumns({lang_col: F.lit(UNKNOWN), score_col: F.lit(0.0)})

    def work(batches):
        known = _Known(len(net.languages))  # for this task; a worker that goes on to other work holds nothing
        for batch in batches:
            for rows, data, offsets in slices(batch, text_col, SLICE):
                languages, score = _judge(net, known, data, offsets)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(languages, pa.string()), pa.array(score, pa.float64())],
                                                 [*rows.schema.names, lang_col, score_col])

    schema = docs.withColumns({lang_col: F.lit(""), score_col: F.lit(0.0)}).schema
    return docs.mapInArrow(work, schema)


def thresholds(judged: DataFrame, net: Network, label_col: str, text_col: str, lang_col: str, score_col: str) -> dict[int, float]:
    """Per length class (whole part of the binary logarithm of the bytes) the score from which a text is accepted.

    It lies halfway between chance (1 / languages) and the score that all but the lowest LOWEST of the labelled rows of
    the class reach which are judged as labelled. All labelled rows count; one number per class and score step is collected.
    """
    right = judged.where(F.col(label_col) == F.col(lang_col))
    counts = right.groupBy(_length_class(text_col).alias("cls"), F.floor(F.col(score_col) * SCORE_STEPS).alias("step")).count()
    by_class: dict[int, list[tuple[int, int]]] = {}
    for r in counts.collect():
        by_class.setdefault(r.cls, []).append((r.step, r["count"]))
    chance, out = 1 / len(net.languages), {}
    for cls, steps in by_class.items():
        steps.sort()
        beyond = np.cumsum([n for _, n in steps])
        sure = steps[int(np.searchsorted(beyond, LOWEST * beyond[-1], side="right"))][0] / SCORE_STEPS
        out[cls] = chance + max(0.0, sure - chance) / 2
    return out


def _length_class(text_col: str) -> Column:
    return F.floor(F.log2(F.octet_length(F.col(text_col)))).cast("int")


def accepted(judged: DataFrame, net: Network, label_col: str, text_col: str = "text", lang_col: str = "lang_pred",
             score_col: str = "score") -> Column:
    """Whether a language is found in a text, with a score that reaches the threshold of its length class.

    `judged` is the result of `predict` with the labels; it is read once more, so have it written. A class without
    rightly judged labelled rows takes the threshold of the next shorter class that has some; below all of these, and
    with fewer than two languages, the score rejects nothing.
    """
    least = F.lit(0.0)
    if len(net.languages) > 1:
        for cls, threshold in sorted(thresholds(judged, net, label_col, text_col, lang_col, score_col).items()):
            least = F.when(_length_class(text_col) >= cls, threshold).otherwise(least)
    return (F.col(lang_col) != UNKNOWN) & (F.col(score_col) >= least)
