"""Benchmark decontamination: find benchmark passages in documents, allowing for edits.

Texts are compared in lower case with white space made single spaces. An item of m characters is found where a
stretch of the document has an edit distance of at most k = share * m to it. Such a stretch has at least
m + 1 - q - k * q of the item's q-grams (the q-gram lemma), all on diagonals that differ by 2 * k at most. Shared
q-grams are counted in overlapping bands of diagonals; bands that reach the bound are verified by banded alignment.

An item longer than SEGMENT characters is also looked for in segments of that length, one every STEP characters and one
at its end, each with an edit budget and a bound of its own. So a document that quotes SEGMENT + STEP - 1 characters of
an item in a row, with edits within the budget, is found. Where the whole item is found, its place is reported,
else that of the segment with the fewest edits, the first of several.

The benchmark is a stated query set against all documents: it goes out in blocks of BLOCK_CHARS characters (segments
included), each broadcast by its own, and every document is read once per block, without a shuffle. An item too short
for a bound at any q is looked for without edits. Null and empty items match nothing, null and empty texts are matched by nothing;
repeated items and rows are reported each. A text is worked on whole, in as many q-grams as it has.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayflow.llm.texts import mix, slices

BLOCK_CHARS = 4_000_000
SLICE = 1 << 20
SHARE = 0.1
LONGEST_GRAM = 8
SEGMENT, STEP = 200, 50
_BITS = 22
FAR = np.int32(1 << 28)
#: Candidates aligned at a time.
ALIGNED = 512


def normalize(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _chars(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def budget(length: int, share: float) -> tuple[int, int, int]:
    """Edits k, gram length q and bound t for an item: the longest q that leaves a bound of an eighth of the item."""
    k = int(share * length)
    for q in range(min(LONGEST_GRAM, length), 0, -1):
        bound = length + 1 - q - k * q
        if bound >= max(1, length // 8):
            return k, q, bound
    return 0, min(LONGEST_GRAM, length), max(1, length + 1 - min(LONGEST_GRAM, length))


def _gram_hashes(chars: np.ndarray, q: int) -> np.ndarray:
    n = len(chars) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(q):
        out = out * np.uint64(0x9E3779B97F4A7C15) + chars[i:i + n]
    return mix(out, q)


def _segment_starts(length: int) -> list[int]:
    """Where the segments of an item begin; none for an item that is no longer than one."""
    return [*range(0, length - SEGMENT, STEP), length - SEGMENT] if length > SEGMENT else []


@dataclass
class _Grams:
    """All grams of one length: sorted hashes, and where each occurs, as item and place."""

    q: int
    hashes: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    present: np.ndarray


class Index:
    """A block of benchmark items: whole ones first, then segments; `owner` tells the whole item of each."""

    def __init__(self, items: list[tuple[object, str | None]], share: float):
        cleaned = [(i, _chars(normalize(t))) for i, t in items]
        cleaned = [(i, c) for i, c in cleaned if len(c)]
        self.ids = [i for i, _ in cleaned]
        cut = [(n, c[a:a + SEGMENT]) for n, (_, c) in enumerate(cleaned) for a in _segment_starts(len(c))]
        self.chars = [c for _, c in cleaned] + [c for _, c in cut]
        self.owner = np.array([*range(len(cleaned)), *(n for n, _ in cut)], np.int64)
        limits = [budget(len(c), share) for c in self.chars]
        self.edits = np.array([k for k, _, _ in limits], np.int64)
        self.bound = np.array([t for _, _, t in limits], np.int64)
        self.grams = []
        for q in sorted({q for _, q, _ in limits}):
            own = [n for n, lim in enumerate(limits) if lim[1] == q]
            found = [_gram_hashes(self.chars[n], q) for n in own]
            hashes = np.concatenate(found)
            item = np.repeat(own, [len(f) for f in found])
            place = np.concatenate([np.arange(len(f)) for f in found])
            order = np.argsort(hashes, kind="stable")
            keys, first = np.unique(hashes[order], return_index=True)
            present = np.zeros(1 << _BITS, bool)
            present[keys >> np.uint64(64 - _BITS)] = True
            self.grams.append(_Grams(q, keys, np.append(first, len(hashes)), item[order], place[order], present))

    def _candidates(self, chars: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Rows of (text, item, band) whose shared grams reach the item's bound."""
        out = []
        for g in self.grams:
            hashes = _gram_hashes(chars, g.q)
            at = np.flatnonzero(g.present[hashes >> np.uint64(64 - _BITS)])
            key = np.searchsorted(g.hashes, hashes[at])
            real = g.hashes[np.minimum(key, len(g.hashes) - 1)] == hashes[at]
            at, key = at[real], key[real]
            text = np.searchsorted(starts, at, side="right") - 1
            times = g.first[key + 1] - g.first[key]
            which = np.repeat(g.first[key], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            pair = np.repeat(text * len(self.chars), times) + g.item[which]
            # A pair needs the bound in all its bands together, before it can have it in one.
            _, back, total = np.unique(pair, return_inverse=True, return_counts=True)
            enough = total[back] >= self.bound[g.item[which]]
            which, pair, at = which[enough], pair[enough], np.repeat(at, times)[enough]
            item, place = g.item[which], g.place[which]
            # Diagonals are made positive by twice the length of all texts.
            diagonal = at - starts[pair // len(self.chars)] - place + 2 * len(chars)
            band = diagonal // (2 * self.edits[item] + 1)
            pair, band, place = (np.concatenate(x) for x in ([pair, pair], [band, band - 1], [place, place]))
            order = np.lexsort((place, band, pair))
            pair, band, place = pair[order], band[order], place[order]
            other = np.ones(len(pair), bool)  # a gram of the item counts once in a band
            other[1:] = (pair[1:] != pair[:-1]) | (band[1:] != band[:-1]) | (place[1:] != place[:-1])
            pair, band = pair[other], band[other]
            new = np.ones(len(pair), bool)
            new[1:] = (pair[1:] != pair[:-1]) | (band[1:] != band[:-1])
            begin = np.flatnonzero(new)
            counts = np.diff(np.append(begin, len(pair)))
            pair, band = pair[begin], band[begin]
            item = pair % len(self.chars)
            hit = counts >= self.bound[item]
            out.append(np.stack([pair[hit] // len(self.chars), item[hit],
                                 band[hit] * (2 * self.edits[item[hit]] + 1) - 2 * len(chars)], axis=1))
        return np.concatenate(out) if out else np.zeros((0, 3), np.int64)

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, start, end) of the best place for each pair that matches."""
        if not self.ids:
            return []
        joined = _chars("\x00".join(texts) + "\x00")
        lengths = np.array([len(t) for t in texts])
        starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        found = self._candidates(joined, starts)
        whole = found[:, 1] < len(self.ids)
        best = self._verified(found[whole], joined, starts, lengths)
        parts = found[~whole]
        if len(parts) and best:
            known = np.array([t * len(self.ids) + i for t, i in best])
            parts = parts[~np.isin(parts[:, 0] * len(self.ids) + self.owner[parts[:, 1]], known)]
        best |= self._verified(parts, joined, starts, lengths)
        return [(text, item, *got) for (text, item), got in sorted(best.items())]

    def _verified(self, found: np.ndarray, joined: np.ndarray, starts: np.ndarray,
                  lengths: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """Fewest edits, start and end by text and whole item."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for at in range(0, len(found), ALIGNED):
            text, item, low = found[at:at + ALIGNED].T
            k = self.edits[item]
            got = align([self.chars[i] for i in item], joined, starts[text], lengths[text], low - k, low + 5 * k + 2, k)
            for t, i, g in zip(text.tolist(), self.owner[item].tolist(), got):
                if g and ((t, i) not in best or g < best[t, i]):
                    best[t, i] = g
        return best


def _last_rows(items: np.ndarray, lengths: np.ndarray, chars: np.ndarray, valid: np.ndarray, row: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Edit distances of whole items by diagonal, for many items at a time; beyond `most` they need not be exact.

    Row c of `items` is padded from lengths[c] on. chars[c, x] is the text's character at the x-th place of the band
    and valid[c, x] whether that place, between characters, exists; `row` has the distances of no characters.
    """
    width, steps = row.shape[1], np.arange(row.shape[1], dtype=np.int32)
    out = np.full(row.shape, FAR, np.int32)
    live = np.arange(len(items))
    for i in range(items.shape[1]):
        before, after = valid[live, i:i + width], valid[live, i + 1:i + 1 + width]
        step = row + (chars[live, i:i + width] != items[live, i][:, None])
        step[~(before & after)] = FAR
        step[:, :-1] = np.minimum(step[:, :-1], row[:, 1:] + 1)
        step[~after] = FAR
        row = np.minimum.accumulate(step - steps, axis=1) + steps
        row[~after] = FAR
        done = lengths[live] == i + 1
        out[live[done]] = row[done]
        on = ~done
        if i % 8 == 7:
            on &= row.min(axis=1) <= most[live]
        if not on.all():
            row, live = row[on], live[on]
        if not len(live):
            break
    return out


def align(items: list[np.ndarray], joined: np.ndarray, starts: np.ndarray, lengths: np.ndarray, low: np.ndarray,
          high: np.ndarray, most: np.ndarray) -> list[tuple[int, int, int] | None]:
    """Fewest edits, start and end of each item in its text on diagonals low to high; None beyond `most` edits.

    Text c is joined[starts[c]:starts[c] + lengths[c]].
    """
    sizes = np.array([len(i) for i in items])
    padded = np.zeros((len(items), sizes.max()), np.uint32)
    for row, item in zip(padded, items):
        row[:len(item)] = item

    def band(place: np.ndarray, top: np.ndarray, reverse: bool) -> tuple[np.ndarray, np.ndarray]:
        """Characters after the given places (before them, if reversed) and which places exist."""
        exists = (place >= 0) & (place <= top[:, None])
        at = starts[:, None] + (top[:, None] - 1 - place if reverse else place)
        return joined[np.clip(at, 0, len(joined) - 1)], exists

    width = int((high - low).max()) + 1
    chars, valid = band(low[:, None] + np.arange(sizes.max() + width + 1), lengths, False)
    rows = _last_rows(padded, sizes, chars, valid, np.where(valid[:, :width], 0, FAR).astype(np.int32), most)
    edits, best = rows.min(axis=1), rows.argmin(axis=1)
    out: list[tuple[int, int, int] | None] = [None] * len(items)
    hit = np.flatnonzero(edits <= most)
    if not len(hit):
        return out
    # From the end backwards, the diagonal that is reached at the same cost gives the start.
    end, widest = (low + best + sizes)[hit], int(most[hit].max())
    back = np.zeros_like(padded[hit])
    for row, c in zip(back, hit):
        row[:sizes[c]] = items[c][::-1]
    starts = starts[hit]
    places = np.arange(-widest, sizes.max() + widest + 2)[None, :].repeat(len(hit), 0)
    chars, valid = band(places, end, True)
    first = np.arange(-widest, widest + 1)
    first = np.where(first >= 0, first, FAR)[None, :].repeat(len(hit), 0).astype(np.int32)
    rows = _last_rows(back, sizes[hit], chars, valid, np.where(valid[:, :2 * widest + 1], first, FAR).astype(np.int32), most[hit])
    for c, row, stop in zip(hit, rows, end):
        taken = sizes[c] - widest + int(np.flatnonzero(row == edits[c])[0])
        out[c] = int(edits[c]), int(stop - taken), int(stop)
    return out


def _index_blocks(benchmark: DataFrame, id_col: str, text_col: str, share: float):
    """Broadcast indexes of the benchmark, one block after the other."""
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    times = F.when(F.length("text") > SEGMENT, 1 + SEGMENT // STEP).otherwise(1)
    chars = items.agg(F.coalesce(F.sum(F.length("text") * times), F.lit(0))).first()[0]
    blocks = -(-chars // BLOCK_CHARS)
    for n in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == n).collect()
        yield benchmark.sparkSession.sparkContext.broadcast(Index([(r.id, r.text) for r in rows], share))


def find(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text",
         item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, edits, and the place in the normalized text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, edits int, start int, end int"

    def with_index(index):
        def work(batches):
            for batch in batches:
                for part, _, _ in slices(batch, most=SLICE):
                    ids = part.column(0).to_pylist()
                    got = index.value.search([normalize(t) for t in part.column(1).to_pylist()])
                    columns = [[ids[t] for t, *_ in got], [index.value.ids[i] for _, i, *_ in got], *(
                        [g[n] for g in got] for n in (2, 3, 4))]
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                                     ["doc_id", "item_id", "edits", "start", "end"])
        return rows.mapInArrow(work, schema)

    found = [with_index(index) for index in _index_blocks(benchmark, item_id, item_text, share)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, text_col: str = "text",
                      item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """`docs`, all its columns, without the rows in which an item is found."""
    for index in _index_blocks(benchmark, item_id, item_text, share):
        def work(batches, index=index):
            for batch in batches:
                for part, _, _ in slices(batch, text_col, SLICE):
                    texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
                    keep = np.ones(part.num_rows, bool)
                    keep[[t for t, *_ in index.value.search([normalize(t) for t in texts])]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(work, docs.schema)
    return docs
