"""Words of whole texts, as column expressions and as numpy arrays over Arrow batches.

A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
None of these six bytes occurs inside a longer UTF-8 sequence, so words can be cut on the encoded bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that numpy works on at a time; a longer text is one slice of its own.
SLICE_BYTES = 2 << 20
HASHED_BYTES = 1 << 18
#: Rows in an Arrow batch: bounds what a task holds when texts are long.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in SPACES]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def word_count(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo `divisor`: the folds of the classifiers. A null id gives null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread 64-bit values so that all their bits depend on all bits of the input."""
    h = h ^ np.uint64(seed * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@dataclass
class Words:
    """The words of some texts. Text i has the words first[i] up to first[i + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lengths = self.ends - self.starts
        upto = np.cumsum(lengths)
        powers = _powers(_MULTIPLIER, int(lengths.max()))
        out, first = np.empty(len(lengths), np.uint64), 0
        while first < len(lengths):  # some bytes at a time: the places of all of them take several times the text
            done = int(upto[first - 1]) if first else 0
            to = max(first + 1, int(np.searchsorted(upto, done + HASHED_BYTES, side="right")))
            size = lengths[first:to]
            begin = np.cumsum(size) - size
            within = np.arange(int(size.sum())) - np.repeat(begin, size)
            values = _BYTES[self.data[within + np.repeat(self.starts[first:to], size)]] * powers[within]
            out[first:to] = np.add.reduceat(values, begin)
            first = to
        return mix(out)


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Cut the encoded texts data[offsets[i]:offsets[i + 1]] into words."""
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (~before[:-1] | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def window_hashes(hashes: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Hash of the `length` consecutive values from each place on, by differences of a running polynomial."""
    n = len(hashes)
    if n < length:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(hashes, seed) * _powers(_MULTIPLIER, n), out=total[1:])
    return mix((total[length:] - total[:n - length + 1]) * _powers(_INVERSE, n - length + 1), seed)


def encoded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where each text starts and ends; null is an empty text."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text",
           most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with at most `most` bytes of text (or one row): the rows, their bytes, their offsets."""
    data, offsets = encoded(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        to = min(to, n)
        yield batch.slice(at, to - at), data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def bounded_sample(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """At most `most` rows, chosen by a hash of `key` evenly over the whole table."""
    total = rows.count()
    order = F.xxhash64(key, F.lit(20_011))
    if total > most:
        share = min(1.0, 1.2 * most / total + 50 / total)
        rows = rows.where(F.pmod(order, F.lit(1_000_000)) < int(1_000_000 * share) + 1)
    return rows.orderBy(order, key).limit(most)


def fresh(rows: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of `rows` has, so that helper columns never clash with the caller's."""
    taken = {c.lower() for c in rows.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def digest60(*parts: Column) -> Column:
    """A number below 2 ** 60 from the md5 of the parts as text, joined by a bar; null counts as empty."""
    joined = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def let(value: Column, then) -> Column:
    """`then` applied to a column that is evaluated once, however often `then` mentions it."""
    return F.element_at(F.transform(F.array(value), then), 1)
