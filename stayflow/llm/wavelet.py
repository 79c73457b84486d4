"""Token files: texts are encoded and kept as one wavelet matrix per shard, with lookups from the compressed file.

A wavelet matrix keeps one bit-plane per bit of an id, highest first; after each plane the ids are stably split into
those with 0 and those with 1. Counts of ones per block give rank and select, and with them: the id at a place, how
often an id occurs before a place, and where its k-th occurrence is. Planes and block counts are compressed one by one.

Shards hold whole documents in ascending order of id. Spark deals the documents out by ranges of the id, each task
encodes its range in parts of SHARD_TOKENS ids (a longer document is a shard of its own), and the shards are written
as binary rows of a Parquet table in a shared folder, so a task that runs again writes the same rows. Where a shard
starts in the whole sequence follows from one sum per range.

Null and empty texts are encoded as the end id alone. Rows with a null id come first; rows that repeat an id follow
one another. An empty table gives no shards.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stayflow.llm.texts import _LOWER, Words, slices, split_words

MAGIC = b"WVM1"
BLOCK = 512
SHARD_TOKENS = 1 << 20
#: Units whose ids a process remembers: some 30 MB.
CACHE_UNITS = 800_000
JOINED_UNITS = 64
#: A character that is one token of its own, put between units.
MARK = "\x01"
SHARD_SCHEMA = "part int, seq int, before long, n_docs long, n_tokens long, file binary"

#: 1 ASCII letters, 2 other visible ASCII characters, 3 ASCII digits, 0 all else.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 2
_KIND[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = 1
_KIND[ord("0"):ord("9") + 1] = 3


def _pack(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(array).tobytes())


def _unpack(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


class WaveletMatrix:
    """Ids of a shard. Planes are unpacked when they are first needed."""

    def __init__(self, n: int, zeros: list[int], planes: list[tuple[bytes, bytes]]):
        self.n, self.zeros, self.packed = n, zeros, planes
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        kind = np.uint16 if width <= 16 else np.uint32
        ids = ids.astype(kind)
        zeros, planes = [], []
        for level in range(width):
            ones = (ids & kind(1 << width - 1 - level)) != 0
            blocks = np.add.reduceat(ones, np.arange(0, len(ids), BLOCK), dtype=np.uint16) if len(ids) else np.zeros(0, np.uint16)
            planes.append((_pack(np.packbits(ones, bitorder="little")), _pack(blocks)))
            low = ids[~ones]
            zeros.append(len(low))
            ids = np.concatenate([low, ids[ones]])
        return cls(len(ids), zeros, planes)

    @property
    def width(self) -> int:
        return len(self.zeros)

    def _plane(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        if level not in self.open:
            bits, blocks = self.packed[level]
            counts = np.concatenate([[0], np.cumsum(_unpack(blocks, np.uint16), dtype=np.int64)])
            self.open[level] = _unpack(bits, np.uint8), counts
        return self.open[level]

    def _ones(self, level: int, at: int) -> int:
        """Ones of a plane before a place."""
        bits, counts = self._plane(level)
        block = at // BLOCK
        part = bits[block * BLOCK // 8:at // 8]
        rest = int(bits[at // 8]) & ((1 << at % 8) - 1) if at % 8 else 0
        return int(counts[block]) + int(np.bitwise_count(part).sum()) + rest.bit_count()

    def _find(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of a plane that equals `bit`."""
        bits, counts = self._plane(level)
        upto = counts if bit else np.minimum(np.arange(len(counts)) * BLOCK, self.n) - counts
        block = int(np.searchsorted(upto, k, side="right")) - 1
        inside = np.unpackbits(bits[block * BLOCK // 8:(block + 1) * BLOCK // 8], bitorder="little")
        inside = inside[:min(BLOCK, self.n - block * BLOCK)]
        return block * BLOCK + int(np.flatnonzero(inside == bit)[k - int(upto[block])])

    def access(self, at: int) -> int:
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level in range(self.width):
            bit = int(self._plane(level)[0][at // 8]) >> at % 8 & 1
            ones = self._ones(level, at)
            at = self.zeros[level] + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, upto: int) -> tuple[int, int]:
        """Where a token's occurrences before `upto` lie in the order after the last plane."""
        lo, hi = 0, upto
        for level in range(self.width):
            a, b = self._ones(level, lo), self._ones(level, hi)
            one = token >> self.width - 1 - level & 1
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if one else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, at: int) -> int:
        """Occurrences of a token before a place."""
        if token < 0 or token >> self.width:
            return 0
        lo, hi = self._range(token, min(at, self.n))
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence, from 0."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        at = self._range(token, self.n)[0] + k
        for level in reversed(range(self.width)):
            one = token >> self.width - 1 - level & 1
            at = self._find(level, one, at - self.zeros[level] if one else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids, from the last plane up."""
        kind = np.uint16 if self.width <= 16 else np.uint32
        ids = np.zeros(self.n, kind)
        for level in reversed(range(self.width)):
            ones = np.unpackbits(self._plane(level)[0], count=self.n, bitorder="little").astype(bool)
            before = np.empty_like(ids)
            before[~ones] = ids[:self.zeros[level]]
            before[ones] = ids[self.zeros[level]:] | kind(1 << self.width - 1 - level)
            ids = before
        return ids.astype(np.uint32)


class Shard:
    """One file: document ids, where each document starts, and the wavelet matrix of all their tokens."""

    def __init__(self, doc_ids: pa.Array, starts: np.ndarray, tokens: WaveletMatrix):
        self.doc_ids, self.starts, self.tokens = doc_ids, starts, tokens

    def document(self, i: int) -> np.ndarray:
        return np.array([self.tokens.access(k) for k in range(self.starts[i], self.starts[i + 1])], np.uint32)

    def to_bytes(self) -> bytes:
        m = self.tokens
        valid = np.asarray(self.doc_ids.is_valid())
        parts = [_pack(np.asarray(self.doc_ids.fill_null(0), np.int64)), _pack(valid), _pack(np.diff(self.starts).astype(np.int64))]
        parts += [p for plane in m.packed for p in plane]
        head = struct.pack(f"<QQB{m.width}Q{len(parts)}Q", m.n, len(self.doc_ids), m.width, *m.zeros, *map(len, parts))
        return MAGIC + head + b"".join(parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Shard:
        if raw[:4] != MAGIC:
            raise ValueError("not a token shard")
        n, _, width = struct.unpack_from("<QQB", raw, 4)
        zeros = list(struct.unpack_from(f"<{width}Q", raw, 21))
        sizes = struct.unpack_from(f"<{3 + 2 * width}Q", raw, 21 + 8 * width)
        ends = np.cumsum(sizes) + 21 + 8 * width + 8 * len(sizes)
        parts = [raw[e - s:e] for s, e in zip(sizes, ends)]
        ids = pa.array(_unpack(parts[0], np.int64), mask=~_unpack(parts[1], bool))
        starts = np.concatenate([[0], np.cumsum(_unpack(parts[2], np.int64))])
        return cls(ids, starts, WaveletMatrix(n, zeros, list(zip(parts[3::2], parts[4::2]))))


class Known:
    """Ids of units of text, found by their 64-bit hash: one sorted array, so that only new units reach Python."""

    def __init__(self):
        self.hashes, self.begins, self.lengths = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def absent(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        return self.hashes[at] != hashes if len(self.hashes) else np.ones(len(hashes), bool)

    def add(self, hashes: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> None:
        begins = np.cumsum(lengths) - lengths + len(self.flat)
        order = np.argsort(np.concatenate([self.hashes, hashes]), kind="stable")
        self.hashes, self.begins, self.lengths = (
            np.concatenate(both)[order] for both in ((self.hashes, hashes), (self.begins, begins), (self.lengths, lengths)))
        self.flat = np.concatenate([self.flat, flat])


_LOADED: dict[str, tuple[object, Known]] = {}


def _loaded(path: str):
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path), Known()
    return _LOADED[path]


def _encode_units(tokenizer, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all units in one array, and how many each has: texts of several units, told apart by a mark between them."""
    mark = tokenizer.encode(MARK, add_special_tokens=False).ids
    if len(mark) != 1 or any(MARK in u for u in units):
        found = [e.ids for e in tokenizer.encode_batch(units, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)
    texts = [f" {MARK} ".join(units[at:at + JOINED_UNITS]) + f" {MARK}" for at in range(0, len(units), JOINED_UNITS)]
    found = [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    flat = np.concatenate(found) if found else np.zeros(0, np.uint32)
    ends = np.flatnonzero(flat == mark[0])
    return flat[flat != mark[0]], np.diff(ends, prepend=-1) - 1


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """Words, cut further where the tokenizer cuts them for sure, and the first unit of each text.

    That is between an ASCII letter and an ASCII mark (but not between an apostrophe and a letter, which may be a contraction) and around
    ASCII digits. Capitals that no byte of another character follows are lower-cased, as the tokenizer does. Words with
    the opening of a special token stay as they are.
    """
    words = split_words(data, offsets)
    if not len(words.starts):
        return words, words.first
    special = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|"))) if len(data) > 1 else np.zeros(0, np.int64)
    whole = np.zeros(len(data) + 1, np.int8)
    odd = np.unique(np.searchsorted(words.starts, special, side="right") - 1)
    odd = odd[odd >= 0]
    whole[words.starts[odd]] += 1
    whole[words.ends[odd]] -= 1
    free = np.cumsum(whole[:-1], dtype=np.int8) == 0
    after = np.append(data[1:], np.uint8(0))
    lowered = np.where(free & (after < 128), _LOWER[data], data)
    kind = _KIND[data]
    a, b = kind[:-1], kind[1:]
    cut = (a != b) & (((a == 1) & (b == 2)) | ((a == 2) & (b == 1) & (data[:-1] != ord("'"))))
    cut |= (a == 3) | (b == 3)
    cut &= free[:-1] & (a > 0) & (b > 0)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    cut &= ~edge[1:-1]
    inner = np.flatnonzero(cut) + 1
    starts, ends = np.sort(np.concatenate([words.starts, inner])), np.sort(np.concatenate([words.ends, inner]))
    return Words(lowered, starts, ends, np.searchsorted(starts, offsets)), np.searchsorted(starts, offsets)


def encode(path: str, data: np.ndarray, offsets: np.ndarray, by_word: bool) -> list[np.ndarray]:
    """Ids of the UTF-8 texts data[offsets[i]:offsets[i + 1]].

    by_word: the tokenizer lower-cases, drops white space and encodes words and marks apart, so that each of these units can be
    encoded by itself, and once for all the places where the texts have it (found by 64-bit hash).
    """
    tokenizer, known = _loaded(path)
    if not by_word:
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:])]
        return [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    units, first_of = _units(data, offsets)
    kinds, first, which = np.unique(units.hashes(), return_index=True, return_inverse=True)
    new = known.absent(kinds)
    if len(known.hashes) + int(new.sum()) > CACHE_UNITS:  # it starts anew
        new = np.ones(len(kinds), bool)
        known.__init__()
    raw = units.data.tobytes()
    fresh = [raw[a:b].decode() for a, b in zip(units.starts[first[new]].tolist(), units.ends[first[new]].tolist())]
    if fresh:
        known.add(kinds[new], *_encode_units(tokenizer, fresh))
    at = np.searchsorted(known.hashes, kinds)
    begins, lengths = known.begins[at], known.lengths[at]
    each = lengths[which]
    ends = np.concatenate([[0], np.cumsum(each)])
    ids = known.flat[np.repeat(begins[which] - ends[:-1], each) + np.arange(ends[-1])]
    cuts = ends[first_of]
    return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def _build(path: str, end_id: int, by_word: bool):
    def row(part, seq, before, ids, tokens):
        lengths = [len(t) for t in tokens]
        matrix = WaveletMatrix.build(np.concatenate(tokens))
        shard = Shard(pa.array(ids, pa.int64()), np.concatenate([[0], np.cumsum(lengths)]), matrix)
        values = [part], [seq], [before], [len(ids)], [matrix.n], [shard.to_bytes()]
        kinds = pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()
        names = ["part", "seq", "before", "n_docs", "n_tokens", "file"]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names)

    def work(batches):
        part, seq, before, held = TaskContext.get().partitionId(), 0, 0, 0
        ids, tokens, end = [], [], np.array([end_id], np.uint32)
        for batch in batches:
            for rows, data, offsets in slices(batch):
                for doc_id, found in zip(rows.column(0).to_pylist(), encode(path, data, offsets, by_word)):
                    if tokens and held + len(found) + 1 > SHARD_TOKENS:
                        yield row(part, seq, before, ids, tokens)
                        seq, before, held, ids, tokens = seq + 1, before + held, 0, [], []
                    ids.append(doc_id)
                    tokens.append(np.concatenate([found, end]))
                    held += len(found) + 1
        if tokens:
            yield row(part, seq, before, ids, tokens)

    return work


def write_shards(docs: DataFrame, folder: str, path: str, end_id: int, by_word: bool = False,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all texts in ascending order of id and write the shards to `folder`."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_build(path, end_id, by_word), SHARD_SCHEMA).write.parquet(folder)


def _summaries(batches):
    for batch in batches:
        for start, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            shard = Shard.from_bytes(raw.as_py())
            tokens = shard.tokens.decode().astype("<u4").tobytes()
            view, at = memoryview(tokens), shard.starts
            sums = [zlib.crc32(view[4 * a:4 * b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [shard.doc_ids, pa.array(at[:-1] + start, pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(sums, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: where it starts among all ids, how many it has and the crc32 of their bytes."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(folder)
    # One row per range of ids, as many as the writing job had tasks.
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    placed = shards.join(F.broadcast(bases), "part").select((F.col("base") + F.col("before")).alias("start"), "file")
    return placed.mapInArrow(_summaries, "doc_id long, start long, n_tokens long, ids_crc32 long")
