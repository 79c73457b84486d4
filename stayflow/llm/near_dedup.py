"""Near-duplicate detection: MinHash bands, odd sketches, and a check on full shingle sets.

1. Every text becomes its set of word shingles (64-bit hashes), SAMPLES MinHash values in bands, an odd sketch (the
   MinHash samples folded into a parity bitmap: the ones in the XOR of two bitmaps grow with the samples that differ)
   and a parity bitmap of the whole set. Texts with the same set are one class; only classes are compared.
2. Classes that share a band are in one bucket. Each is first compared with the bucket's smallest class (a star), which
   links large groups of copies in one linear pass.
3. Then labels of components are spread, and only buckets that still hold several components are looked at again, in
   blocks of BLOCK classes: those outside the bucket's main component against all others. Of each pair of components
   the likeliest pairs of classes go on, one in the first round and 64 times as many in each later one, until no
   candidate is left untested. So no group is expanded into all its pairs, and no candidate is given up.

A candidate has to pass the size bound, the odd sketch (rejecting what lies beyond 6.5 deviations of the threshold), the
parity bitmap (each differing shingle flips one bit, so more ones than differences allowed prove that there is no
link), and then the comparison of the full sets. What can be lost is a pair at the threshold that shares no band: with
32 bands of 4 below 1e-7 at 0.8, and below 1e-10 at 0.85.

A null or empty text has no shingles and is linked with nothing; a text shorter than a shingle is one shingle. Rows that
repeat an id are texts of their own. Rows without an id are linked with nothing and kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayflow.llm.components import smallest_reachable
from stayflow.llm.texts import fresh, mix, slices, split_words, window_hashes
from stayflow.session import work_dir

BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
ODD_BITS, PARITY_BITS = 512, 1024
BLOCK = 1024
LEFT_ROWS = 64
SLICE = 1 << 19

_KEYS = mix(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 31)
_SKETCH = "n long, set_id binary, bands array<long>, odd binary, parity binary"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different shingle hashes of each text, and where each text's begin."""
    words = split_words(data, offsets, lower=True)
    hashes, owner, counts = words.hashes(), words.owner(), words.counts
    values = [window_hashes(hashes, length, 17)]
    texts = [owner[:len(values[0])]]
    at = np.arange(len(values[0])) - words.first[texts[0]]
    whole = at + length <= counts[texts[0]]
    values, texts = [values[0][whole]], [texts[0][whole]]
    for size in range(1, length):
        short = np.flatnonzero(counts == size)
        if len(short):
            values.append(window_hashes(hashes, size, 17 + size)[words.first[short]])
            texts.append(short)
    value, text = np.concatenate(values), np.concatenate(texts)
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[new], text[new]
    return value, np.searchsorted(text, np.arange(len(offsets)))


def _binaries(rows: np.ndarray) -> pa.Array:
    """One binary value per row of a matrix."""
    rows = np.ascontiguousarray(rows)
    width = rows.dtype.itemsize * rows.shape[1]
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _bitmaps(bit: np.ndarray, row: np.ndarray, rows: int, bits: int) -> np.ndarray:
    """Parity of how often each bit is set, per row, in words of 64 bits."""
    flips = np.bincount(row * bits + bit, minlength=rows * bits) & 1
    return np.packbits(flips.astype(bool).reshape(rows, bits), axis=1, bitorder="little").view(np.uint64)


def _set_ids(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128 bits that equal sets share, for texts that are not empty."""
    return np.stack([mix(np.add.reduceat(mix(value, s), first), s) for s in (41, 42)], axis=1)


def _sketches(length: int):
    def work(batches):
        for batch in batches:
            for rows, data, offsets in slices(batch, most=SLICE):
                value, first = shingle_sets(data, offsets, length)
                sizes = np.diff(first)
                full = np.flatnonzero(sizes)
                ids = rows.column(0)
                if len(full):
                    begin, m = first[full], len(full)
                    least = np.empty((SAMPLES, m), np.uint64)
                    for i in range(SAMPLES):
                        least[i] = np.minimum.reduceat((value ^ _KEYS[2 * i]) * (_KEYS[2 * i + 1] | np.uint64(1)), begin)
                    least = least.T
                    bands = np.zeros((m, BANDS), np.uint64)
                    for k in range(ROWS):
                        bands = mix(bands + least[:, k::ROWS], 60 + k)
                    bands = mix(bands + np.arange(BANDS, dtype=np.uint64), 59)
                    sample = mix(least + np.arange(SAMPLES, dtype=np.uint64), 51) % np.uint64(ODD_BITS)
                    odd = _bitmaps(sample.ravel().astype(np.int64), np.repeat(np.arange(m), SAMPLES), m, ODD_BITS)
                    bit = (mix(value, 52) % np.uint64(PARITY_BITS)).astype(np.int64)
                    parity = _bitmaps(bit, np.repeat(np.arange(m), sizes[full]), m, PARITY_BITS)
                    listed = pa.ListArray.from_arrays(np.arange(m + 1, dtype=np.int32) * BANDS, bands.ravel().view(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(full)), pa.array(sizes[full]), _binaries(_set_ids(value, begin)), listed, _binaries(odd), _binaries(parity)],
                        ["doc_id", "n", "set_id", "bands", "odd", "parity"])
                none = np.flatnonzero(sizes == 0)
                if len(none):
                    null = [pa.nulls(len(none), t) for t in (pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary())]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(none)), pa.array(np.zeros(len(none), np.int64)), *null],
                                                     ["doc_id", "n", "set_id", "bands", "odd", "parity"])
    return work


def _full_sets(length: int):
    """Rows of doc_id, text, set_id to set_id, hashes; texts of a repeated id that have another set are passed over."""
    def work(batches):
        for batch in batches:
            for rows, data, offsets in slices(batch, most=SLICE):
                value, first = shingle_sets(data, offsets, length)
                full = np.flatnonzero(np.diff(first))
                if not len(full):
                    continue
                own = [x.tobytes() for x in _set_ids(value, first[full])]
                wanted = rows.column(2).to_pylist()
                same = [(t, s) for t, s in zip(full.tolist(), own) if wanted[t] == s]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s for _, s in same], pa.binary()), pa.array([value[first[t]:first[t + 1]].tobytes() for t, _ in same], pa.binary())],
                    ["set_id", "hashes"])
    return work


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), width)


class _Bounds:
    """What a pair has to pass at a threshold in percent."""

    def __init__(self, percent: int):
        t = percent / 100
        self.percent = percent
        self.odd = 2 * math.ceil(SAMPLES * (1 - t) + 6.5 * math.sqrt(SAMPLES * t * (1 - t)))

    def likely(self, n1, odd1, parity1, n2, odd2, parity2) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs may be linked, and how many parity bits differ."""
        size = np.minimum(n1, n2) * 100 >= np.maximum(n1, n2) * self.percent
        sampled = np.bitwise_count(odd1 ^ odd2).sum(axis=-1) <= self.odd
        differ = np.bitwise_count(parity1 ^ parity2).sum(axis=-1).astype(np.int64)
        return size & sampled & (differ * (100 + self.percent) <= (n1 + n2) * (100 - self.percent)), differ

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        common = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * common >= self.percent * (len(a) + len(b) - common)


def _likely_rows(bounds: _Bounds):
    def work(batches):
        for batch in batches:
            n = [np.asarray(batch.column(c)) for c in (2, 5)]
            odd = [_matrix(batch.column(c), ODD_BITS // 64) for c in (3, 6)]
            parity = [_matrix(batch.column(c), PARITY_BITS // 64) for c in (4, 7)]
            keep, _ = bounds.likely(n[0], odd[0], parity[0], n[1], odd[1], parity[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))
    return work


def _linked_rows(bounds: _Bounds):
    def work(batches):
        for batch in batches:
            pairs = zip(batch.column(2), batch.column(3))
            keep = [bounds.linked(*(np.frombuffer(x.as_buffer(), np.uint64) for x in pair)) for pair in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keep, pa.bool_())], ["a", "b", "linked"])
    return work


def _best(found: list[np.ndarray], most: int) -> list[np.ndarray]:
    """Arrays (low, high, score, a, b): the `most` first rows of each (low, high), ordered by score and place."""
    order = np.lexsort((found[4], found[3], found[2], found[1], found[0]))
    found = [x[order] for x in found]
    new = np.ones(len(order), bool)
    new[1:] = (found[0][1:] != found[0][:-1]) | (found[1][1:] != found[1][:-1])
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return [x[rank < most] for x in found] + [rank[rank < most]]


def _block_rows(bounds: _Bounds, most: int):
    """Likely pairs across components in each block; `more` tells that a pair of components has more than `most`.

    The block is compared in slices of LEFT_ROWS rows against all others, as arrays; after each slice only the likeliest pairs
    of each two components are held.
    """
    def pairs_of(rows: pa.Table) -> pa.RecordBatch:
        side = np.asarray(rows.column("side"))
        label, n = rows.column("label").combine_chunks(), np.asarray(rows.column("n"))
        fields = label.flatten() if pa.types.is_struct(label.type) else [label]
        _, group = np.unique(np.stack([np.asarray(f) for f in fields], axis=1), axis=0, return_inverse=True)
        odd = _matrix(rows.column("odd").combine_chunks(), ODD_BITS // 64)
        parity = _matrix(rows.column("parity").combine_chunks(), PARITY_BITS // 64)
        left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
        kept = [np.zeros(0, t) for t in (np.int64, np.int64, np.float64, np.int64, np.int64)]
        for at in range(0, len(left), LEFT_ROWS):
            i = left[at:at + LEFT_ROWS]
            # Rows that are on both sides meet once only.
            apart = (group[i][:, None] != group[right]) & ~((side[i] == 3)[:, None] & (side[right] == 3) & (i[:, None] >= right))
            x, y = np.nonzero(apart)
            i, j = i[x], right[y]
            found = []
            for part in range(0, len(i), LEFT_ROWS * BLOCK // 8):
                a, b = i[part:part + LEFT_ROWS * BLOCK // 8], j[part:part + LEFT_ROWS * BLOCK // 8]
                ok, differ = bounds.likely(n[a], odd[a], parity[a], n[b], odd[b], parity[b])
                a, b = a[ok], b[ok]
                found.append((np.minimum(group[a], group[b]), np.maximum(group[a], group[b]), differ[ok] / (n[a] + n[b]), np.minimum(a, b), np.maximum(a, b)))
            # Rows come in order of set_id, so the place stands for it.
            kept = _best([np.concatenate([k, *(f[c] for f in found)]) for c, k in enumerate(kept[:5])], most + 1)
        low, high, _, a, b, rank = kept if len(kept) == 6 else _best(kept, most + 1)
        over = np.zeros(len(low), bool)
        if len(low):
            pair = np.cumsum(np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]))) - 1
            full = np.zeros(pair[-1] + 1, bool)
            full[pair[rank == most]] = True
            over = full[pair]
        keep = rank < most
        ids = rows.column("set_id").combine_chunks()
        return pa.RecordBatch.from_arrays([ids.take(pa.array(a[keep])), ids.take(pa.array(b[keep])), pa.array(over[keep])], ["a", "b", "more"])

    def work(batches):
        held, key = [], None

        for batch in batches:
            if not batch.num_rows:
                continue
            task = np.asarray(batch.column(0))
            cuts = np.concatenate([[0], np.flatnonzero(task[1:] != task[:-1]) + 1, [len(task)]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                if held and key != task[a]:
                    yield pairs_of(pa.Table.from_batches(held))
                    held = []
                key = task[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield pairs_of(pa.Table.from_batches(held))
    return work


def _unsettled(members: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (bucket, set_id, start, label, main) of the buckets that still hold several components."""
    labeled = members.join(found, "set_id", "left").select("bucket", "set_id", "start", F.coalesce("found", "start").alias("label"))
    state = labeled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min_by("label", "set_id").alias("main"))
    return labeled.join(state.where("low < high").select("bucket", "main"), "bucket")


def _blocks(mixed: DataFrame, sketches: DataFrame) -> DataFrame:
    """Rows of unsettled buckets, dealt out to blocks; side 1 is compared with side 2."""
    sizes = mixed.groupBy("bucket").agg(F.count_if(F.col("label") == F.col("main")).alias("inside"), F.count_if(F.col("label") != F.col("main")).alias("outside"))
    rows = mixed.join(sizes, "bucket")
    ways = {c: F.ceil(F.col(c) / BLOCK).cast("int") for c in ("inside", "outside")}
    rows = rows.select("bucket", "set_id", "label", (F.col("label") == F.col("main")).alias("is_main"), *(w.alias(c) for c, w in ways.items()))
    own = F.pmod(F.xxhash64("set_id"), F.when(F.col("is_main"), F.col("inside")).otherwise(F.col("outside"))).cast("int")
    rows = rows.withColumn("own", own)
    task = lambda kind, i, j, side: F.struct(F.xxhash64("bucket", F.lit(kind), i, j).alias("task"), F.lit(side).alias("side") if isinstance(side, int) else side.alias("side"))
    main = F.transform(F.sequence(F.lit(0), F.col("outside") - 1), lambda j: task(0, F.col("own"), j, 1))
    outer = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("inside") - 1), lambda i: task(0, i, F.col("own"), 2)),
        F.transform(F.sequence(F.lit(0), F.col("outside") - 1), lambda j: task(
            1, F.least("own", j), F.greatest("own", j), F.when(j == F.col("own"), 3).when(j > F.col("own"), 1).otherwise(2))))
    dealt = rows.withColumn("to", F.explode(F.when(F.col("is_main"), main).otherwise(outer)))
    dealt = dealt.select("to.task", "to.side", "set_id", "label").join(sketches.select("set_id", "n", "odd", "parity"), "set_id")
    dealt = dealt.select("task", "side", "set_id", "label", "n", "odd", "parity")
    return dealt.repartition("task").sortWithinPartitions("task", "set_id")


def components(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that can be reached by links) and kept, for every row.

    Ids are whole numbers, or structs of them. Other columns of `docs` are not used, whatever their names.
    """
    spark, bounds = docs.sparkSession, _Bounds(percent)
    folder = work_dir(spark, "near-dedup")
    own = F.col(id_col) if isinstance(docs.schema[id_col].dataType, T.StructType) else F.col(id_col).cast("long")
    rows = docs.select(own.alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    every = stored(rows.mapInArrow(_sketches(shingle_words), f"doc_id {kind}, {_SKETCH}"), "sketches")
    first = F.min_by(F.struct("n", "bands", "odd", "parity"), "doc_id").alias("of")
    classes = every.where("n > 0 and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("label"), first)
    classes = stored(classes.select("set_id", "label", "of.*"), "classes")
    banded = classes.select("set_id", "label", F.explode("bands").alias("bucket"))
    several = banded.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct("label", "set_id")).alias("lead")).where("size > 1")
    members = stored(banded.join(several, "bucket").select("bucket", "set_id", F.col("label").alias("start"), "lead"), "members")
    needed = members.select("set_id").distinct().join(classes.select("set_id", F.col("label").alias("first_id")), "set_id")
    texts = rows.where("doc_id is not null").join(needed, F.col("doc_id") == F.col("first_id")).select("doc_id", "text", "set_id")
    sets = stored(texts.mapInArrow(_full_sets(shingle_words), "set_id binary, hashes binary").dropDuplicates(["set_id"]), "sets")

    def tested(pairs: DataFrame, name: str, filtered: bool) -> DataFrame:
        """pairs (a, b) with linked, from the full sets; pairs that the sketches rule out are left out."""
        of = lambda c, *cols: [F.col("set_id").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in cols)]
        if not filtered:
            info = ("n", "odd", "parity")
            pairs = pairs.join(classes.select(of("a", *info)), "a").join(classes.select(of("b", *info)), "b")
            pairs = pairs.select("a", "b", *(f"{x}_a" for x in info), *(f"{x}_b" for x in info)).mapInArrow(_likely_rows(bounds), "a binary, b binary")
        pairs = pairs.join(sets.select(of("a", "hashes")), "a").join(sets.select(of("b", "hashes")), "b")
        return stored(pairs.select("a", "b", "hashes_a", "hashes_b").mapInArrow(_linked_rows(bounds), "a binary, b binary, linked boolean"), name)

    star = members.where(F.col("set_id") != F.col("lead.set_id")).select(F.col("lead.set_id").alias("a"), F.col("set_id").alias("b")).distinct()
    results = tested(star, "star", filtered=False)
    links = results.where("linked")
    nodes = classes.select(F.col("set_id").alias("node"), "label")
    most, turn, mixed = 1, 0, members
    while True:
        found = smallest_reachable(nodes, links).select(F.col("node").alias("set_id"), F.col("label").alias("found"))
        turn += 1
        mixed = stored(_unsettled(mixed, found), f"mixed-{turn}")  # a settled bucket stays settled
        likely = _blocks(mixed, classes).mapInArrow(_block_rows(bounds, most), "a binary, b binary, more boolean")
        likely = stored(likely.groupBy("a", "b").agg(F.max("more").alias("more")), f"likely-{turn}")
        new = likely.join(results.select("a", "b"), ["a", "b"], "left_anti").join(
            results.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
        fresh = tested(new.select("a", "b"), f"tested-{turn}", filtered=True)
        if fresh.isEmpty() and likely.where("more").isEmpty():
            break
        results = results.unionByName(fresh)
        links = results.where("linked")
        most *= 64
    labels = stored(classes.select("set_id", "label").join(found, "set_id", "left").select(
        "set_id", F.coalesce("found", "label").alias("label")), "labels")
    marked = every.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("set_id")).alias("of_set"))
    joined = marked.join(labels, F.col("of_set") == F.col("set_id"), "left")
    component = F.coalesce("label", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
                    as_read: bool = False) -> DataFrame:
    """`docs`, all its columns, with one row of each component, whatever the ids: every row gets a key of its own.

    The row with the smallest id stays, of several with this id any one; rows without an id stand behind all others.
    Rows without shingles (null or empty text) all stay.

    as_read: `docs` comes from files, with filters or projections at most. Then a row's file and its place in it are its key;
    otherwise the rows are written once, so that a key stays with its row.
    """
    spark = docs.sparkSession
    key, absent = fresh(docs, "row_key", "absent")
    keyed = None
    if as_read:
        try:
            keyed = docs.withColumn(key, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")))
        except AnalysisException:
            pass  # not from files
    if keyed is None:
        folder = work_dir(spark, "near-dedup-rows")
        docs.withColumn(key, F.monotonically_increasing_id()).write.parquet(folder)
        keyed = spark.read.parquet(folder)
    of = components(keyed, shingle_words, percent, key, text_col).select(F.col("doc_id").alias(key), "component_id")
    ids = keyed.select(key, F.col(id_col).isNull().alias(absent), F.col(id_col).alias("first_id"))
    first = ids.join(of, key).groupBy("component_id").agg(F.min(F.struct(absent, "first_id", key)).alias("first"))
    return keyed.join(first.select(F.col(f"first.{key}").alias(key)), key, "left_semi").select(docs.columns)
