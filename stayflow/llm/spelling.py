"""Spelling variants: words that are one edit apart, found by dense comparison of tiles of words.

Words are runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lower-cased. Two words are near if one inserted, deleted or
replaced code point makes one of the other. With p code points of common prefix and s of common suffix, that is so
exactly if p + s is at least the longer length less one: a tile lays its words out as padded matrices of code points,
from the left and from the right, and compares them pair by pair, one column of all pairs at a time.

Which words share a tile: the edit lies in one of SEGMENTS parts of the longer word, so two near words agree in all that
stands before that part and all that stands after it. Every word is therefore filed under a hash of these two pieces, for
each part, once as the longer and once as the shorter word. What is filed under one key is compared in tiles of at most
TILE words or CELLS code points; a key with more is cut into blocks, and each two blocks make a tile. A near pair counts under the one key
whose part has the first place where the words differ, so no pair is found twice, and none is lost or capped.

Words are counted per task first and then by a grouping that combines on the map side, so a frequent word sends one row
per task. Chains of forms are followed by doubling: a form has at least twice the count, so a chain is at most some 40
words long.

No join may broadcast a side: all of them grow with the words, and Spark sizes what is filed like the stored words, though each
stands there under eight keys.

Null and empty texts have no words. Rows that repeat an id, and rows without one, are counted like others. A run as long
as a whole text is one word. A table without words gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayflow.llm.texts import _LOWER, Words, encoded, slices
from stayflow.session import work_dir

SEGMENTS = 4
TILE = 512
#: Code points compared at a time.
CELLS = 4 << 20
#: Different words, and bytes of long runs, that a task counts before it sends them on.
HELD_WORDS, HELD_BYTES = 200_000, 32 << 20
#: Longer runs are summed up one by one.
LONG_RUN = 64

_ASCII = np.zeros(256, bool)
_ASCII[ord("a"):ord("z") + 1] = True
_LEAD = 0xC3  # U+00C0 to U+00FF are this byte and one that follows it


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """Runs of letters of the encoded texts, and how many code points each has. A-Z are lower-cased in `data`."""
    data = _LOWER[data]
    lead = data == _LEAD
    inside = _ASCII[data] | lead
    inside[1:] |= lead[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    leads = np.concatenate([[0], np.cumsum(lead)])
    points = ends - starts - (leads[ends] - leads[starts])
    return Words(data, starts, ends, np.searchsorted(starts, offsets)), points


def crc_after(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each run data[starts:ends], continued from the crc32 in `before`."""
    lengths = ends - starts
    state = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    live = np.flatnonzero(lengths <= LONG_RUN)
    at = 0
    while len(live):
        now = state[live]
        state[live] = _CRC[(now ^ data[starts[live] + at]) & np.uint32(255)] ^ (now >> np.uint32(8))
        at += 1
        live = live[lengths[live] > at]
    out = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(lengths > LONG_RUN):
        out[i] = zlib.crc32(data[starts[i]:ends[i]].tobytes(), int(before[i]))
    return out


def _count_words(least_points: int, one_in: int):
    """Rows (word, n): how often each word occurs in this task, after the change of one run in `one_in`."""
    def sent(counts: Counter) -> pa.RecordBatch:
        words = pa.array([w.decode() for w in counts], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def work(batches):
        counts: Counter = Counter()
        held = 0
        for batch in batches:
            for rows, data, offsets in slices(batch):
                runs, points = letter_runs(data, offsets)
                enough = points >= least_points  # a shorter run gives no word, changed or not
                starts, ends, points = runs.starts[enough], runs.ends[enough], points[enough]
                raw = runs.data.tobytes()
                if one_in:
                    heads = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in rows.column(0).to_pylist()], np.uint32)
                    crc = crc_after(runs.data, starts, ends, heads[runs.owner()[enough]])
                    hit = crc % np.uint32(one_in) == 0
                    for a, b, at, n in zip(starts[hit].tolist(), ends[hit].tolist(), crc[hit].tolist(), points[hit].tolist()):
                        if n > least_points:
                            word, cut = raw[a:b].decode(), at % n
                            counts[(word[:cut] + word[cut + 1:]).encode()] += 1
                    starts, ends = starts[~hit], ends[~hit]
                counts.update([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())])
                lengths = ends - starts
                held += int(lengths[lengths > LONG_RUN].sum())
                if len(counts) > HELD_WORDS or held > HELD_BYTES:
                    yield sent(counts)
                    counts, held = Counter(), 0
        if counts:
            yield sent(counts)

    return work


def count_words(docs: DataFrame, least_points: int = 5, least_n: int = 3, one_in: int = 97, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """word and n for the words of at least `least_points` code points that occur `least_n` times in all texts.

    one_in: of every run whose crc32 after its row's id is a multiple of this, one code point is left out, which makes
    variants to be found; 0 leaves all runs as they are.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(_count_words(least_points, one_in), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def _bounds(longer, part: int):
    """Where a part of the longer word begins and ends."""
    return longer * part // SEGMENTS, longer * (part + 1) // SEGMENTS


def filed(words: DataFrame) -> DataFrame:
    """Rows (key, longer, part, word, n): each word under all keys it may share with a near word."""
    length = F.length("word")
    places = []
    for more in (0, 1):
        longer = length + more
        for part in range(SEGMENTS):
            low, high = (F.call_function("div", longer * k, F.lit(SEGMENTS)).cast("int") for k in (part, part + 1))
            after = longer - high
            key = F.xxhash64(F.lit(part), longer, F.substr("word", F.lit(1), low), F.substr("word", length - after + 1, after))
            places.append(F.struct(key.alias("key"), longer.alias("longer"), F.lit(part).alias("part")))
    return words.select(F.inline(F.array(*places)), "word", "n")


def tiles(words: DataFrame) -> DataFrame:
    """Rows (tile, side, longer, part, word, n), all rows of a tile in one task, one after the other."""
    rows = filed(words)
    is_longer = F.length("word") == F.col("longer")
    # A key whose words are all the shorter ones has nothing to compare: these meet as longer ones elsewhere.
    sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.count_if(is_longer).alias("longs")).where("size > 1 and longs > 0")
    shared = rows.join(sizes.select("key", "size").hint("merge"), "key")
    most = F.greatest(F.lit(1), F.least(F.lit(TILE), F.call_function("div", F.lit(CELLS), F.col("longer"))))
    ways = F.ceil(F.col("size") / most).cast("int")
    own = F.pmod(F.xxhash64("word"), ways).cast("int")

    def tile(j):
        side = F.when(j == F.col("own"), 3).when(j > F.col("own"), 1).otherwise(2)
        return F.struct(F.xxhash64("key", F.least("own", j), F.greatest("own", j)).alias("tile"), side.alias("side"))

    dealt = shared.withColumn("ways", ways).withColumn("own", own)
    dealt = dealt.select(F.inline(F.transform(F.sequence(F.lit(0), F.col("ways") - 1), tile)), "longer", "part", "word", "n")
    return dealt.repartition("tile").sortWithinPartitions("longer", "tile")


class Matrix:
    """Words of at most 255 different code points below 256, laid out from the left and from the right."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        lead = data == _LEAD
        points = np.where(np.concatenate([[False], lead[:-1]]), data + np.uint8(0x40), data)[~lead] if len(data) else data
        kept = np.concatenate([[0], np.cumsum(~lead)])
        self.points, self.first = points, kept[offsets]
        self.lengths = np.diff(self.first)

    def padded(self, which: np.ndarray, width: int, reverse: bool) -> np.ndarray:
        """Rows of `width` code points; beyond a word's end stands 0."""
        at, size = np.arange(width), self.lengths[which][:, None]
        place = size - 1 - at if reverse else np.broadcast_to(at, (len(which), width))
        inside = at < size
        found = self.points[np.where(inside, self.first[which][:, None] + place, 0)] if len(self.points) else np.zeros(place.shape, np.uint8)
        return np.where(inside, found, np.uint8(0))

    def common(self, left: np.ndarray, right: np.ndarray, reverse: bool) -> np.ndarray:
        """Code points that the words of each pair share from the left (or right) end on."""
        width = int(max(self.lengths[left].max(), self.lengths[right].max()))
        rows, at = np.unique(np.concatenate([left, right]), return_inverse=True)
        laid = self.padded(rows, width, reverse)
        a, b = at[:len(left)], at[len(left):]
        shared = np.zeros(len(left), np.int64)
        live = np.arange(len(left))
        for column in range(width):
            live = live[laid[a[live], column] == laid[b[live], column]]
            if not len(live):
                break
            shared[live] += 1
        # Padding that meets padding is no common code point.
        return np.minimum(shared, np.minimum(self.lengths[left], self.lengths[right]))


def near_pairs(matrix: Matrix, longer: np.ndarray, part: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs are one edit apart, with the first difference inside the part of their key."""
    # The part before is the same for both by the key, so the prefix tells already whether the place fits.
    prefix = matrix.common(left, right, reverse=False)
    low, high = _bounds(longer[left], part[left])
    fits = np.flatnonzero((prefix >= low) & (prefix < high))
    suffix = np.zeros(len(left), np.int64)
    if len(fits):
        suffix[fits] = matrix.common(left[fits], right[fits], reverse=True)
    out = np.zeros(len(left), bool)
    out[fits] = (prefix + suffix)[fits] >= longer[left][fits] - 1
    return out


def _compare(batches):
    """Rows (word, near, near_n), both ways, from rows that come tile by tile."""
    def found(rows: pa.Table) -> pa.RecordBatch:
        tile, side = (np.asarray(rows.column(c)) for c in ("tile", "side"))
        longer, part = (np.asarray(rows.column(c)).astype(np.int64) for c in ("longer", "part"))
        words = rows.column("word").combine_chunks()
        matrix = Matrix(*encoded(words))
        new = np.ones(len(tile), bool)
        new[1:] = tile[1:] != tile[:-1]
        begin = np.maximum.accumulate(np.where(new, np.arange(len(tile)), 0))
        ahead = np.arange(len(tile)) - begin  # rows of the tile before this one: its partners
        links = []
        # As many rows at a time as have CELLS code points to compare with their partners; one row at least.
        cost = np.cumsum(ahead * longer)
        at = 0
        while at < len(tile):
            base = cost[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(cost, base + CELLS, side="right")))
            many = ahead[at:to]
            right = np.repeat(np.arange(at, to), many)
            left = np.arange(len(right)) - np.repeat(np.cumsum(many) - many, many) + begin[right]
            meet = ((side[left] & 1 != 0) & (side[right] & 2 != 0)) | ((side[left] & 2 != 0) & (side[right] & 1 != 0))
            meet &= np.maximum(matrix.lengths[left], matrix.lengths[right]) == longer[left]
            left, right = left[meet], right[meet]
            if len(left):
                near = near_pairs(matrix, longer, part, left, right)
                links.append((left[near], right[near]))
            at = to
        a = np.concatenate([x for x, _ in links]) if links else np.zeros(0, np.int64)
        b = np.concatenate([x for _, x in links]) if links else np.zeros(0, np.int64)
        one, other = pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a]))
        return pa.RecordBatch.from_arrays([words.take(one), words.take(other), rows.column("n").combine_chunks().take(other)],
                                          ["word", "near", "near_n"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = pa.Table.from_batches(held)
        tile = np.asarray(rows.column("tile"))
        # The last tile may go on in the next batch.
        whole = len(tile) - int(np.argmax(tile[::-1] != tile[-1])) if (tile != tile[-1]).any() else 0
        if whole:
            yield found(rows.slice(0, whole))
            held = rows.slice(whole).to_batches()
    if held:
        yield found(pa.Table.from_batches(held))


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, form and form_n for the words of `words` (word, n) that have a near word.

    form is the near word of the largest n, of several the first in code-point order.
    """
    links = tiles(words).mapInArrow(_compare, "word string, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form")))
    return links.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")).select(
        "word", "n_near", F.col("best.form").alias("form"), (-F.col("best.minus")).alias("form_n"))


def group_variants(docs: DataFrame, least_points: int = 5, least_n: int = 3, one_in: int = 0, times: int = 2,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near and form_n for all words that `count_words` gives.

    form is the near word of largest count if that is `times` the word's own or more, else null; root is where the forms
    lead, the word itself if it has none.
    """
    spark = docs.sparkSession
    folder = work_dir(spark, "spelling")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    words = stored(count_words(docs, least_points, least_n, one_in, id_col, text_col), "words")
    near = near_words(words)
    accepted = F.col("form_n") >= F.col("n") * times
    formed = stored(words.join(near.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(accepted, F.col("form")).alias("form"), F.when(accepted, F.col("form_n")).alias("form_n")), "formed")
    # Each round replaces where a word leads by where that leads, until nothing leads on.
    steps, turn = formed.where("form is not null").select("word", F.col("form").alias("to")), 0
    while True:
        onward = steps.select(F.col("word").alias("to"), F.col("to").alias("beyond"))
        turn += 1
        moved = stored(steps.join(onward.hint("merge"), "to", "left").select(
            "word", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")), f"steps-{turn}")
        if moved.where("moved").isEmpty():
            break
        steps = moved.select("word", "to")
    roots = moved.select("word", F.col("to").alias("root"))
    return formed.join(roots.hint("merge"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
