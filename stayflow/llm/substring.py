"""Substring dedup: remove passages that an earlier document has already.

A window of `window` words in a document goes if the same words also start somewhere in a document with a smaller
id. Difference-cover anchors keep the work down: with a difference cover D modulo v, any two places have a shift
below v that takes both into D, so two equal windows share an anchor, a hash of window - v + 1 words at a place whose
remainder is in D. Only windows around anchors found in two or more documents are hashed in full.

Every slice of texts first settles what it can by itself: of several documents with the same anchor or window only
the smallest sends a row on, the others are settled. A passage in a third of all documents therefore sends one row
per slice, not one per document, and no group is ever expanded into pairs.

Of equal texts only the one with the smallest id is looked at; the others lose all their words (if they have a whole
window), whatever the size of the group. Ids and texts meet by id, so a group of copies never meets in one task.

Rows without an id have no order: they are returned whole and take nothing from others. Rows that repeat an id are
separate texts with that id. A null or empty text has no words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayflow.llm.texts import mix, slices, split_words, window_hashes

#: Perfect difference sets: each residue is a difference of two members, in exactly one way but for 0.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}

COPY = 0
#: `spot` packs a range of places in a text (first place, length less one) and whether it is settled: few bytes a row.
_ANCHOR = "key long, owner_id long, part int, spot long"
_WINDOW = "key long, tail int, owner_id long, part int, spot long"


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The widest period that leaves an anchor of at least two fifths of the window."""
    period = max(v for v in COVERS if v == 1 or window - v + 1 >= 0.38 * window)
    return period, COVERS[period]


def _runs(owner: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join touching ranges of the same owner; the input is ordered by owner and lo, and all ranges are as long."""
    if not len(owner):
        return owner, lo, hi
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (lo[1:] > hi[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(owner)) - 1
    return owner[at], lo[at], hi[last]


def _settle(k1, k2, ids, parts, owner, lo, hi, salt, share: bool) -> pa.RecordBatch:
    """Rows for the shuffle from one slice: one document per key, and the settled ranges of the others.

    A key is k1 and, for windows, the lower half of k2. share: two documents settle a key for both of them (anchors); otherwise only for the larger one (windows).
    """
    order = np.lexsort((lo, owner, ids[owner], k2, k1))
    a, b, o = k1[order], k2[order], owner[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    group = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    least = ids[o[begin]][group] if len(order) else np.zeros(0, np.int64)
    later = ids[o] > least
    if share:
        several = np.zeros(len(begin), bool)
        several[group[later]] = True
        known = several[group]
        send = ~known | new
    else:
        known, send = later, ~later
    # What is known but not sent under its key: ranges under keys of their own, spread over all tasks.
    rest = np.sort(order[~send])
    rest = rest[np.lexsort((lo[rest], owner[rest]))]
    ro, rl, rh = _runs(owner[rest], lo[rest], hi[rest])
    kept = order[send]
    spread = mix(np.arange(len(ro), dtype=np.uint64) + np.uint64(salt), 77)
    who = np.concatenate([owner[kept], ro])
    lo, hi = np.concatenate([lo[kept], rl]), np.concatenate([hi[kept], rh])
    done = np.concatenate([known[send], np.ones(len(ro), bool)])
    out = {"key": np.concatenate([k1[kept], spread]).view(np.int64)}
    if not share:
        out["tail"] = np.concatenate([k2[kept], mix(spread, 5)]).astype(np.uint32).view(np.int32)
    return pa.record_batch(out | {"owner_id": ids[who], "part": parts[who], "spot": lo << 32 | (hi - lo) << 1 | done})


def _columns(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return rows.column(0).to_numpy(zero_copy_only=False), rows.column(1).to_numpy(zero_copy_only=False)


def _anchor_rows(window: int):
    period, cover = cover_for(window)
    length = window - period + 1
    in_cover = np.zeros(period, bool)
    in_cover[list(cover)] = True

    def work(batches):
        for batch in batches:
            for rows, data, offsets in slices(batch):
                ids, parts = _columns(rows)
                words = split_words(data, offsets)
                n = words.counts
                keys = window_hashes(words.hashes(), length, 1)
                owner = words.owner()[:len(keys)]
                place = np.arange(len(keys)) - words.first[owner]
                ok = (n[owner] >= window) & in_cover[place % period] & (place + length <= n[owner])
                at = np.flatnonzero(ok)
                if not len(at):
                    continue
                owner, place = owner[at], place[at]
                lo = np.maximum(place - (window - length), 0)
                hi = np.minimum(place, n[owner] - window)
                none = np.zeros(len(at), np.uint64)
                yield _settle(keys[at], none, ids, parts, owner, lo, hi, int(keys[at[0]]) >> 8, share=True)

    return work


def _ranges(column: pa.Array, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A list column of (part, spot): the row of each range of the row's own part, and its ends."""
    n = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    flat = column.flatten()
    owner, spot = np.repeat(np.arange(len(n)), n), np.asarray(flat.field(1)).astype(np.int64)
    own = np.asarray(flat.field(0)) == parts[owner]
    lo = spot[own] >> 32
    return owner[own], lo, lo + ((spot[own] & 0xFFFFFFFF) >> 1)


def _covered(words, rows: pa.RecordBatch, beyond: int) -> np.ndarray:
    """Which words lie in a range of their text; each range reaches `beyond` words past its end."""
    change = np.zeros(len(words.starts) + 1, np.int64)
    owner, lo, hi = _ranges(rows.column(3), _columns(rows)[1])
    np.add.at(change, words.first[owner] + lo, 1)
    np.add.at(change, words.first[owner] + hi + 1 + beyond, -1)
    return np.cumsum(change[:-1]) > 0


def _window_rows(window: int):
    def work(batches):
        for batch in batches:
            for rows, data, offsets in slices(batch):
                ids, parts = _columns(rows)
                words = split_words(data, offsets)
                at = np.flatnonzero(_covered(words, rows, 0))
                if not len(at):
                    continue
                hashes = words.hashes()
                k1, k2 = window_hashes(hashes, window, 2)[at], window_hashes(hashes, window, 3)[at] & np.uint64(0xFFFFFFFF)
                owner = words.owner()[at]
                place = at - words.first[owner]
                yield _settle(k1, k2, ids, parts, owner, place, place, int(k2[0]) >> 8, share=False)

    return work


def _cut_rows(window: int):
    names = ["doc_id", "kept_text", "n_words", "n_removed"]

    def work(batches):
        for batch in batches:
            for rows, data, offsets in slices(batch):
                words = split_words(data, offsets)
                gone = _covered(words, rows, window - 1)
                copies = (_columns(rows)[1] == COPY) & (words.counts >= window)
                gone |= np.repeat(copies, words.counts)
                raw, total, first = data.tobytes(), np.concatenate([[0], np.cumsum(gone)]), words.first
                texts, removed = [], total[first[1:]] - total[first[:-1]]
                for i in range(rows.num_rows):
                    tokens = raw[offsets[i]:offsets[i + 1]].split()
                    if removed[i]:
                        tokens = [t for t, g in zip(tokens, gone[first[i]:first[i + 1]]) if not g]
                    texts.append(b" ".join(tokens).decode())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(texts, pa.string()), pa.array(words.counts.astype(np.int64)),
                     pa.array(removed.astype(np.int64))], names)

    return work


def _spans(found: DataFrame) -> DataFrame:
    return found.groupBy(F.col("owner_id").alias("span_id")).agg(F.collect_list(F.struct("part", "spot")).alias("spans"))


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, kept_text (kept words joined by one space), n_words and n_removed.

    Other columns of `docs` are not used, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("owner_id"), text.alias("text"), F.md5(text).alias("digest"))
    # Rows without an id go apart, so that all joins below read one and the same exchange of the texts by id.
    texts = rows.where("owner_id is not null")
    firsts = texts.groupBy("digest").agg(F.min("owner_id").alias("first_id"))
    firsts = firsts.groupBy("first_id").agg(F.sort_array(F.collect_set("digest")).alias("digests"))
    # part: which of the texts that are new with this id; 0 for a copy of an earlier text, -1 without an id.
    part = F.coalesce(F.array_position("digests", F.col("digest")).cast("int"), F.lit(COPY))
    texts = texts.join(firsts.hint("shuffle_hash"), F.col("owner_id") == F.col("first_id"), "left")
    texts = texts.select("owner_id", part.alias("part"), "text")
    new, on = texts.where("part > 0"), F.col("owner_id") == F.col("span_id")
    wanted = ["owner_id", "part", "text", "spans"]

    same = Window.partitionBy("key")
    anchors = new.mapInArrow(_anchor_rows(window), _ANCHOR).withColumns({
        "least": F.min("owner_id").over(same), "most": F.max("owner_id").over(same),
        "settled": F.max(F.col("spot").bitwiseAND(F.lit(1))).over(same),
    })
    around = _spans(anchors.where("settled = 1 or least < most"))
    windows = new.join(around.hint("shuffle_hash"), on).select(wanted).mapInArrow(_window_rows(window), _WINDOW)
    windows = windows.withColumn("least", F.min("owner_id").over(Window.partitionBy("key", "tail")))
    gone = _spans(windows.where("spot & 1 = 1 or least < owner_id"))
    marked = texts.join(gone.hint("shuffle_hash"), on, "left").select(wanted)
    alone = rows.where("owner_id is null").select("owner_id", F.lit(-1).alias("part"), "text",
                                                F.expr("cast(array() as array<struct<part: int, spot: long>>)").alias("spans"))
    marked = marked.unionByName(alone)
    return marked.mapInArrow(_cut_rows(window), "doc_id long, kept_text string, n_words long, n_removed long")
