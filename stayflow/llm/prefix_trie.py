"""Prefix trie of conversations by vertical bitmaps.

A node is a distinct sequence of first turns (role, text). Conversations are dealt out by ranges of their number and each
task cuts its range into shards of some SHARD_CONVS conversations or SHARD_TURNS turns. A shard keeps, for each position
and turn, the bitset of the conversations that have this turn there. Its trie is walked depth first: the bitset of a node,
intersected with the postings of the next position, gives the bitsets of its children; a bitset's ones are the node's
conversations, and those that end there are its end list. Once one conversation is left, the rest of it is one chain.

The shards' nodes meet by a 128-bit hash of the sequence: a node sends one row per shard, however many conversations go
through it. What follows is arithmetic on paths. A node is named by its smallest conversation and its depth, and the nodes
with one name make a path from some depth down to where this conversation ends. So a subtree holds the rest of the node's own path and
the whole paths of its other members that begin below it: sums over subtrees are sums over members, without a
walk up the tree, and take the same number of joins however deep it is.

A list of ends may hold a third of all conversations: its parts, one per shard and in order of the ranges, are run through
SHA-256 one after the other and never held together. A single conversation is read as a stream and cut where its shard is
full, so it may have any number of turns; its rows are sorted and its path is summed up in one task each.

Turns are ordered by number, null first, then by digest; null role and text are empty. Repeated turns are turns of their
own. Rows without a conversation number belong to none and are left out. Without conversations there is no root and no row.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayflow.llm.texts import mix
from stayflow.session import work_dir

SHARD_CONVS = 4096
SHARD_TURNS = 1 << 16
_NODES = "node_a long, node_b long, depth long, points long, members array<long>, ends array<long>"


def _terms(digest: np.ndarray, position: np.ndarray, k: int) -> np.ndarray:
    """What a turn at a position adds to the k-th half of the hash of all sequences that it is in."""
    at = position.astype(np.uint64)
    return mix(digest[:, 0] + mix(at, 71 + k), 73 + k) + mix(digest[:, 1] + mix(at, 75 + k), 77 + k)


def _node(total: np.ndarray, depth: np.ndarray, k: int) -> np.ndarray:
    return mix(total ^ mix(depth.astype(np.uint64), 81 + k), 83 + k)


def _ones(bits: int) -> list[int]:
    """Places of the ones of a bitset, in order."""
    raw = np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little")).tolist()


class Shard:
    """Conversations, or stretches of them, in order of their number; the first may go on from the shard before."""

    def __init__(self):
        self.ids: list[int] = []
        self.start: list[int] = []  # turns before the stretch
        self.total: list[tuple[int, int]] = []  # and the two halves of their hash
        self.parts: list[list[tuple[np.ndarray, np.ndarray]]] = []
        self.ended: list[bool] = []
        self.turns = 0

    @property
    def full(self) -> bool:
        return len(self.ids) >= SHARD_CONVS or self.turns >= SHARD_TURNS

    def open(self, conv_id: int, start: int = 0, total: tuple[int, int] = (0, 0)) -> None:
        self.ids.append(conv_id)
        self.start.append(start)
        self.total.append(total)
        self.parts.append([])
        self.ended.append(False)

    def add(self, digest: np.ndarray, points: np.ndarray) -> None:
        self.parts[-1].append((digest, points))
        self.turns += len(points)

    def end(self) -> None:
        if self.ids:
            self.ended[-1] = True

    def rest(self) -> Shard:
        """A shard that goes on with the last conversation of this one, which has not ended."""
        done = sum(len(p) for _, p in self.parts[-1])
        begin = self.start[-1]
        if not done:  # nothing of it is here: it moves as it is
            out = Shard()
            out.open(self.ids.pop(), self.start.pop(), self.total.pop())
            self.parts.pop()
            self.ended.pop()
            return out
        halves = list(self.total[-1])
        if done:
            digest = np.concatenate([d for d, _ in self.parts[-1]])
            for k in (0, 1):
                halves[k] = (halves[k] + int(_terms(digest, begin + 1 + np.arange(done), k).sum(dtype=np.uint64))) % (1 << 64)
        out = Shard()
        out.open(self.ids[-1], begin + done, (halves[0], halves[1]))
        return out

    def nodes(self) -> pa.RecordBatch:
        """The nodes of the shard's trie with their members and end lists."""
        n = len(self.ids)
        sizes = np.array([sum(len(p) for _, p in parts) for parts in self.parts], np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])
        digest = np.concatenate([d for parts in self.parts for d, _ in parts] or [np.zeros((0, 2), np.uint64)])
        points = np.concatenate([p for parts in self.parts for _, p in parts] or [np.zeros(0, np.int64)])
        slot = np.repeat(np.arange(n), sizes)
        start = np.array(self.start, np.int64)
        position = start[slot] + np.arange(len(slot)) - first[slot] + 1
        halves = []
        for k in (0, 1):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_terms(digest, position, k), dtype=np.uint64)])
            before = np.array([t[k] for t in self.total], np.uint64)
            halves.append(_node(total[1:] - total[first[:-1]][slot] + before[slot], position, k))

        # Vertical bitmaps: for each (position, turn) the conversations that have it.
        order = np.lexsort((digest[:, 1], digest[:, 0], position))
        new = np.ones(len(order), bool)
        a, b = order[1:], order[:-1]
        new[1:] = (position[a] != position[b]) | (digest[a] != digest[b]).any(axis=1)
        posting = np.empty(len(order), np.int64)
        posting[order] = np.cumsum(new) - 1
        bits = [0] * int(new.sum())
        for p, s in zip(posting.tolist(), slot.tolist()):
            bits[p] |= 1 << s
        stops: dict[int, int] = {}
        ends: dict[int, int] = {}
        depth_of = start + sizes
        for s, d in enumerate(depth_of.tolist()):
            stops[d] = stops.get(d, 0) | 1 << s
            if self.ended[s]:
                ends[d] = ends.get(d, 0) | 1 << s

        rows, members, counts, finals, final_counts = [], [], [], [], []
        fresh = sum(1 << s for s in range(n) if not self.start[s])
        walk = [(int(start[s]), 1 << s, False) for s in range(n) if self.start[s]]
        if fresh:
            walk.append((0, fresh, True))
        posting_of, begin = posting.tolist(), (first[:-1] - start).tolist()
        while walk:
            depth, inside, told = walk.pop()
            lowest = (inside & -inside).bit_length() - 1
            if told:
                found = _ones(inside)
                rows.append(begin[lowest] + depth - 1 if depth else -1)
                members += found
                counts.append(len(found))
                over = _ones(inside & ends.get(depth, 0))
                finals += over
                final_counts.append(len(over))
            rest = inside & ~stops.get(depth, 0)
            while rest:
                low = (rest & -rest).bit_length() - 1
                at = begin[low] + depth
                child = rest & bits[posting_of[at]]
                rest ^= child
                if child & (child - 1):
                    walk.append((depth + 1, child, True))
                    continue
                # One conversation is left: all its further nodes at once.
                to = int(first[low + 1])
                rows += range(at, to)
                members += [low] * (to - at)
                counts += [1] * (to - at)
                final_counts += [0] * (to - at)
                if self.ended[low]:
                    finals.append(low)
                    final_counts[-1] = 1

        where, ids = np.array(rows, np.int64), np.array(self.ids, np.int64)
        root = where < 0
        out_depth = np.where(root, 0, position[where]) if len(position) else np.zeros(len(where), np.int64)
        names = []
        for k, half in enumerate(halves):
            zero = _node(np.zeros(1, np.uint64), np.zeros(1, np.int64), k)[0]
            names.append(np.where(root, zero, half[where] if len(half) else zero).view(np.int64))
        listed = [pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(c)]).astype(np.int32), ids[np.array(v, np.int64)])
                  for v, c in ((members, counts), (finals, final_counts))]
        told = np.where(root, 0, points[where]) if len(points) else np.zeros(len(where), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(names[0]), pa.array(names[1]), pa.array(out_depth), pa.array(told), *listed],
                                          ["node_a", "node_b", "depth", "points", "members", "ends"])


def _shards(heads: int, group: int):
    """Rows of turns, in order of conversation and place, to the nodes of each shard."""
    def work(batches):
        shard, now, seen, skip = Shard(), None, 0, 0
        lead, lead_digest, lead_points = None, None, None  # the first turns of the group's first conversation
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.asarray(batch.column(0))
            digest = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, 2)
            points = np.asarray(batch.column(2)).astype(np.int64)
            cuts = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]]).tolist()
            for a, b in zip(cuts[:-1], cuts[1:]):
                if ids[a] != now:
                    shard.end()
                    if shard.full:
                        yield shard.nodes()
                        shard = Shard()
                    now, seen = int(ids[a]), 0
                    first = now - now % group if group else now
                    skip = zlib.crc32(str(now).encode()) % heads if group and now != first else 0
                    shard.open(now)
                    if now == first:
                        lead, lead_digest, lead_points = now, digest[:0], points[:0]
                    elif lead == first:
                        shard.add(lead_digest[:skip], lead_points[:skip])
                if now == lead and len(lead_points) < heads - 1:
                    more = heads - 1 - len(lead_points)
                    lead_digest = np.concatenate([lead_digest, digest[a:b][:more]])
                    lead_points = np.concatenate([lead_points, points[a:b][:more]])
                left = min(b - a, max(0, skip - seen))
                seen += b - a
                if a + left < b:
                    if shard.full:
                        rest = shard.rest()
                        if shard.ids:
                            yield shard.nodes()
                        shard = rest
                    shard.add(digest[a + left:b], points[a + left:b])
        shard.end()
        if shard.ids:
            yield shard.nodes()

    return work


def _end_lists(batches):
    """Rows (node_a, node_b, ends) in order of node and place to one hash per node, part by part."""
    def told(done):
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()),
                                           pa.array([d[2] for d in done], pa.string())], ["node_a", "node_b", "ends_sha256"])

    key, state = None, None
    for batch in batches:
        done = []
        for a, b, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            part = ",".join(map(str, ends.as_py())).encode()
            if (a, b) == key:
                state.update(b"," + part)
                continue
            if key is not None:
                done.append((*key, state.hexdigest()))
            key, state = (a, b), hashlib.sha256(part)
        yield told(done)
    if key is not None:
        yield told([(*key, state.hexdigest())])


def turns_in_order(conversations: DataFrame, group: int, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text") -> DataFrame:
    """Rows (conv_id, digest, points), dealt out by ranges of the group and sorted by conversation and place."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    conv = F.col(conv_col).cast("long")
    first = conv - F.pmod(conv, F.lit(group)) if group else conv
    rows = conversations.where(conv.isNotNull()).select(
        conv.alias("conv_id"), digest.alias("digest"), F.length(text).cast("long").alias("points"), F.col(turn_col).alias("place"), first.alias("range"))
    ordered = rows.repartitionByRange("range").sortWithinPartitions("conv_id", F.asc_nulls_first("place"), "digest")
    return ordered.select("conv_id", "digest", "points")


def build(conversations: DataFrame, heads: int = 6, group: int = 0, conv_col: str = "conv_id", turn_col: str = "turn",
          role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    With a `group`, conversation c is rebuilt before: its first crc32(c) % heads turns are replaced by as many first turns
    of the conversation c - c mod group (fewer if that has fewer, none if it is absent); c mod group is never negative.
    """
    spark = conversations.sparkSession
    folder = work_dir(spark, "trie")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    ordered = turns_in_order(conversations, group, conv_col, turn_col, role_col, text_col)
    local = stored(ordered.mapInArrow(_shards(heads, group), _NODES), "local")
    node = ["node_a", "node_b"]
    merged = stored(local.groupBy(node).agg(
        F.min(F.element_at("members", 1)).alias("conv_id"), F.max("depth").alias("depth"), F.max("points").alias("points"),
        F.sum(F.size("members")).alias("n_convs"), F.sum(F.size("ends")).alias("n_ends")), "merged")
    saving = (F.col("n_convs") - 1) * F.col("points")
    paths = merged.groupBy("conv_id").agg(
        F.min("depth").alias("top"), F.sum(saving).alias("saved"),
        F.max_by((F.col("n_convs") == F.col("n_ends")).cast("long"), "depth").alias("leaves"))

    # The members of shared nodes whose own paths begin further down.
    holders = merged.where("n_convs > 1").select(*node, F.col("conv_id").alias("holder"), F.col("depth").alias("at"))
    inner = local.select(*node, "members").join(holders, node).select("holder", "at", F.explode("members").alias("conv_id"))
    hung = stored(inner.where("conv_id <> holder").join(paths, "conv_id").where("at < top"), "hung")
    below = hung.groupBy(F.col("holder").alias("conv_id"), F.col("at").alias("depth")).agg(
        F.sum("saved").alias("saved_below"), F.sum("leaves").alias("leaves_below"), F.count_if(F.col("at") == F.col("top") - 1).alias("branches"))
    parents = hung.where("at = top - 1").select("conv_id", F.col("holder").alias("above"))
    parts = local.where(F.size("ends") > 0).select(*node, "ends", F.element_at("ends", 1).alias("first"))
    parts = parts.repartition(*node).sortWithinPartitions(*node, "first").select(*node, "ends")
    sums = parts.mapInArrow(_end_lists, "node_a long, node_b long, ends_sha256 string")

    down = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    upto = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = merged.withColumns({
        "saved": F.sum(saving).over(upto), "leaf": F.first(F.col("n_convs") == F.col("n_ends")).over(upto).cast("long"),
        "goes_on": F.lag("depth").over(down).isNotNull().cast("long"), "is_top": F.lead("depth").over(down).isNull(),
    })
    joined = onward.join(below, ["conv_id", "depth"], "left").join(parents, "conv_id", "left").join(sums, node, "left")
    none = lambda name: F.coalesce(name, F.lit(0))
    return joined.select(
        "conv_id", "depth",
        F.when(F.col("depth") > 0, F.when(F.col("is_top"), F.col("above")).otherwise(F.col("conv_id"))).alias("parent_conv_id"),
        "n_convs", (F.col("goes_on") + none("branches")).alias("n_children"), (F.col("leaf") + none("leaves_below")).alias("n_leaves"),
        (F.col("saved") + none("saved_below")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
