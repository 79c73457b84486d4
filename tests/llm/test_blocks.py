"""The blocks of near-duplicate detection: the same pairs as by brute force, and bounded memory for a full block."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from stayflow.llm import near_dedup


def block(rows):
    """(side, label, n, odd, parity) as one batch of a block, in order of set_id."""
    return pa.RecordBatch.from_arrays([
        pa.array([1] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([b"%08d" % i for i in range(len(rows))], pa.binary()),
        pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
        pa.array([r[3].tobytes() for r in rows], pa.binary()), pa.array([r[4].tobytes() for r in rows], pa.binary()),
    ], ["task", "side", "set_id", "label", "n", "odd", "parity"])


def brute(rows, bounds, most):
    found = {}
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if i < j and a[1] != b[1] and (a[0] & 1 and b[0] & 2 or a[0] & 2 and b[0] & 1):
                ok, differ = bounds.likely(*(np.array([x]) if k == 0 else x[None] for x, k in zip(a[2:], range(3))),
                                           *(np.array([x]) if k == 0 else x[None] for x, k in zip(b[2:], range(3))))
                if ok[0]:
                    found.setdefault((min(a[1], b[1]), max(a[1], b[1])), []).append((differ[0] / (a[2] + b[2]), i, j))
    out = set()
    for pairs in found.values():
        out |= {(b"%08d" % i, b"%08d" % j, len(pairs) > most) for _, i, j in sorted(pairs)[:most]}
    return out


@pytest.mark.parametrize("most", [1, 3, 64])
@pytest.mark.parametrize("both", [True, False])
def test_pairs_of_a_block_match_brute_force(most, both):
    rng, random_bits = random.Random(most), np.random.default_rng(most)
    odd, parity = (random_bits.integers(0, 1 << 63, k, dtype=np.uint64) for k in (near_dedup.ODD_BITS // 64, near_dedup.PARITY_BITS // 64))
    rows = []
    for i in range(150):
        own = parity.copy()
        for _ in range(rng.randint(0, 12)):
            own[rng.randrange(len(own))] ^= np.uint64(1 << rng.randrange(64))
        rows.append((3 if both else 1 + i % 2, i % 9, rng.randint(80, 100), odd, own))
    bounds = near_dedup._Bounds(80)
    (out,) = near_dedup._block_rows(bounds, most)([block(rows)])
    found = list(zip(*(c.to_pylist() for c in out.columns)))
    assert len(found) == len(set(found)) and set(found) == brute(rows, bounds, most)


def test_a_full_block_of_alike_classes_needs_little_memory():
    odd, parity = np.zeros(near_dedup.ODD_BITS // 64, np.uint64), np.zeros(near_dedup.PARITY_BITS // 64, np.uint64)
    rows = [(3, i, 100, odd, parity) for i in range(near_dedup.BLOCK)]
    batch = block(rows)
    tracemalloc.start()
    (out,) = near_dedup._block_rows(near_dedup._Bounds(80), 1)([batch])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == near_dedup.BLOCK * (near_dedup.BLOCK - 1) // 2
    assert peak < 200 << 20
