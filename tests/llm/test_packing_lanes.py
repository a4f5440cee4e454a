"""Packing in several lanes and supersteps."""

import collections
import random

import numpy as np
import pytest

from poolstrata.llm import packing


def test_a_lane_is_best_fit_decreasing():
    rng = np.random.default_rng(5)
    for n in (1, 7, 300):
        blocks, sizes = rng.permutation(10 * n)[:n].astype(np.int64), rng.integers(1, 65, n)
        names, offsets, fills = packing.fill_lane(blocks, sizes, 64)
        parts = collections.defaultdict(list)
        for name, offset, size, fill, block in zip(*(x.tolist() for x in (names, offsets, sizes, fills, blocks))):
            parts[name].append((offset, size, fill, block))
        gaps = []
        for s in sorted(sizes.tolist(), reverse=True):
            fit = [g for g in gaps if g >= s]
            gaps.remove(min(fit)) if fit else None
            gaps.append((min(fit) if fit else 64) - s)
        assert len(parts) == len(gaps) and sum(2 * f[0][2] <= 64 for f in parts.values()) <= 1
        for name, own in parts.items():
            at = 0
            for offset, size, fill, block in sorted(own):
                assert offset == at and fill == sum(x[1] for x in own) <= 64 and (offset or block == name)
                at += size


@pytest.mark.parametrize("lane", [3, 40, 1 << 16])
def test_lanes_share_what_they_leave_open(spark, lane):
    rng = random.Random(lane)
    rows = [(n % 97 or None, " ".join("ab"[k % 2] for k in range(rng.choice((3, 3, 3, 40, 90, 200, 0))))) for n in range(400)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), length=256, lane=lane).collect()
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256
    assert len(got) == len(rows) and sum(2 * sum(n for _, n in p) <= 256 for p in sequences.values()) <= 1
    once = packing.sweep(dict(collections.Counter(r.length for r in got)), 256)[1]
    assert once <= len(sequences) <= once * (1.02 if lane > 3 else 1.3) + 1


@pytest.mark.parametrize("lane", [1, 7, 1 << 16])
def test_ranges_change_nothing(spark, lane):
    """However the pieces are cut into ranges, all of them together are packed best-fit decreasing."""
    rng = random.Random(1)
    rows = [(n, "a " * rng.choice((1, 1, 1, 30, 30, 61, 100, 127, 128, 129, 200))) for n in range(300)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), length=128, lane=lane).collect()
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 128
    gaps = []
    for s in sorted((r.length for r in got), reverse=True):
        fit = [g for g in gaps if g >= s]
        gaps.remove(min(fit)) if fit else None
        gaps.append((min(fit) if fit else 128) - s)
    assert len(sequences) == len(gaps)
