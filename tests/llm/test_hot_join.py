"""The join of texts under hot anchors: what meets, and how much of it."""

import random

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import near_duplicates as N


def meet(rows, threshold):
    """Pairs from rows (gram, row_id, n, left) with equal sketches, in uneven batches."""
    rows = sorted(rows, key=lambda r: (r[0], r[2]))
    batches, at = [], 0
    while at < len(rows):
        cols = [*zip(*rows[at : at + 7])]
        zeros = [0] * len(cols[0])
        batches.append(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*cols, zeros, zeros)], list("abcdef")))
        at += 7
    return [(a, b) for x in N._meet_grams(threshold)(iter(batches)) for a, b in zip(*(c.to_pylist() for c in x.columns))]


@pytest.mark.parametrize("threshold", [0.6, 0.8])
def test_all_similar_sets_meet_and_few_others(threshold):
    rng = random.Random(7)
    sets = []
    for _ in range(60):
        base = rng.sample(range(400), rng.randint(5, 40))
        sets += [set(base), set(base[: rng.randint(3, len(base))]), set(base) ^ set(rng.sample(range(400), rng.randint(1, 9)))]
    rows = []
    for i, s in enumerate(sets):
        n = len(s)
        first = n - int(np.ceil(threshold * n - 1e-9)) + 1
        rows += [(g, i, n, n - at) for at, g in enumerate(sorted(s)[:first])]
    alike = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}
    assert alike <= set(meet(rows, threshold)) and len(alike) > 20


def test_sequences_that_leave_too_little_bring_no_pairs_together():
    # 300 texts of 100 sequences share one in place 31 of 41: 70 are left of either, 75 would have to be equal.
    assert meet([(5, i, 100, 70) for i in range(300)], 0.6) == []
    assert len(meet([(5, i, 100, 75) for i in range(300)], 0.6)) == 300 * 299 // 2
    assert meet([(5, 0, 60, 60), (5, 1, 100, 100), (5, 2, 59, 59)], 0.6) == [(0, 2), (0, 1)]


def test_ranges():
    for at_once in (1, 4, 100):
        got = [(int(a), int(b)) for i, j in N._ranges(np.array([3, 0, 2, 1, 0]), at_once) for a, b in zip(i, j)]
        assert got == [(0, 1), (0, 2), (0, 3), (2, 3), (2, 4), (3, 4)]
    assert list(N._ranges(np.zeros(0, np.int64))) == []
