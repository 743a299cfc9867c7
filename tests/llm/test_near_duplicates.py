import random

import numpy as np
import pytest

from corpusloom.llm import near_duplicates as N


def test_golay_code():
    rng = random.Random(1)
    for _ in range(200):
        x = rng.getrandbits(23)
        keys = N.codeword_indices(x)
        words = [(k << 11) | N.syndrome(k << 11) for k in keys]
        assert all((w ^ x).bit_count() <= 4 for w in words) and (words[0] ^ x).bit_count() <= 3
        y = x ^ (1 << rng.randrange(23))
        assert set(keys) & set(N.codeword_indices(y))  # one error never separates


def test_near_codewords_of_many():
    rng = random.Random(2)
    xs = [0, 1, (1 << 23) - 1, *(rng.getrandbits(23) for _ in range(50))]
    at, index = N.near_codewords(np.array(xs, np.int64))
    code = [(m << 11) | N.syndrome(m << 11) for m in range(1 << 12)]
    for i, x in enumerate(xs):
        assert sorted(index[at == i].tolist()) == sorted(c >> 11 for c in code if (c ^ x).bit_count() <= 4)


def test_packed_segments():
    rng = np.random.default_rng(3)
    seg = [rng.integers(0, 1 << 23, 10) for _ in range(N.SEGMENTS)]
    packed = N.pack_segments(seg)
    assert all((N.segment(packed, s) == seg[s]).all() for s in range(N.SEGMENTS))


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    vocab = [f"palabra{i}" for i in range(900)]
    rows = []
    for b in range(n):
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 90))]
        rows.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((" ".join(w)).upper() if rng.random() < 0.3 else ", ".join(w))
    return [(i, t) for i, t in enumerate(rows)]


def brute(rows, shingle, threshold, least):
    sets = {}
    for i, t in rows:
        w = N.split_words(t)
        if len(w) >= least:
            sets[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}


@pytest.mark.parametrize("shingle, threshold, least", [(3, 0.6, 20), (5, 0.8, 5)])
def test_recall_against_brute_force(spark, shingle, threshold, least):
    rows = corpus() + [(10_000, None), (10_001, ""), (10_002, "corto")]
    df = spark.createDataFrame(rows, "row_id long, text string")
    got = {tuple(r) for r in N.row_pairs(*N.near_duplicates(df, "row_id", "text", shingle, threshold, least)).collect()}
    want = brute(rows, shingle, threshold, least)
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 50


def test_hot_anchors(spark):
    # A phrase that more texts share than HOT: texts of little else, and texts with words of their own.
    rng = random.Random(4)
    phrase = " ".join(f"frase{i}" for i in range(24))
    rows = [(i, f"{phrase} uno{rng.randrange(40)} dos{rng.randrange(40)}") for i in range(N.HOT + 60)]
    for i in range(40):
        own = [f"propia{i}x{k}" for k in range(40)]
        rows.append((1000 + 2 * i, f"{phrase} {' '.join(own)}"))
        own[rng.randrange(40)] = "cambio"
        rows.append((1001 + 2 * i, f"{phrase} {' '.join(own)}"))
    df = spark.createDataFrame(rows, "row_id long, text string")
    got = {tuple(r) for r in N.row_pairs(*N.near_duplicates(df, "row_id", "text", 3, 0.6, 20)).collect()}
    want = brute(rows, 3, 0.6, 20)
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > N.HOT


def test_pairs_that_share_only_hot_anchors(spark, monkeypatch):
    # Texts of one template with four words of their own each: half of their anchors are their own, and all pairs are similar.
    monkeypatch.setattr(N, "HOT", 20)
    rows = []
    for i in range(60):
        words = [f"plantilla{k}" for k in range(60)]
        for at in (9, 21, 33, 45):
            words[at] = f"propia{i}x{at}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "row_id long, text string")
    got = {tuple(r) for r in N.row_pairs(*N.near_duplicates(df, "row_id", "text", 3, 0.6, 20)).collect()}
    assert got == brute(rows, 3, 0.6, 20) and len(got) == 60 * 59 // 2


def test_many_copies_stand_as_a_star(spark):
    text = " ".join(f"voz{i}" for i in range(40))
    rows = [(i, text) for i in range(N.EXPAND + 6)] + [(1000, text + " más")]
    df = spark.createDataFrame(rows, "row_id long, text string")
    got = {tuple(r) for r in N.row_pairs(*N.near_duplicates(df, "row_id", "text", 3, 0.6, 20)).collect()}
    assert got == {(0, i) for i in range(1, N.EXPAND + 6)} | {(0, 1000)}
    g = {r.row_id: (r.group_id, r.n_links) for r in N.groups(*N.near_duplicates(df, "row_id", "text", 3, 0.6, 20)).collect()}
    assert set(g.values()) == {(0, N.EXPAND + 6)} and len(g) == N.EXPAND + 7


def test_empty(spark):
    df = spark.createDataFrame([], "row_id long, text string, anchors string")
    assert N.row_pairs(*N.near_duplicates(df, "row_id", "text")).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a long, b long")
    got = {r.id: r.group_id for r in N.components(edges).collect()}
    assert {got[i] for i in range(31)} == {0} and got[101] == 100
