import math
from collections import Counter

import numpy as np
import pytest

from evisift.llm import negatives
from evisift.llm.negatives import Best, Tree, hard_negatives, search


def brute(rows, anchor, positives=5, k=10, low=30, high=90):
    """Multiset of result rows; rows are (vec_id, label, vector)."""
    sound = []
    for i, label, v in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * x) for x in v]
        if sum(x * x for x in q) < 2**62:
            sound.append((i, label, q))
    out = Counter()
    for n, (i, label, q) in enumerate(sound):
        if i is None or not anchor(i):
            continue
        scored = [(-sum(a * b for a, b in zip(q, p, strict=True)), j is None, j or 0, j, other) for m, (j, other, p) in enumerate(sound) if m != n and len(p) == len(q)]
        scored.sort(key=lambda s: s[:3])
        for s, _, _, j, _ in [s for s in scored if s[4] == label][:positives]:
            fit = [t for t in scored if t[4] != label and low * -s <= 100 * -t[0] <= high * -s][:k]
            out.update((i, j, rank, t[3], -s, -t[0]) for rank, t in enumerate(fit, 1))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1.5) for r in rows], "vec_id long, label int, embedding array<double>, uid string, score double").repartition(5)


def check(spark, rows, anchor="vec_id % 10 = 0", test=lambda i: i % 10 == 0):
    got = Counter(map(tuple, hard_negatives(frame(spark, rows), anchor).collect()))
    want = brute(rows, test)
    assert got == want
    return want


@pytest.fixture
def small_tree(monkeypatch):
    """Trees of several levels from few rows; workers get the code by value, so only the driver-side order is affected."""
    monkeypatch.setattr(negatives, "LEAF", 8)


def test_random_vectors_equal_brute_force(spark, small_tree):
    r = np.random.default_rng(5)
    rows = [(i, int(r.integers(0, 3)), r.normal(size=6).tolist()) for i in range(400)]
    assert len(check(spark, rows)) > 500


def test_nulls_ties_repeats_ragged_and_huge_vectors(spark):
    r = np.random.default_rng(6)
    rows = [(i, i % 2, (r.integers(-3, 4, 4) / 8).tolist()) for i in range(120)]
    rows += [(200 + i, 0, [0.5, 0.5, 0.25, 0.0]) for i in range(60)] + [(300 + i, 1, [0.25, 0.5, 0.125, 0.0]) for i in range(60)]
    rows += [(10, 0, [0.5, 0.5, 0.25, 0.0])] * 3 + [(None, 0, [0.5, 0.5, 0.5, 0.5]), (None, 1, [0.25, 0.25, 0.25, 0.25]), (20, None, [1.0] * 4), (30, 1, None), (40, 1, [1.0, None, 0.0, 0.0])]
    rows += [(50, 1, [1.0, float("nan"), 0.0, 0.0]), (60, 0, [float("inf"), 0.0, 0.0, 0.0]), (70, 0, []), (80, 1, []), (90, 0, []), (100, 1, [0.5]), (110, 0, [0.25]), (120, 1, [0.5])]
    rows += [(130, 0, [3e6, -2e6, 1e5]), (131, 0, [3e6, -1e6, 1e5]), (140, 1, [2e6, -1.5e6, 7.0]), (141, 1, [1.9e6, -1.5e6, 7.0]), (150, 0, [1e7, 0.0, 0.0]), (160, 1, [1e300, 0.0, 0.0])]
    assert len(check(spark, rows)) > 100


def test_no_rows_no_anchor_and_one_label(spark):
    assert hard_negatives(frame(spark, [(1, 1, [0.0])]).limit(0), "vec_id = 1").count() == 0
    rows = [(i, 7, [float(i), 1.0]) for i in range(30)]
    assert not check(spark, rows)
    assert not check(spark, [(i, i, [float(i), 1.0]) for i in range(30)])
    assert hard_negatives(frame(spark, rows), "vec_id = 99").columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_blocks_of_anchors_give_the_same_rows(spark, monkeypatch):
    r = np.random.default_rng(7)
    rows = [(i, int(r.integers(0, 4)), r.normal(size=5).tolist()) for i in range(200)]
    monkeypatch.setattr(negatives, "BLOCK_NUMBERS", 30)
    check(spark, rows)


def test_tree_prunes_and_keeps_the_best():
    r = np.random.default_rng(8)
    x = np.floor(256 * np.sort(r.normal(size=(4000, 3)), axis=0)).astype(np.int64)
    ids = np.arange(4000)
    tree = Tree(x, ids, np.zeros(4000, bool), ids, 2000)
    assert len(tree.levels) == 3
    a = np.array([300, 200, 100])
    scores = x @ a
    for low, high in ((-(1 << 63), 1 << 62), (1000, 20_000), (-5000, -4000)):
        best = Best(10, np.array([low]), np.array([high]))
        read = search(tree, a, 17, best)
        want = sorted((-s, i) for i, s in enumerate(scores.tolist()) if low <= s <= high and i != 17)[:10]
        assert [(-s, i) for s, i in zip(best.rows[0][0].tolist(), best.rows[0][1].tolist(), strict=True)] == want
        assert read <= 4
