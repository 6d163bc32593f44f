import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest

from evisift.llm.periods import echoed, find_runs, guaranteed, kept_words, op13_periodic_runs, periodic_runs


def smallest_period(w):
    return next(p for p in range(1, len(w) + 1) if w[p:] == w[: len(w) - p])


def brute(words, shortest=24, times=3):
    words, out = list(words), []
    n = len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(shortest, times * q) and smallest_period(words[i : i + length]) == q:
                out.append((i, length, q))
            i = max(i + 1, j + 1) if j > i else i + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("shortest", "times"), [(24, 3), (6, 3), (10, 4), (1, 3), (40, 5)])
def test_runs_equal_brute_force(shortest, times):
    r = np.random.default_rng(shortest * 7 + times)
    docs = [r.integers(0, 2, n) for n in (0, 1, 5, 30, 80)] + [r.integers(0, 60, 100)]
    for _ in range(12):
        parts = [np.tile(r.integers(0, 3, r.integers(1, 40)), r.integers(1, 7))[: r.integers(1, 150)] for _ in range(4)]
        docs.append(np.concatenate(parts))
    docs += [np.zeros(300, int), np.tile(np.r_[np.zeros(30, int), np.ones(3, int)], 12), np.tile(np.r_[np.tile([1, 2], 20), [3]], 9)]
    assert find_runs(docs, shortest, times) == [brute(d.tolist(), shortest, times) for d in docs]
    assert guaranteed(24, 3) == 16


def test_no_run_crosses_documents_and_long_repeats_are_fast():
    docs = [np.zeros(23, int)] * 50
    assert find_runs(docs) == [[]] * 50
    n = 400_000
    assert find_runs([np.zeros(n, int)]) == [[(0, n, 1)]]
    base = np.random.default_rng(1).integers(0, 5, 50_000)
    assert (0, 200_000, 50_000) in find_runs([np.tile(base, 4)])[0]


def test_kept_words_drop_all_but_the_first_period():
    keep = kept_words(30, [(2, 25, 3)])
    assert keep.tolist() == [True] * 5 + [False] * 22 + [True] * 3


def test_operator_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "a " * 40), (4, "a " * 40), (5, "x " + "b c " * 12 + "y"), (6, "é é " * 24), (7, "w " * 23)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, runs string")
    got = {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(df).collect()}
    assert got[1] == got[2] == got[3] == ([], "")
    assert got[4] == ([(0, 40, 1)], "a") and got[5] == ([(1, 24, 2)], "x b c y")
    assert got[6] == ([(0, 24, 1)], "é é") and got[7] == ([], " ".join("w" * 23))
    assert periodic_runs(df).count() == 8 and periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(df, times=2)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = op13_periodic_runs(spark, sf).collect()
    assert len(out) == len(docs)
    met = 0
    for r in out:
        words = (docs[r.doc_id] or "").encode().split()
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 1500:
            continue
        runs = brute(words)
        met += bool(runs)
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest()
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        assert (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
    assert met > 5
    assert echoed([b"a"], None) == [b"a"] and echoed([], 3) == []
