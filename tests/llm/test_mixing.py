import hashlib
from collections import defaultdict

import pytest

from evisift.llm.mixing import fair_queue, op12_fair_queue, source_targets


def levels(sizes, weights=(3, 1, 2), share=1.5, repeats=2):
    """Targets by resharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total >= repeats * sizes[s]]
        if not over:
            return full | {s: left * w[s] / total for s in open_}, w
        for s in over:
            full[s] = repeats * sizes[s]
            open_.remove(s)
        left = share * sum(sizes.values()) - sum(full.values())
    return full, w


def brute(rows):
    """(doc_id, size) -> words taken, by serving one queue."""
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    target, w = levels(sizes)
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    entries, served = [], defaultdict(int)
    for copy in (1, 2):
        keyed = [(hashlib.md5(f"mix|{copy}|{i}".encode()).digest(), i, n, s) for i, s, n in rows]
        for key, i, n, s in sorted(keyed, key=lambda e: e[:3]):
            served[s] += n
            entries.append((served[s] / w[s], names.index(s), copy, key, i, n, s))
    used, taken = 0, defaultdict(int)
    for _, _, _, _, i, n, _ in sorted(entries):
        used += n
        if used <= 1.5 * sum(sizes.values()):
            taken[i] += n
    return target, taken


def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash", 2.5) for r in rows], "doc_id long, source string, size long, copy string, target double")


def test_mix_equals_one_queue_and_meets_targets(spark):
    rows = [(i, ("big" if i % 3 else ("ä", "Z", None, "", "a1", "b")[i % 6]), 1 + (i * 7919) % 90) for i in range(900)] + [(2000, "tiny", 1), (2001, "none", 0)]
    target, taken = brute(rows)
    out = fair_queue(docs(spark, rows).repartition(7))
    assert out.columns == ["doc_id", "source", "size", "row", "copy", "source_size", "target", "finish", "position", "admitted"]
    got = out.collect()
    assert sorted(r.position for r in got) == list(range(2 * len(rows)))
    mine, by_source, biggest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(target[r.source])
        mine[r.doc_id] += r.size * r.admitted
        by_source[r.source] += r.size * r.admitted
        biggest[r.source] = max(biggest[r.source], r.size)
    assert all(mine[i] == taken[i] for i, _, _ in rows)
    assert all(abs(by_source[s] - t) <= biggest[s] + 1 for s, t in target.items())
    ordered = [r.admitted for r in sorted(got, key=lambda r: r.position) if r.size]
    assert ordered == sorted(ordered, reverse=True), "one cut"
    again = fair_queue(docs(spark, rows[::-1]).repartition(3)).where("admitted").select("doc_id", "copy").collect()
    assert {(r.doc_id, r.copy) for r in again} == {(r.doc_id, r.copy) for r in got if r.admitted}


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 0, None: 0}, {"a": 1000, "b": 1, "c": 5}, {"a": 1, "b": 1000, "c": 1, "d": 2}, {None: 7, "": 7, "x": 7, "y": 7000}])
def test_targets_by_resharing(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    out, budget = source_targets(df)
    want, w = levels(sizes)
    got = {r.source: (r.target, r.weight) for r in out.collect()}
    assert budget == 1.5 * sum(sizes.values())
    assert {s: t for s, (t, _) in got.items()} == pytest.approx(want) and {s: x for s, (_, x) in got.items()} == w


def test_repeats_null_ids_nulls_and_no_rows(spark):
    rows = [(1, "a", 5)] * 4 + [(None, "a", 5), (None, None, 3), (2, "b", None)]
    got = fair_queue(docs(spark, rows)).collect()
    assert len(got) == 14 and sum(r.size or 0 for r in got if r.admitted) <= 1.5 * 28
    assert {r.source: r.source_size for r in got} == {"a": 25, None: 3, "b": 0}
    assert fair_queue(docs(spark, rows).limit(0)).count() == 0


def test_query_stays_within_twice_every_size(spark):
    out = op12_fair_queue(spark, "/root/testdata/sf0.01").collect()
    assert all(r.taken in (0, r.size, 2 * r.size) for r in out)
    assert 0.99 < sum(r.taken for r in out) / (1.5 * sum(r.size for r in out)) <= 1
