"""Top-k kernels: both pairing ways against numpy, post-filter rules, merges."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evisift.operators import retrieval as R, vectors as V
from evisift.operators.topk import InnerProduct, ShareOfRowTokens, ShingleOverlap, TokenOverlap, _scan, top_k


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    q, b = rng.normal(size=(7, 8)), rng.normal(size=(300, 8))
    qd = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid int, item array<double>")
    bd = spark.createDataFrame([(i, v.tolist(), i % 4) for i, v in enumerate(b)], "rid bigint, item array<double>, g int").repartition(5)
    return q, b, qd, bd


def want(q, b, k, keep=None):
    s = np.round(q @ b.T, 6)
    ids = range(len(b)) if keep is None else keep
    return {(i, r, s[i, r], n + 1) for i in range(len(q)) for n, r in enumerate(sorted(ids, key=lambda r: (-s[i, r], r))[:k])}


@pytest.mark.parametrize("kw", [{}, {"query_block_rows": 2, "bucket_rows": 64}])
def test_inner_product_both_ways(data, kw):
    q, b, qd, bd = data
    got = {tuple(r) for r in top_k(qd, bd.select("rid", "item"), InnerProduct, 5, **kw).collect()}
    assert got == want(q, b, 5)


@pytest.mark.parametrize("kw", [{}, {"query_block_rows": 3, "bucket_rows": 50}])
def test_token_overlap_both_ways(spark, kw):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(30)] + ["the"]
    docs = [sorted({*rng.choice(words, 6), "the"}) for _ in range(200)]
    qs = [sorted({*rng.choice(words, 4), "the"}) for _ in range(9)]
    qd = spark.createDataFrame(list(enumerate(qs)), "qid int, item array<string>")
    dd = spark.createDataFrame(list(enumerate(docs)), "rid bigint, item array<string>").repartition(3)
    got = {tuple(r) for r in top_k(qd, dd, TokenOverlap, 4, 1, **kw).collect()}
    exp = set()
    for i, q in enumerate(qs):
        s = sorted(((-len(set(q) & set(d)), r) for r, d in enumerate(docs)))[:4]
        exp |= {(i, r, -o, n + 1) for n, (o, r) in enumerate(s)}
    assert got == exp


def _brute(kernel, qs, docs, k, least):
    out = []
    for i, q in enumerate(qs):
        rows = []
        for r, d in enumerate(docs):
            o, n, m = len(set(q) & set(d)), len(set(q)), max(1, len(set(d)))
            if not o:
                continue
            if kernel is TokenOverlap:
                s = o
            elif kernel is ShareOfRowTokens or n < ShingleOverlap.short_below:
                s = round(o / n, 6)
            else:
                s = round(max(o / (n + m - o), o / m * 0.6), 6)
            if s >= least:
                rows.append((-s, r))
        out += [(i, r, -s) for s, r in sorted(rows)[:k]]
    return out


@pytest.mark.parametrize("kernel, least", [(TokenOverlap, 1), (TokenOverlap, 3), (ShareOfRowTokens, 0.18), (ShingleOverlap, 1e-6), (ShingleOverlap, 0.3)])
@pytest.mark.parametrize("k", [1, 4, 1000])
def test_prefix_filter_is_exact(kernel, least, k):
    """Any split into batches gives the rows of a full comparison: ties, empty rows, hot words, texts of very unlike length."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(60)]
    docs = [["the", *rng.choice(words, rng.integers(0, 50), replace=False)] for _ in range(300)] + [[]] * 5 + [["the"]] * 20
    qs = [["the", *rng.choice(words, rng.integers(1, 40), replace=False)] for _ in range(12)] + [docs[3], ["absent"], docs[7][:4]]
    ix = kernel(list(range(len(qs))), qs)
    best = None
    for at in (0, 1, 90, 200):
        to = {0: 1, 1: 90, 90: 200, 200: len(docs)}[at]
        best = _scan(np.arange(at, to), pa.array(docs[at:to], pa.list_(pa.string())), ix, k, least, best)
    got = [(int(q), int(r), float(s)) for q, r, s in zip(*best)]
    assert sorted(got) == sorted(_brute(kernel, qs, docs, k, least))


def test_search_work_follows_rare_words():
    """Rows that share only the words of every row are not counted out once the k best are known."""
    rng = np.random.default_rng(2)
    hot = [f"hot{i}" for i in range(20)]
    docs = [[*hot, f"own{i}", f"too{i}"] for i in range(20_000)]
    qs = [[*hot, f"own{i}", f"too{i}"] for i in rng.choice(20_000, 50, replace=False)]
    ix = TokenOverlap(list(range(50)), qs)
    mine = {int(q[-1][3:]) for q in qs}
    order = np.array(sorted(mine) + [i for i in range(20_000) if i not in mine])
    best = _scan(order, pa.array([docs[i] for i in order], pa.list_(pa.string())), ix, 1, 1)
    assert [(int(q), int(r)) for q, r, _ in zip(*best)] == [(i, int(q[-1][3:])) for i, q in enumerate(qs)]
    postings = 20_000 * 50 * len(hot)
    assert ix.work < postings / 100


def test_post_filter_may_return_fewer(spark):
    bank = spark.createDataFrame([(i, [1.0 - i / 100], "x" if i >= 15 else "y") for i in range(40)], "rid bigint, item array<double>, tag string")
    q = spark.createDataFrame([(0, [1.0])], "qid int, item array<double>")
    out = V.search_postfilter(q, bank.select("rid", "item"), bank.select("rid", "tag"), {"tag": "x"}, k=3)
    assert out.count() == 0  # the first fifteen are all filtered away although 25 rows match


def test_sharded_oversamples_per_shard(data):
    q, b, qd, bd = data
    out = V.search_sharded(qd, bd.select("rid", "item"), bd.select("rid", "g"), "g", {"g": [1]}, 5)
    got = {(r["qid"], r["rid"], r["score"], r["rank"]) for r in out.collect()}
    assert got == want(q, b, 5, [i for i in range(300) if i % 4 == 1])


def test_priority_merge_first_source_wins_and_blanks_stay(spark):
    s = "qid int, rid string, score double, rank int"
    a = spark.createDataFrame([(1, "x", 0.2, 1), (1, "", 0.1, 2)], s)
    b = spark.createDataFrame([(1, "x", 0.9, 1), (1, "", 0.5, 2), (1, "y", 0.4, 3)], s)
    rows = V.priority_merge([(a, "text", 1.0), (b, "tables", 1.0)], 10).orderBy("rank").collect()
    assert [(r["rid"], r["score"], r["source"]) for r in rows] == [("", 0.5, "tables"), ("y", 0.4, "tables"), ("x", 0.2, "text"), ("", 0.1, "text")]


def test_evidence_first_only_short_queries_get_raw(spark):
    s = "qid int, rid string, score double, rank int"
    ev = spark.createDataFrame([(1, "a", 0.5, 1), (2, "b", 0.5, 1), (2, "c", 0.4, 2)], s)
    raw = spark.createDataFrame([(1, "r", 1.0, 1), (2, "r", 1.0, 1)], s)
    rows = V.evidence_first_merge(ev, raw, k=2, min_items=2).collect()
    assert {(r["qid"], r["rid"]) for r in rows} == {(1, "r"), (1, "a"), (2, "b"), (2, "c")}


def test_dimension_mismatch_raises(spark):
    df = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="dimension mismatch"):
        df.select(V.dot(F.col("a"), F.col("b"))).collect()


def test_ragged_and_null_vectors_raise_in_search(spark):
    kernel = InnerProduct(["q"], [[1.0, 0.0, 0.0, 0.0]])
    for rows in ([[1.0] * 2, [1.0] * 6], [[1.0] * 4, None], [[1.0] * 3, [1.0] * 3]):
        with pytest.raises(ValueError, match="dimension mismatch"):
            list(kernel.parts(np.arange(2), pa.array(rows, pa.list_(pa.float64())), 1, 0.0))
    assert list(kernel.parts(np.arange(1), pa.array([[1.0] * 4], pa.list_(pa.float64())), 1, 0.0))


def test_shingles(one):
    assert one(R.char_shingles(F.col("c")), c="a b\ncd") == ["abc", "bcd"]
    assert one(R.char_shingles(F.col("c")), c="ab") == ["ab"]


def test_topk_is_monotone_in_k(data):
    _, _, qd, bd = data
    small = {(r["qid"], r["rid"]) for r in V.search(qd, bd.select("rid", "item"), 3).collect()}
    large = {(r["qid"], r["rid"]) for r in V.search(qd, bd.select("rid", "item"), 9).collect()}
    assert small <= large


def test_shingles_of_any_text(one):
    for s in ("", "a", "abc", "abcabcabd", "🙂é 中\u3000x\x1fy🙂é中", "aaaaaaa", None):
        t = None if s is None else "".join(s.split())
        for k in (1, 2, 3, 5):
            want = None if s is None else ({t} - {""} if len(t) < k else {t[i : i + k] for i in range(len(t) - k + 1)})
            got = one(R.char_shingles(F.col("c"), k), c=s)
            assert got is None and want is None or (set(got) == want and len(got) == len(want))


def test_shingles_are_cut_not_grown(spark):
    plan = spark.range(1).select(R.char_shingles(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan  # each gram was made three times before
