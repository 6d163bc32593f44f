"""De-duplication and chunking: brute force, metamorphic checks, forced fallbacks."""

import random

import pytest
from pyspark.sql import functions as F

from evisift.operators import chunking as K, dedupe as D


def planted(n=240, seed=3):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(30)]
    out = set()
    while len(out) < n:
        b = rng.choice(base)
        for _ in range(rng.randint(0, 4)):
            b ^= 1 << rng.randrange(64)
        out.add(b)
    vals = list(out)
    rng.shuffle(vals)
    return [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(vals)]


def brute(rows, t):
    u = [(i, v & (2**64 - 1)) for i, v in rows]
    return {(a, b, (x ^ y).bit_count()) for a, x in u for b, y in u if a < b and (x ^ y).bit_count() <= t}


@pytest.mark.parametrize("kw", [{}, {"n_blocks": 4}, {"hot_bucket": 1}])
def test_near_pairs_equal_brute_force(spark, kw):
    rows = planted()
    df = spark.createDataFrame(rows, "ord bigint, fp bigint")
    got = {(r["a"], r["b"], r["dist"]) for r in D.near_pairs(df, 3, **kw).collect()}
    assert got == brute(rows, 3)


def test_greedy_equals_sequential(spark):
    rows = planted(300, 9)
    u = [(i, v & (2**64 - 1)) for i, v in rows]
    kept = []
    for i, v in u:
        if all((v ^ w).bit_count() > 3 for _, w in kept):
            kept.append((i, v))
    fps = spark.createDataFrame([(i, f"{v:016x}") for i, v in u], "ord bigint, fp string")
    got = {r["ord"] for r in D.near_dedupe(fps).where("status = 'kept'").collect()}
    assert got == {i for i, _ in kept}


def test_order_decides_chains(spark):
    a, b, c = 0, 0b111, 0b111111  # a~b, b~c, a!~c
    for order, want in [([a, b, c], {0, 2}), ([b, a, c], {0})]:
        fps = spark.createDataFrame([(i, f"{v:016x}") for i, v in enumerate(order)], "ord bigint, fp string")
        assert {r["ord"] for r in D.near_dedupe(fps).where("status = 'kept'").collect()} == want


def greedy_py(pairs):
    gone = set()
    for a, b in sorted(pairs, key=lambda p: p[1]):
        if a not in gone:
            gone.add(b)
    return gone


@pytest.mark.parametrize("task_edges", [200_000, 40, 3])
def test_greedy_over_small_and_giant_components(spark, task_edges):
    """Hubs, cliques, short chains and a tangle: whole components in tasks and giant ones in rounds agree."""
    rng = random.Random(4)
    pairs = {(0, b) for b in range(1, 60)} | {(a, b) for a in range(100, 110) for b in range(a + 1, 110)}
    pairs |= {(a, a + 1) for a in range(200, 209)}
    ids = rng.sample(range(1000, 5000), 60)
    pairs |= {tuple(sorted(rng.sample(ids, 2))) for _ in range(90)}
    df = spark.createDataFrame(sorted(pairs), "a bigint, b bigint").repartition(4)
    got = [r["id"] for r in D.greedy_keep(df, task_edges=task_edges).collect()]
    assert len(got) == len(set(got)) and set(got) == greedy_py(pairs)
    assert D.greedy_keep(df.limit(0)).count() == 0


def test_long_chain_settles_in_few_jobs(spark):
    n = 5000
    df = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    sc = spark.sparkContext
    sc.setJobGroup("long chain", "greedy keep")
    try:
        got = {r["id"] for r in D.greedy_keep(df).collect()}
        jobs = len(sc.statusTracker().getJobIdsForGroup("long chain"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == set(range(1, n, 2))
    assert jobs < 400


def test_exact_dedupe_keeps_first_with_a_hot_key(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    out = D.first_per_key(df, "k", "id")
    assert out.count() == 2001 and out.where("k = 'hot'").first()["id"] == 0


def windows_py(toks, size, step, stop):
    out = []
    for s in range(0, len(toks), step):
        out.append((s, min(len(toks), s + size)))
        if stop and s + size >= len(toks):
            break
    return out


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 10, 11])
def test_windows_with_and_without_stop(spark, n):
    df = spark.createDataFrame([([str(i) for i in range(n)],)], "t array<string>")
    toks = [str(i) for i in range(n)]
    r = df.select(K.windows(F.col("t"), 4, 2).alias("w"), K.strided_blocks(F.col("t"), 4, 2, False).alias("b"), K.strided_blocks(F.col("t"), 4, 2).alias("f")).first()
    assert [(w["start"], w["end"]) for w in r["w"]] == windows_py(toks, 4, 2, True)
    assert [(w["start"], w["end"]) for w in r["b"]] == windows_py(toks, 4, 2, False)
    assert [(w["start"], w["end"]) for w in r["f"]] == [x for x in windows_py(toks, 4, 2, False) if x[1] - x[0] == 4]


def test_overlap_must_be_smaller(spark):
    with pytest.raises(ValueError):
        K.windows(F.array(), 4, 4)


def test_chunks_cover_all_words(spark):
    text = " ".join(f"w{i}" for i in range(1000))
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    rows = K.explode_windows(df, K.word_chunks(F.col("text")), ["doc_id"], "chunk").orderBy("chunk_no").collect()
    assert rows[0]["start"] == 0 and rows[-1]["end"] == 1000
    assert all(a["end"] >= b["start"] for a, b in zip(rows, rows[1:]))
