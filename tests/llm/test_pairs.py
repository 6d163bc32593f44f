import collections
import hashlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from evisift.llm import decontaminate, embeddings, repeats, simhash
from evisift.llm.bits import Bits
from evisift.llm.common import components
from evisift.llm.decontaminate import digest, gram_hashes, winnow, words_of
from evisift.llm.embeddings import embedding_groups
from evisift.llm.forest import Forest
from evisift.llm.repeats import remove_repeats
from evisift.llm.simhash import fingerprint, near_duplicate_groups, shingle_set, simhash_groups


def roots(n, edges):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return [find(i) for i in range(n)]


def test_components_of_chain_star_and_random_links(spark):
    r = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(200)] + [(300, 300 + i) for i in range(1, 150)] + [tuple(x) for x in r.integers(500, 900, (250, 2)).tolist()] + [(-5, 7), (950, 950)]
    shifted = [(a + 10, b + 10) for a, b in edges]
    want = roots(1000, shifted)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {n: want[n + 10] - 10 for n in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_keeps_components_with_few_edges():
    r = np.random.default_rng(0)
    links = collections.defaultdict(set)
    for a, b in r.integers(0, 60, (90, 2)).tolist():
        links[a].add(b)
    f = Forest(60)
    for a, bs in links.items():
        f.link(a, np.array(sorted(bs)))
    want = roots(60, [(a, b) for a, bs in links.items() for b in bs])
    assert f.label.tolist() == want == roots(60, f.edges) and len(f.edges) == 60 - len(set(want))


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_and_spark_hash(spark):
    for t in ["", " \t\n", "One", "one two", "a b c", "a b c a b c a b c", "É é\x0bA\x0cb " * 50]:
        assert fingerprint(t.encode()) == plain_fingerprint(t)
    assert spark.sql("SELECT xxhash64('a b c') AS h").first().h % 2**64 == fingerprint(b"A b C")


def brute_groups(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    comp = collections.defaultdict(list)
    for i, r in enumerate(roots(len(rows), edges)):
        comp[r].append(i)
    out = collections.Counter()
    for members in comp.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            out[(rows[i][0], fps[i], min(ids, default=None))] += 1
    return out


def test_simhash_groups_equal_brute_force(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(10 + i, base + " " + " ".join(f"x{i}{j}" for j in range(i % 4))) for i in range(60)]
    rows += [(1000 + i, base) for i in range(40)] + [(1, None), (2, ""), (3, " \n"), (None, "alone here now"), (None, base), (4, "tiny"), (4, "tiny"), (5, "word " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS component_id")
    got = collections.Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash_groups(df).collect())
    assert got == brute_groups(rows)
    assert simhash_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("home, probe", [(4096, 32_768), (16, 24)])
def test_links_lose_nothing_in_dense_groups_and_tiles(spark, monkeypatch, home, probe):
    """Random fingerprints and balls around a few of them, with whole and split cells."""
    monkeypatch.setattr(simhash, "HOME", home)
    monkeypatch.setattr(simhash, "PROBE", probe)
    r = np.random.default_rng(1)
    fps = set(r.integers(-(2**63), 2**63, 1500).tolist())
    for c in list(fps)[:6]:
        for _ in range(80):
            x = c % 2**64
            for b in r.integers(0, 64, r.integers(1, 5)):
                x ^= 1 << int(b)
            fps.add(x - 2**64 if x >= 2**63 else x)
    fps = sorted(fps)
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(np.array(fps[:i], np.int64).view(np.uint64) ^ np.uint64(fps[i] % 2**64)) <= 3).tolist()])
    found = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    at = {f: i for i, f in enumerate(fps)}
    edges = [(at[e.a], at[e.b]) for e in found.collect()]
    assert roots(len(fps), edges) == want and len(set(want)) < len(fps) - 300


def jaccard(a, b):
    x, y = (set(shingle_set((t or "").encode(), 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_near_duplicate_groups_against_brute_force(spark):
    """No pair below the similarity is joined; nearly all pairs at it are, and all close ones."""
    r = np.random.default_rng(11)
    vocabulary = [f"word{i}" for i in range(3000)] + ["the", "of", "and", "to"] * 150
    draw = lambda n: [vocabulary[i] for i in r.integers(0, len(vocabulary), n)]
    rows, at = [], 0
    for _ in range(60):
        words = draw(int(r.integers(60, 400)))
        for changes in (0, 0, 1, 2, 4, 9, 20):
            new = list(words)
            for i in r.integers(0, len(words), changes):
                new[i] = f"new{r.integers(0, 10**9)}"
            rows.append((at, " ".join(new)))
            at += 1
    rows += [(at, None), (at + 1, ""), (at + 2, " \n"), (at + 3, "two words"), (at + 4, "Two  words"), (None, "two words"), (at + 5, rows[0][1]), (at + 5, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fps", "'x' AS k1", "'y' AS node")
    out = near_duplicate_groups(df).collect()
    assert len(out) == len(rows)
    got = {x.doc_id: x.component_id for x in out if x.doc_id is not None}
    sure = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(rows[i][1], rows[j][1]) >= 0.8]
    want = roots(len(rows), sure)
    ids = [x for x, _ in rows]
    close = [(i, j) for i, j in sure if ids[i] is not None and ids[j] is not None]
    assert np.mean([got[ids[i]] == got[ids[j]] for i, j in close]) > 0.97
    assert all(got[ids[i]] == got[ids[j]] for i, j in close if jaccard(rows[i][1], rows[j][1]) >= 0.9)
    assert all(want[i] == want[ids.index(got[ids[i]])] for i in range(len(rows)) if ids[i] is not None), "nothing below the similarity is joined"
    assert got[at] == got[at + 1] == got[at + 2] == at and got[at + 3] == got[at + 4] == at + 3
    assert near_duplicate_groups(df.limit(0)).count() == 0


def crowd_reordered(r):
    """Tables of the same lines in other orders (one word set), a near copy of each elsewhere in the crowd."""
    lines = [" ".join(f"w{r.integers(0, 400)}" for _ in range(8)) for _ in range(40)]
    texts = []
    for _ in range(30):
        own = [lines[i] for i in r.permutation(len(lines))]
        texts += [" ".join(own), " ".join([*own[2:], *own[:2]])]
    return texts


def crowd_forms(r):
    """Forms: long common words, own fields; each filled form has a copy with one field changed."""
    common = [f"form{i}" for i in range(240)]
    texts = []
    for _ in range(30):
        own = list(common)
        at = r.choice(len(common), 14, replace=False)
        for i in at:
            own[i] = f"x{r.integers(0, 10**9)}"
        texts.append(" ".join(own))
        own[at[0]] = f"x{r.integers(0, 10**9)}"
        texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("block", [256, 3])
@pytest.mark.parametrize("make", [crowd_reordered, crowd_forms])
def test_near_copies_in_a_crowd_of_like_texts_meet(spark, monkeypatch, make, block):
    """The forest's links fail inside the crowd; the pairs behind them are still looked at."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    texts = make(np.random.default_rng(5))
    sure = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    want = roots(len(texts), sure)
    assert 20 < len(set(want)) < 40
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in near_duplicate_groups(df).collect()}
    assert [got[i] for i in range(len(texts))] == want


def passages(r):
    """Texts of own words around one of a few long passages; every tenth has a near copy."""
    shared = [" ".join(f"p{r.integers(0, 10**9)}" for _ in range(60)) for _ in range(12)]
    texts = []
    for i in range(80):
        own = [f"x{r.integers(0, 10**9)}" for _ in range(140)]
        texts.append(" ".join([*own[:70], shared[i % 12], *own[70:]]))
        if i % 10 == 0:
            texts.append(" ".join(["new", *own[1:70], shared[i % 12], *own[70:]]))
    return texts


def test_texts_with_common_passages_are_not_compared(spark, monkeypatch):
    """Texts that share a passage and cannot reach the similarity are no candidates; what can is all there."""
    texts = passages(np.random.default_rng(3))
    sure = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    assert len(sure) == 8
    compared = []
    monkeypatch.setattr(simhash, "similar", lambda pairs, sets, s, own=simhash.similar: (compared.append(pairs.count()), own(pairs, sets, s))[1])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in near_duplicate_groups(df).collect()}
    assert [got[i] for i in range(len(texts))] == roots(len(texts), sure)
    assert 8 <= sum(compared) < 40, "only the sixteen texts with a partner meet"


@pytest.mark.parametrize("together, part, span", [(1 << 21, 1 << 20, 1 << 16), (500, 300, 1 << 16), (1, 1 << 20, 3), (1 << 21, 64, 2)])
def test_lone_shingles_against_brute_force(spark, monkeypatch, together, part, span):
    for name, value in (("TOGETHER", together), ("PART", part), ("SPAN", span)):
        monkeypatch.setattr(simhash, name, value)
    texts = [*passages(np.random.default_rng(4)), "", "one two", "One  two"]
    held = [(7 * i + (i % 3) * (1 << 40), shingle_set(t.encode(), 5)) for i, t in enumerate(texts)]
    count = collections.Counter(x for _, s in held for x in s.tolist())
    want = {n: sum(count[x] == 1 for x in s.tolist() if x % 2 == 0) for n, s in held}
    df = spark.createDataFrame([(n, bytearray(s.tobytes())) for n, s in held], "node long, s binary").repartition(3)
    assert {x.node: x.lone for x in simhash.lone(df).collect()} == {n: w for n, w in want.items() if w}
    kept = {n for n, s in held if want[n] <= len(s) - np.ceil(0.8 * len(s) - 1e-9)}
    assert {x.node for x in simhash.partnered(df, 0.8).collect()} == kept and 18 < len(kept) < 40
    assert simhash.partnered(df.limit(0), 0.8).count() == 0


def test_simhash_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    out = simhash.op10_simhash_groups(spark, "/root/testdata/sf0.001").collect()
    assert collections.Counter((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in out) == brute_groups(rows)
    assert all(len(r.fingerprint) == 16 and r.fingerprint == r.fingerprint.lower() for r in out)


def brute_hits(text, items, window=10):
    words = words_of((text or "").encode())
    hit, names = set(), set()
    for name, t in items:
        w = words_of((t or "").encode())
        n = min(window, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                names.add(name)
    return len(words), hit, sorted(names)


def check_hits(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'clash' AS hits")
    b = spark.createDataFrame(items, "item_id string, text string")
    out = decontaminate.decontaminate(d, b, **kw).collect()
    assert len(out) == len(docs)
    want = collections.Counter((i, n, tuple(sorted(h)), tuple(x)) for i, t in docs for n, h, x in [brute_hits(t, items)])
    got = collections.Counter((r.doc_id, r.n_words, tuple(p for x in r.hits for p in range(x.start, x.end)), tuple(r["items"])) for r in out)
    assert got == want


def test_winnowing_equals_brute_force(spark):
    r = np.random.default_rng(2)
    vocabulary = ["a", "b", "c", "the", "É", "x1"]
    draw = lambda n: " ".join(vocabulary[i] for i in r.integers(0, 6, n))
    items = [(f"i{k}", draw(n)) for k, n in enumerate([30, 10, 12, 3, 1, 7, 9, 11, 60])] + [("i1", draw(14)), ("none", ""), ("void", None), ("long", "q " * 30)]
    docs = [(i, draw(int(r.integers(0, 90)))) for i in range(60)] + [(100, None), (101, ""), (102, "!!"), (103, (items[0][1] + ". ") * 3), (104, draw(20_000)), (105, "Q, q " * 20), (7, items[2][1].upper().replace("É", "é"))]
    docs += docs[:2]
    check_hits(spark, docs, items)
    check_hits(spark, docs[::5], items, block_words=40)
    check_hits(spark, docs[::9], items, k=10)
    check_hits(spark, docs[::9], items, k=1)


def test_winnowing_with_empty_tables(spark):
    items = spark.createDataFrame([], "item_id string, text string")
    docs = spark.createDataFrame([(1, "some words here"), (2, None)], "doc_id long, text string")
    out = {r.doc_id: (r.n_words, r.hits, r["items"]) for r in decontaminate.decontaminate(docs, items).collect()}
    assert out == {1: (3, [], []), 2: (0, [], [])}
    assert decontaminate.decontaminate(docs.limit(0), docs.selectExpr("cast(doc_id AS string) AS item_id", "text")).count() == 0


def test_winnow_guarantee():
    r = np.random.default_rng(4)
    for _ in range(50):
        shared = r.integers(0, 4, 10)
        a, b = (np.concatenate([r.integers(0, 4, r.integers(0, 9)), shared, r.integers(0, 4, r.integers(0, 9))]) for _ in range(2))
        ha, hb = gram_hashes(a, 5), gram_hashes(b, 5)
        assert set(ha[winnow(ha, 6)].tolist()) & set(hb[winnow(hb, 6)].tolist())
    assert digest([]) == hashlib.sha256(b"").hexdigest()


def test_decontamination_query_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    got = decontaminate.op9_winnowing(spark, "/root/testdata/sf0.01").collect()
    cols = got[0].__fields__
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({decontaminate.OP9_SQL})").fetchall()
    assert collections.Counter(map(tuple, got)) == collections.Counter(want) and any(r.contaminated for r in got)


def brute_vectors(rows, threshold=0.98):
    def sound(v, g):
        return g is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n, edges = len(rows), []
    for i in range(n):
        for j in range(i):
            (_, a, g), (_, b, h) = rows[i], rows[j]
            if sound(a, g) and sound(b, h) and g == h and len(a) == len(b):
                a, b = np.array(a, float), np.array(b, float)
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= threshold:
                    edges.append((i, j))
    count = collections.Counter(x for e in edges for x in e)
    comp = collections.defaultdict(list)
    for i, r in enumerate(roots(n, edges)):
        comp[r].append(i)
    return collections.Counter((rows[i][0], count[i], min((rows[k][0] for k in m if rows[k][0] is not None), default=None)) for m in comp.values() for i in m)


@pytest.mark.parametrize("block", [1024, 7])
def test_embedding_groups_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    r = np.random.default_rng(6)
    centres = r.normal(size=(8, 20))
    rows = [(i, (centres[i % 8] + r.normal(size=20) * (0.02 + 0.1 * (i % 3))).tolist(), i % 2) for i in range(160)]
    rows += [(200 + i, rows[3][1], 1) for i in range(12)] + [(300, rows[3][1], 0), (301, [2 * x for x in rows[3][1]], 1)]
    rows += [(400, None, 1), (401, [0.0] * 20, 1), (402, [float("nan")] + [1.0] * 19, 1), (403, [None] + [1.0] * 19, 1), (404, [float("inf")] + [1.0] * 19, 1), (405, [1.0] * 20, None), (406, [], 1), (407, [1.0, 2.0], 1), (408, [2.0, 4.0], 1), (409, [-0.0, 1.0], 1), (410, [0.0, 1.0], 1)]
    rows += [(None, rows[3][1], 1), (5, rows[5][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS n_links", "2 AS node")
    out = embedding_groups(df).collect()
    assert collections.Counter((r.vec_id, r.n_links, r.component_id) for r in out) == brute_vectors(rows)
    assert embedding_groups(df.limit(0)).count() == 0
    assert {tuple(r) for r in embedding_groups(df.where("vec_id = 400")).collect()} == {(400, 0, 400)}


def test_tile_bound_drops_no_pair():
    r = np.random.default_rng(8)
    x = r.normal(size=(150, 40)) * np.linspace(2, 0.05, 40)
    x[75:] = x[:75] + r.normal(size=(75, 40)) * 0.05
    u = x / np.linalg.norm(x, axis=1)[:, None]
    i, j = embeddings.tile_links(x, x, u, u, np.triu(np.ones((150, 150), bool), 1), 0.98)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for a in range(150) for b in range(a + 1, 150) if u[a] @ u[b] >= 0.98}


def test_embedding_query_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    got = embeddings.op5_pca_tiles(spark, "/root/testdata/sf0.01").collect()
    want = con.execute(f"SELECT {', '.join(got[0].__fields__)} FROM ({embeddings.OP5_SQL})").fetchall()
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)


def brute_removed(raws, length):
    seen = collections.Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, np.int64)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        out.append(np.cumsum(gone[:-1]) > 0)
    return out


def check_repeats(spark, texts, length, gram):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'clash' AS spans")
    raws = [(t or "").encode() for t in texts]
    out = {r.doc_id: r for r in remove_repeats(df, length=length, gram=gram).collect()}
    assert len(out) == len(texts)
    for i, (raw, gone) in enumerate(zip(raws, brute_removed(raws, length), strict=True)):
        flags = np.zeros(len(raw), bool)
        for s, e in out[i].spans:
            flags[s:e] = True
        assert (flags == gone).all(), i
        assert bytes(out[i].kept) == bytes(np.frombuffer(raw, np.uint8)[~gone]) and out[i].n_bytes == len(raw)
        assert len(out[i].spans) == int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())


@pytest.mark.parametrize("length, gram, piece", [(200, 64, 1 << 18), (40, 16, 300), (40, 8, 1 << 18), (12, 4, 64)])
def test_repeats_equal_brute_force(spark, monkeypatch, length, gram, piece):
    monkeypatch.setattr(repeats, "PIECE", piece)
    r = np.random.default_rng(length)
    draw = lambda n: "".join("abcé \n"[i] for i in r.integers(0, 6, n))
    passages = [draw(n) for n in (length - 1, length, length + 1, 3 * length, 5 * length)]
    texts = [None, "", draw(length - 1), draw(3 * length)]
    for i in range(40):
        p = passages[i % 5]
        cut = int(r.integers(0, len(p))) if i % 3 == 0 else 0
        texts.append(draw(int(r.integers(0, 2 * length))) + p[cut:] + draw(int(r.integers(0, 2 * length))) + (p if i % 7 == 0 else ""))
    texts += [texts[5]] * 4 + ["z" * (2 * length), "ab" * length, "abc" * length + draw(50), passages[3] * 3, draw(2000) + "z" * (length - 1)]
    check_repeats(spark, texts, length, gram)


def test_repeats_of_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(df).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(df, length=40, gram=64)


def test_repeats_query(spark):
    docs = {r.doc_id: r.text.encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    gone = dict(zip(docs, brute_removed(list(docs.values()), 200), strict=True))
    out = repeats.op7_prefix_doubling(spark, "/root/testdata/sf0.001").collect()
    assert len(out) == len(docs) and sum(r.n_removed for r in out) > 0
    for r in out:
        raw, g = docs[r.doc_id], gone[r.doc_id]
        kept = bytes(np.frombuffer(raw, np.uint8)[~g])
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), int(g.sum()), int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())


def test_filter_lets_every_key_pass(spark):
    keys = np.random.default_rng(0).integers(-(2**63), 2**63, 5000)
    bits = Bits(spark.createDataFrame([(int(k),) for k in keys[:2000]], "k long"), "k")
    assert bits.has(keys[:2000].view(np.uint64)).all() and bits.has(keys[2000:].view(np.uint64)).sum() < 30
    none = Bits(spark.createDataFrame([], "k long"), "k")
    assert not none.has(keys.view(np.uint64)).any()
    assert spark.range(1).select(F.lit(1)).count() == 1
