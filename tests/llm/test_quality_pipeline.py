import hashlib
import importlib
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evisift.llm import quality
from evisift.llm.decontaminate import words_of
from evisift.llm.pii import DEMO_KEY, find_values, pseudonymise
from evisift.llm.quality import Logistic, calibrate, co_train, meta_view, text_view
from evisift.llm.simhash import shingle_set

SF = "/root/testdata/sf0.01"
ROOT = Path(__file__).resolve().parents[2]


def test_views_are_finite_for_any_text():
    for raw in [b"", b"a", b"ab", b"abc", b"\xff\xfe\x00", b"word " * 300_000, "é漢".encode() * 9, b"\n" * 50, b" "]:
        assert np.isfinite(text_view(raw)).all() and np.isfinite(meta_view(raw, None, None, None)).all()
    assert np.isfinite(meta_view(b"x", "src", "en", -5)).all()


def test_logistic_and_calibration():
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 5)).astype(np.float32)
    y = (x[:, 0] - x[:, 1] > 0).astype(float)
    assert ((Logistic().fit(x, y).margin(x) > 0) == y).mean() > 0.97
    p = 1 / (1 + np.exp(-(2 * x[:, 0] - 1)))
    a, b = calibrate(x[:, 0].astype(float) * 4, (r.random(400) < p).astype(float))
    assert 0.25 < a < 0.9 and -1.6 < b < -0.4


def test_co_training_helps_a_view_with_few_labels():
    """Each class has two clusters in the text view; only one is labelled. The metadata view tells them all."""
    r = np.random.default_rng(2)
    y = r.integers(0, 2, 600)
    side = r.integers(0, 2, 600)
    text = np.column_stack([np.where(side, 0, 4 * y - 2), np.where(side, 4 * y - 2, 0), side * 3]) + r.normal(size=(600, 3)) * 0.6
    meta = np.column_stack([4 * y - 2, r.normal(size=600)]) + r.normal(size=(600, 2)) * 0.8
    first = np.flatnonzero(side == 0)[:60]
    rest = np.setdiff1d(np.arange(600), first)
    views = [text.astype(np.float32), meta.astype(np.float32)]
    alone = co_train([v[first] for v in views], y[first].astype(float), [v[rest] for v in views], rounds=0)
    both = co_train([v[first] for v in views], y[first].astype(float), [v[rest] for v in views], rounds=4, share=0.15)
    right = lambda m: ((m.views[0].margin(views[0][rest]) > 0) == y[rest]).mean()
    assert right(both) > right(alone) + 0.1 and ((both.score([v[rest] for v in views]) > 0.5) == y[rest]).mean() > 0.95


def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.xxhash64("doc_id") % 5 == 0
    model = quality.fit(docs, labels.where(~held))
    rows = quality.score(docs, model).join(labels.where(held), "doc_id").select("keep", "quality", "p_text", "p_meta").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert np.mean([r.keep for r in good]) > 0.985 and np.mean([not r.keep for r in bad]) > 0.97
    assert np.mean([(r.p_meta > 0.5) == r.quality for r in rows]) > 0.97 and np.mean([(r.p_text > 0.5) == r.quality for r in rows]) > 0.97


def test_quality_edge_cases(spark):
    good, bad = "The house, and the garden of it, are in the town. ", "buy### now$$$ buy%%% "
    rows = [(i, (good if i % 2 else bad) * (1 + i % 7), "en", "s", 10) for i in range(200)] + [(None, None, None, None, None), (500, "", "en", None, 0), (501, None, "en", "s", 5), (3, good, "en", "s", 10), (3, good, "en", "s", 10), (502, good * 3000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'clash' AS keep")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(3, 1), (5, 0), (150, 7), (151, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    out = quality.score(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r.quality_score <= 1 and r.keep in (True, False) for r in out)
    assert all(r.keep == bool(r.doc_id % 2) for r in out if r.doc_id is not None and 120 < r.doc_id < 200)
    assert quality.score(docs.limit(0), model).count() == 0
    few = quality.fit(docs, labels, labelled=40, unlabelled=10)
    assert isinstance(few, quality.CoTrained)
    none = quality.score(docs, quality.fit(docs, labels.limit(0))).collect()
    assert {(r.quality_score, r.keep) for r in none} == {(0.5, True)}, "without labels all stay"


def test_query_op8(spark):
    out = quality.op8_co_training(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert out.count() == docs.count() and "text" not in out.columns


@pytest.fixture(scope="module")
def staged(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), "test")
        out.append({r.doc_id: r for r in docs.collect()})
    return out


def test_stages(spark, staged):
    start = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept, single, clean, safe, coded = staged
    assert all(start[i] == r for i, r in kept.items()), "a filter changes no row"
    right = [(i in kept) == bool(q) for i, q in labels.items()]
    assert np.mean(right) > 0.97

    sets = {i: set(shingle_set(r.text.encode(), 5).tolist()) for i, r in kept.items()}
    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    common = {}
    for docs in where.values():
        for i in docs:
            for j in docs:
                if i < j:
                    common[i, j] = common.get((i, j), 0) + 1
    alike = {(i, j) for (i, j), n in common.items() if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n)}
    gone = set(kept) - set(single)
    # A removed document has one like it; of two that are alike, nearly always only one is left.
    assert all(any((min(i, j), max(i, j)) in alike for j in kept) for i in gone)
    assert sum(i in single and j in single for i, j in alike) <= 0.03 * len(alike) and gone

    items = [words_of(r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + min(10, len(w))]) for w in items for i in range(len(w) - min(10, len(w)) + 1)}
    sizes = {len(g) for g in grams}
    leak = {i for i, r in single.items() for w in [words_of(r.text.encode())] for n in sizes if any(tuple(w[k : k + n]) in grams for k in range(len(w) - n + 1))}
    assert leak and sorted(clean) == sorted(set(single) - leak)

    for i, r in safe.items():
        old = clean[i]
        assert r.text == pseudonymise(old.text, DEMO_KEY)[0] and (r.lang, r.source) == (old.lang, old.source)
        assert r.n_chars == (len(r.text) if find_values(old.text) else old.n_chars)
    assert sorted(safe) == sorted(clean) == sorted(coded)
    assert all(r.n_pieces == len(r.ids) and r.text == safe[i].text for i, r in coded.items())


def test_run_equals_the_stages(spark, staged):
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert out == staged[-1]


def test_stages_with_nulls_repeats_and_clashing_columns(spark, staged):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    rows = [(None, None, None, None, None), (9001, None, "en", None, 3), (9002, "", None, "s", 0), (9002, "", None, "s", 0), (None, "", "en", "s", 0), (9003, "the " * 40_000, "en", "s", 160_000)]
    more = spark.createDataFrame(rows, docs.schema)
    dirty = docs.unionByName(more).unionByName(docs.limit(3)).selectExpr("keep", "*") if "keep" in docs.columns else docs.unionByName(more).unionByName(docs.limit(3)).selectExpr("'k' AS keep", "*", "1 AS hits", "2 AS ids", "map('a', 1) AS root", "3 AS _extra0")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, dirty, SF)
        assert out.columns[: len(dirty.columns)] == dirty.columns, name
        assert out.count() <= dirty.count() and stage(spark, dirty.limit(0), SF).count() == 0, name
    single = dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, dirty, SF).collect()
    assert len({(r.doc_id, r.text) for r in single}) == len(single)
    blank = [r for r in single if not (r.text or "").strip()]
    assert [r.doc_id for r in blank] == [9001], "null, empty and blank texts are one group; a row with an id stays"


def test_entry_has_every_query_and_works_without_this_package():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert {n.split("_")[0] for n in names} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    code = "import sys; sys.modules['evisift.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op10_') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, timeout=300).returncode == 0


def test_nothing_else_imports_this_package():
    for f in (ROOT / "evisift").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT / "evisift").parts:
            assert ".llm" not in f.read_text() and "corpus_pipeline" not in f.read_text(), f
    assert hashlib.sha256(b"").hexdigest()


def test_pseudo_labels_come_from_all_unlabelled_documents(spark):
    """The surest of all rows are chosen, copies once, whatever their hash."""
    r = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{x}" for x in r.integers(0, 50, 1 + i % 40)) + "!#$" * (i % 9), "en", f"s{i % 3}", i) for i in range(400)]
    rows += [(1000 + i, *rows[7][1:]) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
    made = quality.features(docs)
    a = {r.doc_id: (text_view(r.text.encode()), meta_view(r.text.encode(), r.source, r.lang, r.n_chars)) for r in docs.collect()}
    views = []
    for v in (0, 1):
        x = np.stack([a[i][v] for i in range(400)])
        views.append(Logistic().fit(x.astype(np.float32), (np.arange(400) % 9 < 3 + v).astype(float)))
    skipped = spark.createDataFrame([(i,) for i in range(0, 400, 5)], "doc_id long")
    got = {(r.doc_id, r.view, r.y) for r in quality.surest(made, skipped, views, 0.4, 20).collect()}
    for v in (0, 1):
        m = {i: float(views[v].margin(np.float32(np.float16(a[i][v]) if v == 0 else a[i][v])[None])[0]) for i in a if i % 5 or i >= 400}
        for y, n in ((1, 8), (0, 12)):
            mine = sorted((m[i] if y else -m[i] for i, w, l in got if (w, l) == (v, y)), reverse=True)
            alike = {}
            for i, x in m.items():
                alike.setdefault(rows[i][1:] if i < 400 else rows[7][1:], x if y else -x)
            want = sorted((x for x in alike.values() if x > 1), reverse=True)[:n]
            assert mine == pytest.approx(want, abs=2e-3) and want
