"""Cell index: every row indexed, exact scores, recall."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from evisift.operators import cells as C, vectors as V
from evisift.plans import CATALOGUE


def test_all_cells_probed_is_the_exact_search(spark):
    r = np.random.default_rng(2)
    bank = spark.createDataFrame([(i, r.normal(size=8).tolist()) for i in range(400)], "rid long, item array<double>")
    q = spark.createDataFrame([(i, r.normal(size=8).tolist()) for i in range(5)], "qid long, item array<double>")
    centres = C.fit_cells(bank, cells=6, rows=100)
    indexed = C.index_cells(bank, centres)
    assert indexed.where("cell IS NULL").count() == 0 and indexed.count() == 400
    rows = lambda df: sorted((x.qid, x.rid, x.score, x["rank"]) for x in df.select("qid", "rid", "score", "rank").collect())
    exact = V.search(q, bank, 7)
    assert rows(C.search_cells(q, indexed, centres, 7, 6)) == rows(exact)
    part = C.search_cells(q, indexed, centres, 7, 2)
    assert {(x.qid, x.rid) for x in part.collect()} <= {(i, j) for i in range(5) for j in range(400)}
    assert C.recall(exact, exact).agg(F.min("recall")).first()[0] == 1.0


def test_recall_on_given_vectors(spark):
    got = CATALOGUE["ann_recall"].fn(spark, "/root/testdata/sf0.1").collect()
    assert len(got) == 10 and sum(r.recall for r in got) / len(got) >= 0.9


def test_coded_search_is_exact_when_all_is_kept(spark):
    r = np.random.default_rng(4)
    bank = spark.createDataFrame([(i, r.normal(size=10).tolist()) for i in range(300)], "rid long, item array<double>").repartition(3)
    q = bank.where("rid % 50 = 0").select(F.col("rid").alias("qid"), "item")
    model = C.fit_quantizer(bank, 300, slices=3, codes=16, rows=200)
    assert len(model.centres) == 17 and [b.shape for b in model.books] == [(16, 4), (16, 3), (16, 3)]
    coded = C.encode_bank(bank, model)
    assert coded.count() == 300 and coded.where("size(item) <> 4 or item is null").count() == 0
    rows = lambda df: sorted((x.qid, x.rid, x.score, x["rank"]) for x in df.collect())
    exact = V.search(q, bank, 5).select("qid", "rid", "score", "rank")
    assert rows(C.search_coded(q, coded, bank, model, 5, 300, 17)) == rows(exact)
    few = C.search_coded(q, coded, bank, model, 5, 20, 9)
    assert few.groupBy("qid").count().where("count <> 5").count() == 0
    assert C.search_coded(q.limit(0), coded, bank, model, 5, 20, 9).count() == 0


def test_codes_score_as_their_decoded_vectors():
    r = np.random.default_rng(6)
    vecs = r.normal(size=(120, 6))
    centres = vecs[:5]
    rest = vecs - centres[C._nearest(vecs, centres)]
    model = C.Quantizer(centres, [C._codebook(p, 8, 1) for p in np.split(rest, 2, axis=1)])
    codes = model.encode(vecs)
    back = centres[codes[:, 0]] + np.concatenate([b[codes[:, m + 1]] for m, b in enumerate(model.books)], axis=1)
    assert ((vecs - back) ** 2).sum() < (rest**2).sum() / 2
    kernel = C.CodedInnerProduct([0, 1], vecs[:2].tolist(), model, 5)
    got = {}
    for q, i, s in kernel.parts(np.arange(120), pa.array(codes.tolist(), pa.list_(pa.int32())), 120, kernel.bars(-np.inf)):
        got.update({(int(a), int(b)): float(c) for a, b, c in zip(q, i, s)})
    assert sorted(got) == [(a, b) for a in range(2) for b in range(120)]
    assert all(abs(s - vecs[a] @ back[b]) < 2e-6 for (a, b), s in got.items())


def test_coded_recall_on_given_vectors(spark):
    got = CATALOGUE["coded_recall"].fn(spark, "/root/testdata/sf0.1").collect()
    assert len(got) == 20 and all(r.rows_read * 10 <= r.rows_in_all for r in got)
    assert sum(r.recall for r in got) / len(got) >= 0.9


def test_rounds_stop_by_score_by_pool_and_by_number(spark):
    from evisift.operators.rounds import select_in_steps

    rows = [("long", i, 1.0, i) for i in range(20)] + [("drop", i, 0.9 if i < 2 else 0.1, i) for i in range(9)] + [("short", 0, 0.5, 0), ("short", 0, 0.5, 3), ("poor", 1, 0.0, 0)]
    pool = spark.createDataFrame(rows, "qid string, rid int, score double, rank int")
    got = {}
    for r in select_in_steps(pool, 2, 3, 0.3).collect():
        got.setdefault(r.qid, []).append((r.rid, r.step))
    assert {q: sorted(x) for q, x in got.items()} == {"long": [(i, i // 2) for i in range(6)], "drop": [(0, 0), (1, 0)], "short": [(0, 0)]}
    assert select_in_steps(pool.limit(0), 2, 3, 0.3).count() == 0
