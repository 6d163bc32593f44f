"""Physical plans: what must not be shuffled."""

import re

import pytest
from pyspark.sql import functions as F

from evisift.operators import joins as J
from evisift.plans import CATALOGUE

SF = "/root/testdata/sf0.001"


def exchanged(df):
    """Columns that leave some stage by a shuffle, from the executed plan's output lists."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    found = set()
    for block in re.split(r"\n\n", text):
        if re.match(r"\(\d+\) Exchange", block.strip()):
            found |= set(re.findall(r"(\w+)#\d+", block))
    return found


@pytest.mark.parametrize("name", ["vector_topk_sharded", "weighted_rerank", "list_rerank", "cosine_to_centroid", "reconstruction_error"])
def test_no_vector_or_text_is_shuffled(spark, monkeypatch, name):
    import evisift.plans.vectors as P

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(P, "spread", lambda df, key: df)  # the small-input helper deals rows out on purpose
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = exchanged(CATALOGUE[name].fn(spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The joined text of a pool row may move once it is one of the few; whole tables may not.
    assert not moved & {"embedding", "item"}
    assert name not in ("vector_topk_sharded", "cosine_to_centroid", "reconstruction_error") or "text" not in moved


def test_terms_of_any_number_of_lengths(spark):
    words = ["x" + "ab" * (i // 2) + "c" * (i % 2) for i in range(1, 2200)]
    terms = spark.createDataFrame([(w,) for w in words], "term string")
    text = "zz " + words[-1] + " y" + words[4]
    q = spark.createDataFrame([("q", text), ("none", "nothing here"), ("null", None)], "qid string, text string")
    got = {(r.qid, r.term) for r in J.contained_terms(q, terms).collect()}
    assert got == {("q", w) for w in words if w in text}
    assert J.contained_terms(q, terms.limit(0)).count() == 0


def test_short_and_long_terms_and_hot_heads(spark):
    terms = ["a", "ab", "abcdefgh", "abcdefghi", "abcdefgh jk", "", "ABC"]
    rows = [(f"q{i}", "xx abcdefgh jk" if i % 2 else "abcdefghi") for i in range(400)]
    t = spark.createDataFrame([(x,) for x in terms], "term string")
    for fold in (False, True):
        got = J.contained_terms(spark.createDataFrame(rows, "qid string, text string"), t, fold=fold).groupBy("qid").agg(F.sort_array(F.collect_list("term")).alias("ts")).collect()
        for r in got:
            text = dict(rows)[r.qid]
            assert r.ts == sorted(x for x in terms if x and (x.lower() if fold else x) in text)
        assert len(got) == 400


def test_workers_get_the_package_from_any_folder(tmp_path):
    """A query with Python code, started from a folder that does not hold the package."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = (
        f"import sys; sys.path.insert(0, {str(root)!r})\n"
        "import __spark_entry__ as e\nfrom evisift.session import local_session\n"
        "s = local_session(2, 2)\nassert e.entry(s).count() > 0\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, timeout=300, capture_output=True, text=True, env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr[-2000:]


def test_names_of_one_family_meet_few_texts(spark):
    """Texts meet the rarest gram of a name, not the head that all names share."""
    names = [f"Supplier#{i:09d}" for i in range(20_000)]
    texts = [(i, f"who is {names[(i * 7919) % 20_000].lower()} and supplier#x?") for i in range(20_000)]
    keys = spark.createDataFrame([(n.lower(),) for n in names], "key string")
    t = spark.createDataFrame(texts, "qid int, t string")
    met = J.anchored(t, J.anchors(keys)).groupBy("qid").count()
    assert met.agg(F.max("count")).first()[0] < 5
    found = J.term_places(t, keys).collect()
    assert len(found) == 20_000 and all(texts[r.qid][1][r.p : r.p + 18] == r.key for r in found)


def test_crowded_anchors_are_told_apart_by_a_second_gram(spark):
    import random

    rng = random.Random(3)
    # Every gram of a name is shared by many: names are pairs of a few long words.
    words = ["".join(rng.choice("ab") for _ in range(9)) for _ in range(40)]
    names = sorted({f"{a}{b}" for a in words for b in words} | {"aaaaaaaa", "ab", "é漢字"})
    at = J.anchors(spark.createDataFrame([(n,) for n in names], "key string")).collect()
    assert len(at) == len(names) and sum(r.gap is not None for r in at) > 200
    texts = [(i, "".join(rng.choice(words) for _ in range(6)) + rng.choice(["", "é漢字", " aaaaaaaaa"])) for i in range(60)] + [(99, ""), (98, None)]
    got = {(r.qid, r.p, r.key) for r in J.term_places(spark.createDataFrame(texts, "qid int, t string"), spark.createDataFrame([(n,) for n in names], "key string")).collect()}
    want = {(q, p, n) for q, t in texts if t for n in names for p in range(len(t)) if t.startswith(n, p)}
    assert got == want and len(want) > 200


def test_exploded_grams_of_names_are_never_broadcast(spark, monkeypatch):
    """Grams of the keys were broadcast, several hundred bytes for each of their places, through the driver."""
    plans, cut = [], J.cut_lineage

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(J, "cut_lineage", seen)
    names = spark.createDataFrame([(f"customer#{i:09d}",) for i in range(200)], "key string")
    J.anchors(names)
    assert plans and "BroadcastHashJoin" not in plans[0]
    texts = spark.createDataFrame([(i, f"where is customer#{i:09d}?") for i in range(200)], "qid int, t string")
    monkeypatch.setattr(J, "BROADCAST_LIMIT_BYTES", 0)  # more anchors than may be broadcast
    got = {(r.qid, r.p, r.key) for r in J.term_places(texts, names).collect()}
    assert got == {(i, 9, f"customer#{i:09d}") for i in range(200)}


def test_short_and_long_texts_have_the_same_grams(spark, monkeypatch):
    df = spark.createDataFrame([("",), ("ab",), ("a\nb\u4e2d\U0001f600cde",), ("abcdefgh" * 5,), (None,)], "t string")
    of = lambda: [r[0] and sorted(r[0]) for r in df.select(J._places(F.col("t"), [2, 8])).collect()]
    short = of()
    monkeypatch.setattr(J, "SHORT", -1)
    assert short == of() and len(short[3]) == 39 + 33
