"""Graph operators on hand-made triples, one case per trap."""

import pytest
from pyspark.sql import functions as F

from evisift.operators import graph as G
from evisift.operators.ranking import global_position, running_total

COLS = "ord bigint, triple_id string, subject string, subject_type string, predicate string, object string, object_type string, sentence_id string, sentence_text string, source_doc_id string"


def triples(spark, *rows):
    data = [(i, f"t{i}", s, st, p, o, ot, sid, txt, "d") for i, (s, st, p, o, ot, sid, txt) in enumerate(rows)]
    return spark.createDataFrame(data, COLS)


def build(t):
    nodes = G.build_nodes(G.entities(t)).withColumn("aliases", F.array().cast("array<string>")).withColumn("description", F.lit(""))
    return nodes, G.build_edges(t, nodes)


def names(nodes):
    return {r["node_id"]: r["name"] for r in nodes.collect()}


def test_self_inverse_is_one_way(spark):
    t = triples(spark, ("a", "", "associated_with", "b", "", "s", "x"), ("a", "", "causes", "c", "", "s2", "y"))
    nodes, edges = build(t)
    n = names(nodes)
    got = {(n[r["src"]], r["rel"], n[r["tgt"]]) for r in edges.collect()}
    assert got == {("a", "associated_with", "b"), ("a", "causes", "c"), ("c", "caused_by", "a")}


def test_first_non_empty_type_wins(spark):
    t = triples(spark, ("a", "", "causes", "b", "x", "", ""), ("a", "drug", "causes", "b", "y", "", ""), ("a", "late", "causes", "c", "", "", ""))
    assert {r["name"]: r["entity_type"] for r in G.entities(t).collect()} == {"a": "drug", "b": "x", "c": ""}


def test_node_ids_follow_name_order(spark):
    t = triples(spark, ("b", "", "causes", "a", "", "", ""), ("Z", "", "causes", "a", "", "", ""))
    nodes, _ = build(t)
    assert {r["name"]: r["node_id"] for r in nodes.collect()} == {"Z": "node_0000", "a": "node_0001", "b": "node_0002"}


def test_orphan_alias_rewrites_triples_but_keeps_entity(spark):
    t = triples(spark, ("flu", "", "causes", "fever", "", "", ""))
    aliases = spark.createDataFrame([("influenza", "flu", 0)], "canonical string, alias string, ord bigint")
    ents, _, out = G.merge_aliases(t, aliases)
    assert {r["name"] for r in ents.collect()} == {"flu", "fever"}
    assert out.first()["subject"] == "influenza"
    nodes = G.build_nodes(ents)
    assert G.build_edges(out, nodes).count() == 0  # the rewritten name has no node


def test_case_variants_merge_into_the_last(spark):
    t = triples(spark, ("Flu", "d", "causes", "x", "", "", ""), ("flu", "", "causes", "x", "", "", ""))
    ents, absorbed, out = G.merge_aliases(t, spark.createDataFrame([], "canonical string, alias string, ord bigint"))
    assert {r["name"]: r["entity_type"] for r in ents.collect()} == {"flu": "d", "x": ""}
    assert [tuple(r) for r in absorbed.collect()] == [("flu", "Flu")]
    nodes = G.build_nodes(ents)
    assert {r["key"] for r in G.entity_index(nodes, absorbed).collect()} == {"flu", "x"}
    assert {r["subject"] for r in out.collect()} == {"flu"}


def walk_py(edges, start, rels, hops):
    adj = {}
    for e in sorted(edges, key=lambda e: e["eord"]):
        adj.setdefault(e["src"], {}).setdefault(e["rel"], []).append((e["tgt"], e["triple_id"]))
    seen, queue, out = {start}, [(start, 0)], []
    while queue:
        cur, hop = queue.pop(0)
        if hop >= hops:
            continue
        for rel, tg in adj.get(cur, {}).items():
            if rels and rel not in rels:
                continue
            for tgt, tid in tg:
                if tgt in seen:
                    continue
                seen.add(tgt)
                out.append((tgt, rel, tid, hop + 1))
                queue.append((tgt, hop + 1))
    return out


@pytest.mark.parametrize("rels", [[], ["causes", "treats"]])
@pytest.mark.parametrize("seed", [1, 2])
def test_walk_equals_queue_walk(spark, rels, seed):
    import random

    rng = random.Random(seed)
    preds = ["causes", "treats", "associated_with", "is_a"]
    rows = [(f"n{rng.randrange(12)}", "", rng.choice(preds), f"n{rng.randrange(12)}", "", "", "") for _ in range(40)]
    t = triples(spark, *rows)
    nodes, edges = build(t)
    es = [r.asDict() for r in edges.collect()]
    starts = nodes.select(F.col("node_id").alias("start"), F.col("node_id").alias("node"), F.lit(rels).cast("array<string>").alias("rels"))
    got = {}
    for r in G.walk(edges, starts, 3).orderBy("start", "hop", "path").collect():
        got.setdefault(r["start"], []).append((r["node"], r["relation"], r["triple_id"], r["hop"]))
    for nid in names(nodes):
        assert got.get(nid, []) == walk_py(es, nid, rels, 3), nid


def test_longest_non_overlapping_mentions(spark):
    idx = spark.createDataFrame([("new york city", "n1"), ("york", "n2"), ("new york", "n3"), ("aa", "n4")], "key string, node_id string")
    q = spark.createDataFrame([(1, "York, then New York City and new york; aaa")], "qid int, text string")
    got = [(r["mention"], r["node_id"]) for r in G.recognise(q, idx).orderBy("match_no").collect()]
    assert got == [("New York City", "n1"), ("new york", "n3"), ("York", "n2"), ("aa", "n4")]


def test_empty_sentence_ids_collide_unless_fixed(spark):
    t = triples(spark, ("flu", "", "causes", "a", "", "", "one"), ("flu", "", "causes", "b", "", "", "two"))
    nodes, edges = build(t)
    q = spark.createDataFrame([(1, "what does flu do", "")], "qid int, text string, intent string")
    assert G.retrieve(q, t, nodes, edges).count() == 1
    assert G.retrieve(q, t, nodes, edges, fix_empty_id=True).count() == 2


def test_relation_scan_adds_unreachable_triples_after_the_walk(spark):
    t = triples(spark, ("flu", "", "manifests_as", "rash", "", "s0", "flu rash"), ("patient", "", "manifests_as", "fever", "", "s1", "fever text"), ("x", "", "treats", "y", "", "s2", "no"))
    nodes, edges = build(t)
    q = spark.createDataFrame([(1, "flu symptom", "symptom")], "qid int, text string, intent string")
    rows = G.retrieve(q, t, nodes, edges).orderBy("rank").collect()
    assert [(r["sentence_id"], r["hop"]) for r in rows] == [("s0", 1), ("s1", 0)]


def test_re_added_triple_overwrites(spark):
    t = spark.createDataFrame([(0, "t", "a"), (1, "t", "b"), (2, "u", "c")], "ord bigint, triple_id string, subject string")
    assert {(r["triple_id"], r["ord"], r["subject"]) for r in G.last_triples(t).collect()} == {("t", 0, "b"), ("u", 2, "c")}


def test_relation_gating_ties_go_to_first_seen(spark):
    s = spark.createDataFrame([(1, "b", 0.5, 0), (1, "a", 0.5, 1), (1, "c", 0.2, 2), (1, "c", 0.2, 3)], "q int, rel string, s double, ord int")
    assert {r["rel"] for r in G.relation_gating(s, "q", "rel", "s", "ord", 2).collect()} == {"b", "a"}


def test_positions_and_running_totals(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), (F.col("id") % 2).alias("k"), F.lit(2).alias("w")).repartition(6)
    assert all(r["x"] == r["pos"] for r in global_position(df, "x").collect())
    rows = running_total(df, ["k"], "x", "w").collect()
    for k in (0, 1):
        xs = sorted(r["x"] for r in rows if r["k"] == k)
        assert {r["x"]: r["upto"] for r in rows if r["k"] == k} == {x: 2 * (i + 1) for i, x in enumerate(xs)}


def test_render_and_layers(one):
    assert one(G.render_triple(F.lit("a"), F.lit("causes"), F.lit("b"))) == "a 导致 b"
    assert len(one(G.render_triple(F.lit("a" * 40), F.lit("causes"), F.lit("b" * 40)))) == 45
    assert one(G.classify_intent(F.lit("Which drug or therapy; any symptom?"))) == "drug"
    assert one(G.classify_intent(F.lit("nothing"))) == ""


def test_layer_prefix_places_and_pads(spark):
    rows = [  # question, item, order, length, first and last layer
        (1, "a", 0, 3, 0, 3), (1, "t0", 1, 5, 2, 4), (1, "t1", 2, None, 2, 2), (1, "t2", 3, 2, 4, 99), (2, "far", 0, 4, 6, 9), (3, "empty", 0, 0, 0, 1), (4, "back", 0, 7, 3, 2),
        (None, "null", 0, 1, 0, 0), (5, "n", 0, 1, None, 2),
    ]
    df = spark.createDataFrame(rows, "qid int, item_id string, ord int, len int, layer_start int, layer_end int")
    got = G.layer_prefix(df, "qid", 6, usual=2).collect()
    assert {r.qid for r in got} == {1} and all(r.width == 8 for r in got)
    by = {(r.layer, r.item_id): (r.start, r.len, r.pad) for r in got}
    assert by == {
        (0, "a"): (5, 3, 5), (1, "a"): (5, 3, 5), (2, "a"): (0, 3, 0), (2, "t0"): (3, 5, 0), (2, "t1"): (8, 0, 0), (3, "a"): (0, 3, 0), (3, "t0"): (3, 5, 0),
        (4, "t0"): (1, 5, 1), (4, "t2"): (6, 2, 1), (5, "t2"): (6, 2, 6),
    }
    late = G.layer_prefix(df.where("qid = 2"), "qid", 8).collect()
    assert sorted((r.layer, r.item_id, r.start, r.pad) for r in late if r.layer > 5) == [(6, "far", 0, 0), (7, "far", 0, 0)]
    assert [(r.item_id, r.start, r.pad) for r in late if r.layer <= 5] == [(None, None, 4)] * 6
    assert G.layer_prefix(df.limit(0), "qid", 4).count() == 0


def test_range_join_meets_by_bins(spark):
    import random

    from evisift.operators.joins import range_join

    rng = random.Random(2)
    spans = [(i, a, a + rng.randrange(-2, 30)) for i, a in enumerate(rng.randrange(-40, 90) for _ in range(200))] + [(900, None, 3), (901, 3, None)]
    points = [rng.randrange(-50, 120) for _ in range(80)]
    ps, ss = spark.createDataFrame([(p,) for p in points], "p int"), spark.createDataFrame(spans, "i int, lo int, hi int")
    want = sorted((p, i) for p in points for i, a, b in spans if a is not None and b is not None and a <= p <= b)
    for width in (1, 7, 1000):
        out = range_join(ps, "p", ss, "lo", "hi", width)
        assert sorted((r.p, r.i) for r in out.collect()) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
