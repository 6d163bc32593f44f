"""Gates, hygiene, metrics and statistics."""

import re
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from evisift.operators import evalmetrics as E, gating as G, hygiene as H, joins as J, windows as W
from evisift.operators.filters import allow_list, filter_chunks

C = F.col("c")


def f1_py(p, g):
    import string

    norm = lambda s: re.sub(r"\s+", " ", s.lower().translate(str.maketrans("", "", string.punctuation))).strip().split()
    a, b = norm(p), norm(g)
    o = sum((Counter(a) & Counter(b)).values())
    return 0.0 if not a or not b or not o else 2 * (o / len(a)) * (o / len(b)) / (o / len(a) + o / len(b))


@pytest.mark.parametrize("p,g", [("a a b", "a b b"), ("The cat!", "the cat"), ("", "x"), ("x", ""), ("a b c a", "a a a d"), ("...", "a")])
def test_token_f1(one, p, g):
    assert abs(one(E.token_f1(F.col("p"), F.col("g")), p=p, g=g) - f1_py(p, g)) < 1e-12
    assert abs(one(E.token_f1(F.col("g"), F.col("p")), p=p, g=g) - f1_py(p, g)) < 1e-12


def test_relaxed_match(one):
    m = lambda p, g: one(E.relaxed_match(F.col("p"), F.col("g")), p=p, g=g)
    assert m("I think Paris, France.", "paris") == 1 and m("eyes", "yes") == 0 and m("Yeah, sure", "yes") == 1
    assert m("they share the same nationality", "yes") == 1 and m("are not in the same place", "no") == 1 and m("x", "") == 0


def test_veracity_label(one):
    assert one(E.veracity_label(C), c="it refutes, not supports") == "REFUTES"
    assert one(E.veracity_label(C), c="no label") is None


def test_mc_first_maximum_wins(one):
    r = one(E.mc_proxy(F.array(F.lit("a"), F.lit("b")), F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(0), F.lit(1))))
    assert (r["acc"], r["valid"]) == (0.0, 1.0) and abs(r["mass"] - 0.5) < 1e-6
    assert one(E.mc_proxy(F.array(F.lit("a")), F.array(F.lit(0.5)), F.array(F.lit(0))))["valid"] == 0.0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=40))
def test_order_statistics(xs):
    from evisift.session import local_session

    spark = local_session(4, 4)
    df = spark.createDataFrame([("k", x) for x in xs], "k string, v int")
    r = E.order_statistic(df, ["k"], "v", {"p95": E.nearest_rank(0.95), "q50": E.floor_rank(0.5)}).first()
    s = sorted(xs)
    assert r["p95"] == s[int(round((len(s) - 1) * 0.95))] and r["q50"] == s[int(0.5 * (len(s) - 1))]


def test_bootstrap_and_permutation(spark):
    rows = [("a", int(i % 4 != 0), 0) for i in range(400)] + [("b", i % 2, i % 2) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, x int, y int")
    ci = {r["k"]: r for r in E.bootstrap_ci(df, "k", "x").collect()}
    assert ci["a"]["mean"] == 75.0 and 69 < ci["a"]["lo"] < 75 < ci["a"]["hi"] < 81
    p = {r["k"]: r["p_value"] for r in E.paired_permutation(df.withColumn("d", F.col("x") - F.col("y")), "k", "d").collect()}
    assert p["a"] < 0.01 and p["b"] == 1.0


def test_poisson_intervals_against_a_plain_loop(spark):
    """Every sum of every round, for real-valued scores, a null score, a null key and a group of one row."""
    import hashlib

    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(i, "big", float(rng.normal(5, 2)), float(i % 2)) for i in range(900)] + [(i, "one" if i == 3 else None, 0.25, None if i == 3 else 1.0) for i in range(3, 6)]
    df = spark.createDataFrame(rows, "rid bigint, k string, x double, y double").repartition(5)
    got = {r["k"]: r for r in E.poisson_intervals(df, "k", F.col("rid"), ["x", "y"], n_boot=200).collect()}

    def weight(rid, b):
        h = hashlib.md5(str(rid).encode()).hexdigest()
        x = int(h[:8], 16) ^ ((b * 2654435769 + 42) % 2**32)
        for word in (int(h[8:16], 16), 0):
            x = (x ^ (x >> 16)) * 2146121005 % 2**32
            x = (x ^ (x >> 15)) * 2221713035 % 2**32
            x = x ^ (x >> 16) ^ word
        return sum(x >= c for c in E.poisson_cuts())

    for k in ("big", "one", None):
        mine = [(rid, x, y) for rid, kk, x, y in rows if kk == k]
        assert got[k]["n"] == len(mine)
        for name, at in (("x", 1), ("y", 2)):
            have = [(r[0], r[at]) for r in mine if r[at] is not None]
            if not have:
                assert got[k][f"{name}_mean"] is None and got[k][f"{name}_lo"] is None
                continue
            stats = []
            for b in range(1, 201):
                w = [weight(r, b) for r, _ in have]
                if sum(w):
                    stats.append(sum(a * v for a, (_, v) in zip(w, have)) / sum(w))
            stats.sort()
            assert got[k][f"{name}_mean"] == pytest.approx(np.mean([v for _, v in have]))
            assert got[k][f"{name}_lo"] == pytest.approx(stats[max(0, int(len(stats) * 0.025) - 1)])
            assert got[k][f"{name}_hi"] == pytest.approx(stats[max(0, int(len(stats) * 0.975) - 1)])
    half = (got["big"]["x_hi"] - got["big"]["x_lo"]) / 2
    assert 0.7 < half / (1.96 * 2 / 30) < 1.3


def test_poisson_weights_are_poisson():
    import numpy as np

    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**32, (2, 2000)).astype(np.uint64)
    w = E.poisson_weights(words[0], words[1], np.arange(1, 201, dtype=np.uint64), 42)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.08 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.25


def test_gate_table(one):
    z, n, t, f = F.lit(0), F.lit(1), F.lit(True), F.lit(False)
    g = lambda style, mh, ms, al, ss, rs, rsoft, rhard: one(G.gate_decision(F.lit(style), mh, ms, al, ss, rs, rsoft, rhard))
    assert g("factual", z, z, f, z, z, z, z)["reason"] == "capability-allowed"
    assert g("factual", n, z, f, z, z, z, z)["reason"] == "hard-slot-missing"
    assert g("list", z, z, f, n, n, z, z)["final_style"] == "LIST_ONLY"
    assert g("factual", z, n, f, n, n, z, z)["reason"] == "schema-level-slot-limits-answer"
    assert g("factual", z, z, t, z, z, n, z)["final_style"] == "EXPLANATION"
    r = g("factual", z, z, t, z, z, z, n)
    assert r["decision"] == "REFUSE" and r["reason"] == "required slots missing; no safe answer capability"


def test_injection_order(one):
    f = lambda conf, sid, act, sem, slot, ok: one(G.injection_check(F.lit(conf).cast("double"), 0.5, F.lit(sid), F.lit(act), F.lit(sem), F.lit(slot), F.lit(ok)))
    assert f(0.1, "a", "b", "x", "y", False) == "LOW_CONFIDENCE"
    assert f(None, "a", "b", "x", "y", False) == "SCHEMA_MISMATCH"
    assert f(None, "", "b", "x", "y", False) == "SEMANTIC_TYPE_MISMATCH"
    assert f(None, "", "b", " X", "x", False) == "NOT_APPROVED" and f(None, "a", "a", "", "x", True) is None


def test_pattern_hits(spark):
    q = spark.createDataFrame([(1, "SFTSV causes tick fever")], "qid int, text string")
    d = lambda *r: spark.createDataFrame([(x,) for x in r], "term string")
    out = G.pattern_hits(q, d("tick").withColumn("canonical", F.lit("Tick")), d("SFTSV"), d("FEVER"))
    got = {r["block_id"]: (r["confidence"], r["hit_types"]) for r in out.collect()}
    assert got == {
        "fixed_entity:Tick": (0.95, ["fixed_entity", "literal"]), "abbr:SFTSV": (0.95, ["abbreviation_expansion", "literal"]),
        "abbr_heur:SFTSV": (0.35, ["abbreviation_candidate", "literal"]), "schema:FEVER": (0.7, ["schema_trigger", "structure"]),
    }


def test_contract_scores(spark):
    q = spark.createDataFrame([(1, "What is treatment of X", [])], "qid int, text string, hit_ids array<string>")
    cs = [{"pattern_id": "abbr:X", "forms": ["What is X"], "slots": [], "schema": False}, {"pattern_id": "schema:treatment", "forms": ["how"], "slots": ["treatment"], "schema": True}]
    got = {r["pattern_id"]: r["score"] for r in G.match_contracts(q, cs).collect()}
    assert got == {"abbr:X": 0.5, "schema:treatment": 0.2}  # .5 + what, is (.2) - .2; .2 for the slot


def test_slot_status_ratio(spark):
    rows = [(1, "s", "schema", 1, 1, 3), (2, "s", "schema", 1, 2, 2), (3, "s", "soft", 2, 0, 0)]
    df = spark.createDataFrame(rows, "qid int, slot string, level string, min_evidence int, n_cleaned int, n_removed int")
    assert {r["qid"]: r["status"] for r in G.slot_status(df).collect()} == {1: "missing", 2: "satisfied", 3: "missing"}


def test_choose_schema_gate_and_fallback(spark):
    rows = [(1, 0, "how treat fever now", "fever treat", ["treatment"], ["treatment"], []), (1, 1, "how treat fever now", "how treat fever now", ["diagnosis"], ["treatment"], []),
            (2, 0, "zzz", "abc", [], [], []), (2, 1, "zzz", "zzz", [], [], [])]
    df = spark.createDataFrame(rows, "qid int, cand_no int, query string, text string, slots array<string>, required array<string>, answered array<string>")
    assert {(r["qid"], r["cand_no"]) for r in G.choose_schema(df).collect()} == {(1, 0), (2, 1)}


def test_null_language_and_empty_lists_pass(spark):
    df = spark.createDataFrame([(1, None, 0.9), (2, "en", 0.9), (3, "fr", 0.9), (4, "en", 0.1)], "id int, lang string, quality double")
    assert {r["id"] for r in filter_chunks(df, ["en"], 0.5).collect()} == {1, 2}
    assert filter_chunks(df, []).count() == 4
    assert allow_list(df, "id", df.select("id").limit(0)).count() == 4


def test_joins(spark):
    ev = spark.createDataFrame([(1, ["A"]), (2, ["b", "c"]), (3, [])], "evidence_id int, types array<string>")
    sl = spark.createDataFrame([("x", ["a"]), ("y", [])], "slot string, wanted array<string>")
    used = J.evidence_for_slots(ev, sl)
    assert {(r["slot"], r["evidence_id"]) for r in used.collect()} == {("x", 1), ("y", 1), ("y", 2), ("y", 3)}
    assert [r["evidence_id"] for r in J.unconsumed(ev, used.where("slot = 'x'")).collect()] == [2]
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "ord int, k string")
    assert [r["ord"] for r in J.not_present(new, spark.createDataFrame([("a",)], "k string"), "k", "ord").collect()] == [2]


def test_step_deltas(spark):
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate([5.0, 4.0, 3.0, 3.5])], "k string, o int, v double")
    rows = W.step_deltas(df, "k", "o", "v").orderBy("o").collect()
    assert [r["delta"] for r in rows] == [None, -1.0, -1.0, 0.5] and [r["falling"] for r in rows] == [False, False, True, False]


def test_chat_strip(one):
    assert one(H.strip_chat(C), c="Assistant: The answer. Human: next?") == "The answer."
    assert one(H.strip_chat(C), c="Human: q\nAssistant: a") == "a"


def test_instruction_lines(one):
    for bad in ["【回答要求】", "1. You must only output JSON", "】】】】】】】", "requirements"]:
        assert one(H.is_instruction_line(C), c=bad), bad
    assert not one(H.is_instruction_line(C), c="1. Fever is common")


def test_near_repeat_needs_48_characters(one):
    a = "x" * 46
    near = H.near_repeat(F.col("a"), F.col("b"))
    assert not one(near, a=a + "a", b=a + "b"), "under 48 characters only equal keys count"
    assert one(near, a=a + "yya", b=a + "yyb") and one(near, a="q", b="q")
    assert not one(near, a="x" * 60, b="x" * 57 + "abc") and one(near, a="x" * 100, b="x" * 98)


def test_repeats_in_long_texts(spark):
    """Exact repeats go however far back; near ones only within the last five paragraphs or twelve sentences."""
    own = [f"Paragraph number {w} speaks of something else entirely, and of {w * 6}." for w in ("alpha", "beta", "gamma", "delta", "zeta", "kappa", "sigma")]
    near = own[0][:-1] + "!"
    get = lambda ps: spark.createDataFrame([(ps,)], "ps array<string>").select(H.dedupe_paragraphs("ps").alias("v")).first()["v"]
    assert get([*own, own[0].upper()]) == own and get([own[0], near]) == [own[0]] and get([*own, near]) == [*own, near]
    assert get(None) == [] and get([]) == []
    many = " ".join(f"Sentence {i} has its own words about item {i * 7919}." for i in range(600))
    twice = lambda i: get([many + f" Sentence {i} has its own words about item {i * 7919}."])[0].count(f"item {i * 7919}.")
    assert twice(597) == 1 and twice(3) == 2, "only the last twelve kept sentences are remembered"


def levenshtein_py(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
    return row[-1]


def key_py(t):
    return re.sub(r"[ \t\f\v]+", " ", t.replace("\r\n", "\n").replace("\r", "\n")).strip(" ").lower().translate(str.maketrans("“”’‘", "\"\"''"))


def near_py(a, b, share):
    if a == b or min(len(a), len(b)) < 48:
        return a == b
    edits = int(max(len(a), len(b)) * (1 - share) + 1e-9)
    return abs(len(a) - len(b)) <= edits and levenshtein_py(a, b) <= edits


def share_py(t, p):
    return 0.985 if len(t) <= 24 else 0.97 if len(t) <= 64 else 0.94 if len(t) > 140 and len(p) >= 240 else 0.96


def sentences_py(p):
    p = p.strip()
    parts = re.findall(r"[^。！？!?.]+[。！？!?.]?", p)
    if not re.search(r"[。！？!?.]", p):
        return p
    out, seen = [], []
    for part in parts:
        t = re.sub(r"[。！？!?.]$", "", part).strip()
        if not t:
            continue
        if len(t) >= 6 and re.search("[A-Za-z0-9\u4e00-\u9fff]", t):
            k = key_py(t)
            if len(p) >= 240 and len(t) >= 12:
                if any(near_py(k, v, share_py(t, p)) for v in seen[-12:]):
                    continue
            elif k in seen[-32:]:
                continue
            seen.append(k)
        out.append(t + (part[-1] if part[-1] in "。！？!?." else ""))
    return "".join(out)


def paragraphs_py(ps):
    """Plain loops over everything kept so far."""
    kept = []
    for p in ps:
        k = key_py(p)
        if k not in [v for v, _ in kept] and not any(near_py(k, v, 0.97) for v, _ in kept[-5:]):
            kept.append((k, p))
    return [sentences_py(p) for _, p in kept]


def test_repeats_match_plain_loops(spark):
    """Windows count what was kept: a repeat of a dropped near copy may stay once the window has moved on."""
    rng = __import__("random").Random(5)
    words = ["fever", "rash", "tick", "virus", "Signs", "“case”", "of", "blood", "a1"]
    phrase = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = []
    for _ in range(16):
        pool = [phrase(rng.choice([1, 2, 9, 14])) for _ in range(rng.choice([2, 4, 9]))]
        pool += [t + rng.choice(["s", "!x", ""]) for t in pool]
        one = lambda: "".join(rng.choice(pool) + rng.choice([". ", "! ", "。", ".. "]) for _ in range(rng.choice([1, 2, 8])))
        paras = [one() for _ in range(rng.choice([1, 3, 8]))] + [rng.choice(pool) for _ in range(rng.choice([0, 5, 70]))]
        rng.shuffle(paras)
        rows.append((paras,))
    base = "word " * 20
    late = [base + "a", base + "b", *[f"{i} other" for i in range(6)], base + "b", base + "b"]
    rows += [(late,), ([],), ([""],)]
    assert paragraphs_py(late) == [base.strip() + " a", *[f"{i} other" for i in range(6)], base.strip() + " b"]
    got = spark.createDataFrame(rows, "ps array<string>").coalesce(1).select("ps", H.dedupe_paragraphs("ps").alias("v")).collect()
    for r in got:
        assert r.v == paragraphs_py(r.ps)


def test_paragraph_and_sentence_repeats(spark):
    p = "A long enough paragraph about fever, rash and other signs of disease."
    df = spark.createDataFrame([([p, p, p[:-1] + "!", "Short. Short. Short one."],)], "ps array<string>")
    assert df.select(H.dedupe_paragraphs("ps").alias("v")).first()["v"] == [p, "Short.Short.Short one."]  # pieces are re-joined without spaces
    df = spark.createDataFrame([(["Repeat this. Repeat this. Done now."],)], "ps array<string>")
    assert df.select(H.dedupe_paragraphs("ps").alias("v")).first()["v"] == ["Repeat this.Done now."]


def test_units_and_policy(one):
    us = H.answer_units(F.array(F.lit("Cause: A virus."), F.lit("Cause: a  virus."), F.lit("no evidence here"), F.lit("insufficient evidence"), F.lit("【x】")))
    got = one(us)
    assert [(u["slot"], u["text"]) for u in got] == [("Cause", "A virus."), ("", H.FALLBACK_TEXT)]
    none = F.lit(None).cast("array<string>")
    only = F.filter(us, lambda u: u["fallback"])
    assert one(H.evidence_policy(only, F.lit("what treatment"), none))["failure_reason"] == "evidence_missing"
    assert one(H.evidence_policy(only, F.lit("what treatment"), F.array().cast("array<string>")))["failure_reason"] == "pdf_miss"
    assert one(H.evidence_policy(only, F.lit("hello"), none))["failure_reason"] == "slot_miss"
    assert one(H.evidence_policy(only, F.lit("what treatment"), F.array(F.lit("e1"))))["used_evidence"]


def test_sections(one):
    t = {"a": "Cause", "b": "Therapy"}
    assert one(H.format_sections(C, t, ["b"]), c="Cause: x\nTherapy: y\nmore") == "Therapy：\ny\nmore"
    assert one(H.format_sections(C, t, ["b"]), c="intro\nTherapy: y") == "intro\nTherapy: y"


def test_expansions(one):
    r = one(G.unapproved_expansions(C, F.lit("SFTSV is a virus")), c="SFTSV (made up) and ABC(a virus)")
    assert [x["abbr"] for x in r] == [] or [x["abbr"] for x in r] == ["SFTSV"]


def test_relation_claims(one):
    f = lambda v, o, x: one(G.relation_claim(F.lit(v), F.lit(o), F.lit(x)))
    assert f("PLT", "<", "50") == "临床变量PLT小于50。" and f("PLT", "range", "1, 2") == "临床变量PLT取值范围在1到2之间。"
    assert f("", "<", "5") is None and f("x", "~", "5") is None and f("x", "range", "1") is None


def test_parse_triples(one):
    raw = 'ok ```json\n[{"subject": "a", "predicate": "treat", "object": "b"}, {"subject": "", "predicate": "p", "object": "q"}]\n```'
    got = one(G.parse_triples(C), c=raw)
    assert [(t["subject"], t["predicate"]) for t in got] == [("a", "treat")]
    assert one(G.fuzzy_key(F.lit("Treated-By"), ["treats", "treated_by"])) == "treated_by"
    assert one(G.parse_triples(C), c="nothing") == []


def test_low_quality_and_critique(one):
    assert one(G.is_low_quality(C), c="aaaaaaaaaaaaaaaa") and not one(G.is_low_quality(C), c="A normal readable sentence.")
    r = one(G.self_critique(F.lit("which drug"), C), c="It is unclear and unknown.")
    assert r["is_medical"] and abs(r["confidence"] - 0.2) < 1e-9


def test_target_types_contract_first_then_cues(spark):
    df = spark.createDataFrame([("哪些地区？症状？", ["generic", " Drug "]), ("哪些地区？症状？", ["drug", "symptom"]), ("FDA approval", None), ("nothing", []), (None, None)], "q string, ts array<string>")
    got = [(r.t.target, r.t["types"]) for r in df.select(G.target_types(F.col("q"), F.col("ts")).alias("t")).collect()]
    assert got == [("drug", ["drug"]), ("multi", ["symptom", "location"]), ("drug", ["drug"]), ("unknown", []), ("unknown", [])]


def test_rejections_and_denied_terms(spark):
    df = spark.createDataFrame([("a", "b", "x", "x"), ("a", "", "x", "Y "), ("a", "a", " X", "x"), ("a", None, "", "y")], "p string, s string, a string, b string")
    assert [r.v for r in df.select(G.slot_rejection(F.col("p"), F.col("s"), F.col("a"), F.col("b")).alias("v")).collect()] == ["SCHEMA_MISMATCH", "SEMANTIC_TYPE_MISMATCH", None, None]
    one = spark.createDataFrame([("has fever and rash", "what of rash")], "a string, q string")
    assert one.select(G.denied_terms(F.col("a"), F.col("q"), F.array(F.lit(" rash"), F.lit("fever"), F.lit(""))).alias("v")).first().v == ["fever"]
    assert one.select(G.items_not_in_evidence(F.array(F.lit("fever"), F.lit("rash")), F.lit(" ")).alias("v")).first().v == []


def test_lists_of_any_length_are_distinct_in_order(one):
    from evisift.operators.extract import distinct_by

    text = " ".join(str(i % 700) for i in range(5000))
    assert one(distinct_by(F.split("c", " "), lambda x: x), c=text) == [str(i) for i in range(700)]
    assert one(distinct_by(F.split("c", " "), F.lower), c="b A a B c") == ["b", "A", "c"]


def test_best_candidate_offers_every_claim_and_paragraph(spark, tmp_path):
    import hashlib

    from evisift.plans.evaluate import best_candidate

    late = "The vaccine was given to nine hundred children in the northern district last year."
    texts = [f"No. See https://a.example/b now. {late} Why.", f"Go https://a.example/b here to find some more words.\n\n{late}\n\nhttps://a.example/c is the last line of all."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.best_md5 for r in best_candidate(spark, str(tmp_path)).collect()}
    assert got == dict.fromkeys(range(len(texts)), hashlib.md5(late.encode()).hexdigest())


def test_equal_candidates_leave_the_first_offered(spark):
    """of two questions alike in overlap, length and method either one came out."""
    from evisift.operators import retrieval as R

    for order in ((0, 1, 2), (2, 1, 0), (1, 2, 0)):
        rows = [(1, t, f"text {t}", 0, 6, 1) for t in order]
        cands = spark.createDataFrame(rows, "conv_id int, ord int, text string, overlap int, n_chars int, prio int").coalesce(1)
        assert [tuple(r) for r in R.answer_choice(cands, "conv_id").collect()] == [(1, "text 0", 1)]


def test_slots_meet_evidence_in_place(spark, monkeypatch):
    """the evidence was exploded, shuffled and made distinct to meet a few slots."""
    ev = spark.createDataFrame([(1, ["A", "b"]), (2, ["B", None]), (3, []), (4, None), (5, ["z"])], "evidence_id int, types array<string>")
    sl = spark.createDataFrame([("x", ["a ", "B"]), ("y", ["b", None]), ("all", [])], "slot string, wanted array<string>")
    of = lambda: sorted((r["slot"], r["evidence_id"]) for r in J.evidence_for_slots(ev, sl).collect())
    assert "Aggregate [slot" not in J.evidence_for_slots(ev, sl)._jdf.queryExecution().optimizedPlan().toString()
    got = of()
    assert got == [("all", i) for i in (1, 2, 3, 4, 5)] + [("x", 1), ("x", 2), ("y", 1), ("y", 2)]
    monkeypatch.setattr(J, "MAP_ROWS", 0)
    assert got == of()


def test_signals_are_written_once(spark, monkeypatch):
    """F8: the signals were computed from the texts twice, for the counts and for the contracts."""
    cuts, cut = [], G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df: cuts.append(df) or cut(df))
    c = spark.createDataFrame([("q", "p", "schema", "soft", "s:a", 0.0), ("q", "o", "entity", "hard", "s:z", 0.0)], "qid string, pattern_id string, kind string, level string, required string, min_density double")
    s = spark.createDataFrame([("q", 1, "s:a", True), ("q", 1, "s:b", False)], "qid string, block_id int, signal string, info boolean")
    got = {r["pattern_id"]: (r["satisfied"], r["info_density"]) for r in G.validate_contracts(c, s).collect()}
    assert got == {"p": (True, 0.5), "o": (False, 0.5)} and len(cuts) == 1


def test_cues_are_searched_once_for_all_candidates(spark):
    """each candidate searched the whole text again for each cue it weighs."""
    df = spark.createDataFrame([("From 2019 to 2020 which region was treated?",), ("zzz",), (None,)], "text string")
    ids = ["schema:treatment", "schema:epidemiology", "abbr:SFTS"]
    out = df.select(G.schema_scores(F.col("text"), ids).alias("s"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("(19|20)") == 1
    for r, t in zip(out.collect(), df.collect(), strict=True):
        one = [df.where(F.col("text").eqNullSafe(F.lit(t["text"]))).select(G.schema_scores(F.col("text"), [i])[0].alias("s")).first()["s"] for i in ids]
        assert sorted(r["s"]) == sorted(one)


def test_candidates_are_stripped_once(spark):
    from evisift.operators import evalmetrics as E

    df = spark.createDataFrame([(["", " ", None, "!!", "A sentence of a fair length, with words."],), ([" ", None],), ([],), (["x", "y"],)], "c array<string>").select(E.best_candidate(F.col("c")).alias("b"))
    assert [r.b for r in df.collect()] == ["A sentence of a fair length, with words.", None, None, "x"]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("trim(") == 1  # eleven before
