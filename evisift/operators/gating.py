"""Pattern hits, contracts, slot status and answer gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chars import CJK
from ..functions.rows import explode_rows
from ..functions.text import bind, strip
from ..session import cut_lineage
from .extract import BOUND_L, BOUND_R, any_contains
from .joins import contained_terms, token_terms


# --- Q01, Q02, U04 ---------------------------------------------------------------------------
def pattern_hits(queries: DataFrame, fixed: DataFrame, abbrs: DataFrame, triggers: DataFrame) -> DataFrame:
    """``fixed(term, canonical)``, ``abbrs(term)``, ``triggers(term)`` against ``queries(qid, text)``.

    The heuristic hit fires for every short upper-case token, known or not: alias keys
    are stored in upper case and never equal the lower-cased token.
    """
    def hits(df: DataFrame, bid: Column, kinds: list[str], conf: float) -> DataFrame:
        return df.select("qid", bid.alias("block_id"), F.array(*[F.lit(k) for k in kinds]).alias("kinds"), F.lit(conf).alias("confidence"))

    a = hits(contained_terms(queries, fixed), F.concat(F.lit("fixed_entity:"), "canonical"), ["fixed_entity", "literal"], 0.95)
    b = hits(token_terms(queries, abbrs), F.concat(F.lit("abbr:"), "term"), ["abbreviation_expansion", "literal"], 0.95)
    toks = explode_rows(queries, ["qid"], F.regexp_extract_all("text", F.lit("[A-Za-z0-9_/-]+"), F.lit(0)), "t")
    upper = toks.where(F.length("t").between(2, 10) & F.col("t").rlike("[A-Z]") & ~F.col("t").rlike("[a-z]"))
    c = hits(upper, F.concat(F.lit("abbr_heur:"), "t"), ["abbreviation_candidate", "literal"], 0.35)
    d = hits(contained_terms(queries, triggers, fold=True), F.concat(F.lit("schema:"), "term"), ["schema_trigger", "structure"], 0.7)
    return merge_hits(reduce(lambda x, y: x.unionByName(y), [a, b, c, d]))


def merge_hits(hits: DataFrame) -> DataFrame:
    """Union of kinds (sorted, T08), largest confidence."""
    flat = hits.select("qid", "block_id", "confidence", F.explode("kinds").alias("kind"))
    return flat.groupBy("qid", "block_id").agg(F.array_sort(F.collect_set("kind")).alias("hit_types"), F.max("confidence").alias("confidence"))


# --- Q03, Q04 --------------------------------------------------------------------------------
# Question words of an intent.
INTENT_WORDS = ["什么", "哪些", "如何", "哪里", "why", "what", "how", "where"]


def contract_tokens(c: Column) -> Column:
    words = F.transform(F.regexp_extract_all(c, F.lit(r"[A-Za-z][A-Za-z0-9\-_/]+"), F.lit(0)), F.lower)
    return F.array_distinct(F.concat(words, F.regexp_extract_all(c, F.lit(f"[{CJK}]{{2,4}}"), F.lit(0))))


def skeleton_score(query: Column, skeleton: Column) -> Column:
    """Q03: half a point per shared intent word, a tenth per shared token."""
    q, s = F.lower(query), F.lower(skeleton)
    intent = reduce(lambda a, w: a + F.when(F.contains(q, F.lit(w)) & F.contains(s, F.lit(w)), 0.5).otherwise(0.0), INTENT_WORDS, F.lit(0.0))
    shared = F.array_intersect(contract_tokens(query), F.array_remove(contract_tokens(skeleton), "x"))
    return F.when((query == "") | (skeleton == ""), 0.0).otherwise(intent + F.size(shared) * 0.1)


def match_contracts(queries: DataFrame, contracts: list[dict]) -> DataFrame:
    """Q03: ``contracts`` is configuration: ``pattern_id, forms, slots, schema`` each.

    Every query is scored against each contract inside its row; ``queries`` may carry
    ``hit_ids`` (array) from the pattern stage.
    """
    q = F.col("text")
    low = F.lower(q)
    cells = []
    for i, c in enumerate(contracts):
        scores = [skeleton_score(q, F.lit(f)) for f in c["forms"]] or [F.lit(0.0)]
        best = F.greatest(*scores, F.lit(0.0)) if len(scores) > 1 else scores[0]
        base = F.when(F.array_contains("hit_ids", c["pattern_id"]), F.greatest(best, F.lit(1.0))).otherwise(best)
        named = any_contains(low, [s.lower() for s in c["slots"]]) if c["schema"] else F.lit(False)
        cells.append(
            F.struct(
                F.lit(c["pattern_id"]).alias("pattern_id"), (base + F.when(named, 0.2).otherwise(0.0)).alias("score"), named.alias("named"),
                F.lit(c["pattern_id"].startswith("abbr:")).alias("is_abbr"), F.lit(i).alias("i"),
            )
        )

    def ranked(arr: Column) -> Column:
        live = F.filter(arr, lambda x: x["score"] > 0)
        named = F.exists(arr, lambda x: x["named"])
        return F.transform(
            live,
            lambda x: F.struct(
                x["pattern_id"].alias("pattern_id"), F.round(x["score"] - F.when(named & x["is_abbr"], 0.2).otherwise(0.0), 6).alias("score"), x["i"].alias("i")
            ),
        )

    out = explode_rows(queries, ["qid"], bind(F.array(*cells), ranked), "m").select("qid", "m.*")
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "i")  # one group = the configured contracts
    return out.withColumn("rank", F.row_number().over(w)).drop("i")


def schema_scores(text: Column, pattern_ids: list[str], slot_names: dict[str, list[str]] | None = None) -> Column:
    """Q04: struct(schema_id, score) per candidate from question-structure signals."""
    # The cues of time, space, enumeration, definition and drugs, and the weights below.
    def told(low: Column) -> Column:
        has_time = text.rlike(f"{BOUND_L}(19|20)\\d{{2}}{BOUND_R}") & (text.rlike("[-–~—到至]") | low.rlike(f"{BOUND_L}to{BOUND_R}") | F.contains(low, F.lit("from")))
        has_space = text.rlike("地区|区域|地域|省|市|我国|中国|国内|分布|流行") | low.rlike(f"{BOUND_L}(geographic|distribution|region|where){BOUND_R}")
        is_enum = text.rlike("有哪些|哪里|哪些|分布|主要") | low.rlike(f"{BOUND_L}(which|where){BOUND_R}")
        is_def = text.rlike("是什么|全称|意思") | low.rlike(f"{BOUND_L}(what is|stand for){BOUND_R}")
        drug = text.rlike("药物|用药|治疗|疗法|用什么药|获批|批准|适应症") | low.rlike(f"{BOUND_L}(drug|treat|therapy|therapeutic|approved|approval|fda){BOUND_R}")
        return F.struct(low.alias("low"), *[c.alias(n) for n, c in (("has_time", has_time), ("has_space", has_space), ("is_enum", is_enum), ("is_def", is_def), ("drug", drug))])

    def scored(cue: Column) -> Column:
        low, has_time, has_space, is_enum, is_def, drug = (cue[n] for n in ("low", "has_time", "has_space", "is_enum", "is_def", "drug"))
        plus = lambda cond, v: F.when(cond, v).otherwise(0.0)
        cells = []
        for i, pid in enumerate(pattern_ids):
            kind, _, slot = pid.partition(":")
            if kind == "schema":
                s = F.lit(0.6) + plus(has_time, 0.25) + plus(has_space, 0.25) + plus(is_enum, 0.15)
                if slot == "treatment":
                    s = s + plus(drug, 0.45)
                elif slot in ("clinical_features", "geographic_distribution", "epidemiology"):
                    s = s + plus(drug, -0.15)
                if slot in ("geographic_distribution", "epidemiology"):
                    s = s + plus(has_time | has_space, 0.2)
                names = [n.lower() for n in (slot_names or {}).get(pid, [slot]) if n]
                s = s + plus(any_contains(low, names), 0.2)
            elif kind == "abbr":
                s = F.lit(0.15) + plus(is_def, 0.35) + plus(has_time | has_space | is_enum, -0.7)
            else:
                s = F.lit(0.3)
            cells.append(F.struct((-F.round(s, 6)).alias("neg"), F.lit(i).alias("i"), F.lit(pid).alias("schema_id")))
        order = F.array_sort(F.array(*cells))
        return F.transform(order, lambda x: F.struct(x["schema_id"].alias("schema_id"), (-x["neg"]).alias("score")))

    # Each cue is searched once, however many candidates weigh it.
    return bind(bind(F.lower(text), told), scored)


# --- Q05-Q07, A15, A16 -----------------------------------------------------------------------
def contracts_from_hits(hits: DataFrame, hard: list[str] | None = None, soft: list[str] | None = None) -> DataFrame:
    """Q05: contract kind, level, required signal and density of every hit."""
    bid = F.col("block_id")
    kind = F.when(bid.startswith("abbr"), "abbr").when(bid.startswith("schema:"), "schema").when(bid.startswith("fixed_entity:"), "entity").otherwise("other")
    name = F.regexp_replace(bid, "^[a-z_]+:", "")
    level = F.when(kind == "abbr", F.when((F.length(name) >= 4) & (F.col("confidence") >= 0.9), "hard").otherwise("soft")).otherwise("soft")
    if hard:
        level = F.when(bid.isin(hard), "hard").otherwise(level)
    if soft:
        level = F.when((kind == "abbr") & bid.isin(soft), "soft").otherwise(level)
    required = F.when(kind == "abbr", F.concat(F.lit("abbr:"), name)).when(kind == "schema", F.concat(F.lit("schema_slot:"), name)).when(
        kind == "entity", F.concat(F.lit("entity:"), name)
    )
    density = F.when(kind == "abbr", 0.3).when(kind == "schema", 0.45).when(kind == "entity", 0.35).otherwise(0.2)
    return hits.select("qid", bid.alias("pattern_id"), kind.alias("kind"), level.alias("level"), required.alias("required"), density.alias("min_density"))


def valid_abbr_pair(p: Column) -> Column:
    """Q07."""
    full = F.lower(strip(p["full"]))
    first = F.get(F.split(full, r"\s+"), 0)
    return (
        (F.length(p["abbr"]) >= 3) & (F.length(p["full"]) >= F.length(p["abbr"]) + 4) & ~full.rlike("^(abstract|keywords|introduction)")
        & (F.length(first) >= 4) & (F.coalesce(p["confidence"], F.lit(1.0)) >= 0.85)
    )


def block_signals(pairs: Column, entities: Column, slots: Column, block_type: Column, is_table: Column) -> Column:
    """struct(signal, info) list of one evidence block."""
    sig = lambda t, info: F.struct(t.alias("signal"), F.lit(info).alias("info"))
    ok = F.filter(pairs, valid_abbr_pair)
    return F.array_compact(
        F.concat(
            F.transform(ok, lambda p: sig(F.concat(F.lit("abbr:"), p["abbr"]), True)),
            F.transform(ok, lambda p: sig(F.concat(F.lit("abbr_full:"), p["abbr"], F.lit("::"), p["full"]), True)),
            F.transform(F.filter(entities, lambda e: strip(e) != ""), lambda e: sig(F.concat(F.lit("entity:"), strip(e)), True)),
            F.transform(F.filter(slots, lambda s: strip(s) != ""), lambda s: sig(F.concat(F.lit("schema_slot:"), strip(s)), True)),
            F.array(F.when(block_type != "", sig(F.concat(F.lit("block_type:"), block_type), False))),
            F.array(F.when(is_table, sig(F.lit("block_type:table"), False))),
        )
    )


def validate_contracts(contracts: DataFrame, signals: DataFrame) -> DataFrame:
    """``contracts(qid, pattern_id, kind, level, required, min_density)`` against
    ``signals(qid, block_id, signal, info)``.

    A query's evidence is counted by partial aggregates: distinct informative signals
    over twice the number of blocks, at most 1. Signals are written once, as both the counts and the contracts read them.
    """
    signals = cut_lineage(signals)
    per_query = signals.groupBy("qid").agg(
        F.count_distinct(F.when(F.col("info"), F.col("signal"))).alias("n_info"), F.count_distinct("block_id").alias("n_blocks"),
        F.min((F.col("signal") == "block_type:general").cast("int")).alias("only_generic"),
    )
    density = F.least(F.lit(1.0), F.coalesce("n_info", F.lit(0)) / F.greatest(F.lit(1), F.coalesce("n_blocks", F.lit(0)) * 2))
    met = contracts.select("qid", "pattern_id", F.col("required").alias("signal")).join(
        signals.select("qid", "signal").distinct(), ["qid", "signal"], "left_semi"
    ).select("qid", "pattern_id").distinct().withColumn("satisfied", F.lit(True))
    out = contracts.join(met, ["qid", "pattern_id"], "left").join(per_query, "qid", "left").withColumn("satisfied", F.coalesce("satisfied", F.lit(False)))
    generic_only = (F.col("kind") == "schema") & (F.coalesce("only_generic", F.lit(0)) == 1)
    must = F.col("required").isNotNull()
    ok = (F.col("satisfied") | ~must) & ~generic_only & (density >= F.col("min_density"))
    return out.select(
        "qid", "pattern_id", "kind", "level", "satisfied", F.round(density, 6).alias("info_density"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.col("satisfied"), 0.7).otherwise(0.0) + density * 0.3)), 6).alias("score"), ok.alias("fulfilled"),
    )


def contract_summary(results: DataFrame) -> DataFrame:
    """Missing counts per level; schema contracts never reject."""
    miss = ~F.col("satisfied")
    cnt = lambda c: F.sum(c.cast("int"))
    return results.groupBy("qid").agg(
        cnt(miss & (F.col("level") == "hard") & (F.col("kind") != "schema")).alias("hard_missing"),
        cnt(miss & (F.col("level") == "soft") & (F.col("kind") != "schema")).alias("soft_missing"),
        cnt(miss & (F.col("kind") == "schema")).alias("schema_missing"), F.round(F.avg("score"), 6).alias("score"),
    ).withColumn("fulfilled", F.col("hard_missing") == 0)


# --- A17, A18, Q10 ---------------------------------------------------------------------------
def slot_status(items: DataFrame) -> DataFrame:
    """``items(qid, slot, level, min_evidence, n_cleaned, n_removed)``, one row per evidence block.

    A schema slot needs enough blocks with values and a keep ratio of 0.34; others need items.
    """
    g = items.groupBy("qid", "slot", "level", "min_evidence").agg(
        F.count(F.lit(1)).alias("n_items"), F.sum((F.col("n_cleaned") > 0).cast("int")).alias("blocks"),
        F.sum("n_cleaned").alias("kept"), F.sum("n_removed").alias("gone"),
    )
    ratio = F.col("kept") / F.greatest(F.lit(1), F.col("kept") + F.col("gone"))
    schema_ok = (F.col("blocks") >= F.greatest(F.lit(1), F.col("min_evidence"))) & (ratio >= 0.34)
    ok = F.when(F.col("level") == "schema", schema_ok).otherwise(F.col("n_items") >= F.col("min_evidence"))
    return g.select("qid", "slot", F.when(ok, "satisfied").otherwise("missing").alias("status"), F.round(ratio, 6).alias("keep_ratio"))


def slot_coverage(wanted: DataFrame, facets: DataFrame) -> DataFrame:
    """Evidence count per wanted slot. ``wanted(qid, slot)``, ``facets(qid, block_id, slot)``."""
    n = facets.select("qid", "block_id", "slot").distinct().groupBy("qid", "slot").agg(F.count(F.lit(1)).alias("evidence_count"))
    return wanted.distinct().join(n, ["qid", "slot"], "left").select(
        "qid", "slot", F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"), F.col("evidence_count").isNotNull().alias("covered")
    )


def sidecar_guard(decision: Column, style: Column, wanted: Column, covered: Column) -> Column:
    """Q10: a factual answer without any covered slot becomes an explanation."""
    hit = (decision == "ALLOW") & (style == "FACTUAL_ASSERTION") & (wanted > 0) & (covered == 0)
    return F.struct(F.when(hit, "EXPLANATION").otherwise(style).alias("style"), F.when(hit, "slot-uncovered").alias("guard"))


# --- Q09 -------------------------------------------------------------------------------------
def normalize_style(c: Column) -> Column:
    s = F.lower(strip(F.coalesce(c, F.lit(""))))
    return (
        F.when(s.isin("explain", "explanation"), "EXPLANATION").when(s.isin("list", "list_only"), "LIST_ONLY")
        .when(s == "refuse", "REFUSE").otherwise("FACTUAL_ASSERTION")
    )


def gate_decision(
    style: Column, missing_hard: Column, missing_schema: Column, all_required_missing: Column, schema_slots: Column, required_schema: Column,
    required_soft: Column, required_hard: Column,
) -> Column:
    """Q09/U07 as a decision table: struct(decision, reason, final_style, allowed, retry).

    All inputs are counts or booleans; capabilities are the intersection of what the
    required slots' levels permit.
    """
    fact = ~(required_schema > 0) & ~(schema_slots > 0)
    lst = ~(required_soft > 0) & ~(required_hard > 0)
    expl = ~(required_hard > 0)
    satisfied = (schema_slots > 0) & (missing_schema == 0)
    fact = fact & ~satisfied
    wanted = normalize_style(style)
    wanted = F.when(satisfied & lst, "LIST_ONLY").when(satisfied & expl, "EXPLANATION").otherwise(wanted)
    fact = fact & ~all_required_missing
    any_allowed = fact | lst | expl
    style_ok = F.when(wanted == "FACTUAL_ASSERTION", fact).when(wanted == "LIST_ONLY", lst).when(wanted == "EXPLANATION", expl).otherwise(False)
    reason = (
        F.when(all_required_missing & expl, "required slots missing; downgrade to explanation")
        .when(all_required_missing, "required slots missing; no safe answer capability")
        .when(missing_hard > 0, "hard-slot-missing").when(satisfied & any_allowed, "schema-slot-satisfied; limit-style")
        .when(~any_allowed, "no-allowed-capability").when(~style_ok, "schema-level-slot-limits-answer")
        .when(missing_schema > 0, "schema-level-slot-limits-answer").otherwise("capability-allowed")
    )
    allow = reason.isin("required slots missing; downgrade to explanation", "schema-slot-satisfied; limit-style", "capability-allowed")
    final = F.when(~allow, F.lit(None)).when(all_required_missing, "EXPLANATION").otherwise(wanted)
    caps = F.array_compact(F.array(F.when(expl, F.lit("EXPLANATION")), F.when(fact, F.lit("FACTUAL_ASSERTION")), F.when(lst, F.lit("LIST_ONLY"))))
    return F.struct(
        F.when(allow, "ALLOW").otherwise("REFUSE").alias("decision"), reason.alias("reason"), final.alias("final_style"),
        F.when(allow, F.array_join(caps, ",")).otherwise("").alias("allowed"),
        (~allow & ((missing_schema > 0) | (reason == "schema-level-slot-limits-answer"))).alias("retry"),
    )


# --- K12, K13 --------------------------------------------------------------------------------
def injection_check(confidence: Column, min_confidence: float, schema_id: Column, active_schema: Column, sem: Column, slot_sem: Column, allowed: Column) -> Column:
    """First failing rule, or null; blanks on either side pass."""
    blank = lambda c: F.coalesce(strip(c), F.lit("")) == ""
    return (
        F.when(confidence.isNotNull() & (confidence < min_confidence), "LOW_CONFIDENCE")
        .when(~blank(active_schema) & ~blank(schema_id) & (schema_id != active_schema), "SCHEMA_MISMATCH")
        .when(~blank(slot_sem) & ~blank(sem) & (F.lower(strip(sem)) != F.lower(strip(slot_sem))), "SEMANTIC_TYPE_MISMATCH")
        .when(allowed.eqNullSafe(F.lit(False)), "NOT_APPROVED")
    )


def approved_records(units: DataFrame) -> DataFrame:
    """Approved rows with a non-blank claim, runtime columns only."""
    claim = strip(F.coalesce(F.col("claim"), F.lit("")))
    return units.where((F.col("status") == "approved") & (claim != "")).select(
        "evidence_id", claim.alias("semantic_text"), "semantic_type", "schema_id", "provenance",
        F.struct(F.lit(True).alias("allowed_injection"), F.lit(True).alias("list_only_allowed")).alias("contract"),
    )


# --- Q11 -------------------------------------------------------------------------------------
# Words that do not count in a query.
STOPWORDS = [
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "with", "by", "is", "are", "was", "were", "be", "as", "that",
    "this", "these", "those", "it", "its",
]


def query_terms(c: Column, max_terms: int | None = None) -> Column:
    """CJK bigrams when the query has CJK, else words without stop words; duplicates stay."""
    low = F.lower(strip(c))
    words = F.filter(F.regexp_extract_all(low, F.lit(r"[a-z0-9][a-z0-9\-_]{1,30}"), F.lit(0)), lambda t: ~t.isin(STOPWORDS))
    pairs = bind(
        F.regexp_extract_all(low, F.lit(f"[{CJK}]"), F.lit(0)),
        lambda x: F.when(F.size(x) > 1, F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: F.concat(a, b))).otherwise(
            F.array().cast("array<string>")
        ),
    )
    terms = F.when(low.rlike(f"[{CJK}]"), pairs).otherwise(words)
    return terms if max_terms is None else F.slice(terms, 1, max_terms)


def _bare(c: Column) -> Column:
    return F.translate(F.lower(c), "_ ", "")


def fuzzy_covered(have: Column, need: Column) -> Column:
    """Needed slots matched by equality or containment either way."""
    return F.filter(need, lambda r: F.exists(have, lambda h: F.contains(_bare(h), _bare(r)) | F.contains(_bare(r), _bare(h))))


def choose_schema(cands: DataFrame, max_selected: int = 1, min_overlap: int = 2) -> DataFrame:
    """Q11: ``cands(qid, cand_no, query, text, slots, required, answered)`` -> selected rows.

    A slot gate first, then words of the query contained in the candidate's text; the
    best gated candidate is the fallback. Candidates of a query come from a top-k.
    """
    open_ = F.array_except("required", "answered")
    gate = (F.size(open_) == 0) | (F.size(fuzzy_covered(F.col("slots"), open_)) > 0)
    low = F.lower("text")
    overlap = bind(query_terms(F.col("query")), lambda ts: F.size(F.filter(ts, lambda t: F.contains(low, t))))
    s = cands.where(gate).withColumn("overlap", overlap)
    w = Window.partitionBy("qid").orderBy(F.col("overlap").desc(), "cand_no")
    r = s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_selected)
    return r.where((F.col("overlap") >= min_overlap) | (F.col("rank") == 1)).select("qid", "cand_no", "overlap", "rank")


# --- Q20, Q21, Q22, Q23, Q26, Q29, Q30, Q31 --------------------------------------------------
# An abbreviation with its expansion in parentheses.
PAREN_EXPANSION = r"\b([A-Za-z][A-Za-z0-9_-]{1,})[（(]([^）)]{1,64})[）)]"


def unapproved_expansions(answer: Column, reference: Column) -> Column:
    """Q20: parenthesized expansions of the answer that the reference text does not contain."""
    spans = F.arrays_zip(
        F.regexp_extract_all(answer, F.lit(PAREN_EXPANSION), F.lit(1)).alias("abbr"), F.regexp_extract_all(answer, F.lit(PAREN_EXPANSION), F.lit(2)).alias("inner"),
    )

    def approved(s: Column) -> Column:
        zh = F.concat(s["abbr"], F.lit("（"), s["inner"], F.lit("）"))
        en = F.concat(s["abbr"], F.lit("("), s["inner"], F.lit(")"))
        inner = strip(s["inner"])
        return F.contains(reference, zh) | F.contains(reference, en) | ((inner != "") & F.contains(reference, inner))

    return F.filter(spans, lambda s: ~approved(s))


def strip_expansions(answer: Column, unapproved: Column) -> Column:
    """Q20: each unapproved expansion is reduced to its abbreviation."""
    return F.aggregate(
        unapproved, answer,
        lambda acc, s: F.replace(
            F.replace(acc, F.concat(s["abbr"], F.lit("("), s["inner"], F.lit(")")), s["abbr"]),
            F.concat(s["abbr"], F.lit("（"), s["inner"], F.lit("）")), s["abbr"],
        ),
    )


# Projection type and statement per semantic axis.
PROJECTIONS = {
    "symptom": ("clinical_manifestation", "指南或权威资料中明确记载的临床表现包括："),
    "drug": ("treatment_recommendation", "指南中列出的治疗或用药建议包括："),
    "mechanism": ("pathophysiology_statement", "权威资料中描述的发病机制包括："),
    "location": ("epidemiologic_distribution", "文献中报道的流行病学分布包括："),
}


def evidence_projection(evidence: DataFrame, axis: str, min_quality: float = 0.0) -> DataFrame:
    """Q21: rows of the axis with a source reference, in order, under a fixed statement. No merging."""
    kind, statement = PROJECTIONS[axis]
    ok = (F.lower(strip(F.col("semantic_primary"))) == axis) & (F.col("quality") >= min_quality) & F.col("source_name").isNotNull() & (F.col("source_name") != "")
    return evidence.where(ok).select("qid", "evidence_id", "text", "source_name", F.lit(kind).alias("projection_type"), F.lit(statement).alias("statement"))


# Intents that entity priming may serve.
PRIMING_INTENTS = ["definition", "abbreviation", "identity", "名称", "定义", "缩写"]


def priming_verdict(intent: Column, has_evidence: Column, tags: Column, block_id: Column, context: Column) -> Column:
    """Q22: reason code; the first applicable rule decides."""
    it, bid = F.lower(strip(intent)), F.lower(block_id)
    low_tags = F.transform(tags, lambda t: F.lower(strip(t)))
    kw = strip(F.replace(F.replace(bid, F.lit("ep_"), F.lit("")), F.lit("_"), F.lit(" ")))
    return (
        F.when(has_evidence & ~it.isin(PRIMING_INTENTS), "rag_sufficiency_gate")
        .when(tags.isNotNull() & (F.array_contains(low_tags, "*") | F.array_contains(low_tags, it)), "intent_tag_match")
        .when(tags.isNotNull(), "intent_tag_mismatch").when(F.contains(bid, F.lit("_name")), "name_item")
        .when((kw != "") & F.contains(context, kw), "entity_in_context").otherwise("entity_not_in_context")
    )


# Hedges and medical keywords of the self-critique.
HEDGES = ["不确定", "尚不清楚", "证据不足", "可能", "推测", "无法确认", "i am not sure", "i'm not sure", "unclear", "unknown", "no clear evidence"]
MEDICAL_WORDS = [
    "fda", "approved", "indication", "contraindication", "adverse", "side effect", "dosage", "drug", "medication", "treatment", "therapy",
    "clinical", "trial", "已批准", "适应症", "禁忌", "不良反应", "副作用", "剂量", "用法", "药物", "药品", "治疗", "临床", "试验",
]


def self_critique(question: Column, answer: Column) -> Column:
    """Q26: struct(is_medical, confidence)."""
    a = F.lower(answer)
    hits = sum((F.contains(a, F.lit(h)).cast("int") for h in HEDGES), F.lit(0))
    conf = F.lit(0.85) - F.least(F.lit(3), hits) * 0.20 - F.when(F.length(strip(answer)) < 80, 0.25).otherwise(0.0)
    return F.struct(
        any_contains(F.lower(question), MEDICAL_WORDS).alias("is_medical"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf)), 6).alias("confidence")
    )


def is_low_quality(c: Column) -> Column:
    """Q29."""
    t = strip(F.coalesce(c, F.lit("")))
    n = F.greatest(F.lit(1), F.length(t))
    lang = F.regexp_count(t, F.lit(f"[A-Za-z0-9{CJK}]"))
    odd = F.regexp_count(t, F.lit(r"[<>{}\\\[\]|`~^_*=&$#@%]"))
    return (
        (F.length(t) < 12) | t.rlike(r"\x{fffd}") | t.rlike("<>|><") | t.rlike(r"(.)\1{6,}") | (lang / n < 0.52) | (odd / n > 0.10)
    )


def display_keywords(c: Column) -> Column:
    """Q30: words of three letters or more and CJK runs, distinct in order."""
    words = F.filter(F.regexp_extract_all(c, F.lit(r"[A-Za-z][A-Za-z0-9\-_/]{1,}"), F.lit(0)), lambda w: F.length(w) >= 3)
    return F.array_distinct(F.concat(words, F.regexp_extract_all(c, F.lit(f"[{CJK}]{{2,4}}"), F.lit(0))))


def keyword_sentences(text: Column, keywords: Column, k: int = 3, excerpt: int = 240) -> Column:
    """Q30: first k sentences holding a keyword, else an excerpt."""
    from ..functions.sentences import split_ws

    hits = F.slice(F.filter(split_ws(text), lambda s: F.exists(keywords, lambda w: F.contains(s, w))), 1, k)
    return bind(hits, lambda h: F.when(F.size(h) > 0, h).otherwise(F.array(F.substring(text, 1, excerpt))))


def highlight(sentence: Column, keywords: Column) -> Column:
    """Q30: every keyword wrapped in double brackets, one after the other."""
    return F.aggregate(keywords, sentence, lambda acc, w: F.replace(acc, w, F.concat(F.lit("[["), w, F.lit("]]"))))


# Violations that call for another answer.
REGENERATE_ON = ["abbr_expansion_not_in_evidence", "intent_drift_deny_terms", "answer_items_not_in_injected_evidence"]


def regeneration(violations: Column, output_low: Column, baseline_low: Column) -> Column:
    """Q31: regenerate, fall back to the baseline, or keep."""
    again = F.arrays_overlap(violations, F.array(*[F.lit(v) for v in REGENERATE_ON]))
    return F.when(output_low & ~baseline_low, "baseline").when(again, "regenerate").otherwise("keep")


# --- U06, U10, U11, Q32, C32 -----------------------------------------------------------------
# Substrings that route a query to the table bank.
TABLE_KEYWORDS = [
    "auc", "or", "hr", "ci", "95%", "p-value", "p value", "cutoff", "threshold", "sensitivity", "specificity", "multivariable",
    "univariable", "regression", "baseline", "cohort", "odds ratio", "hazard ratio", "confidence interval", "阈值", "cut-off", "敏感度",
    "特异度", "回归", "多变量", "单变量", "基线", "对照", "比较", "风险因素", "危险因素", "发生率", "死亡", "死亡率", "表1", "表 1",
    "table 1", "table",
]


def routes_to_tables(c: Column) -> Column:
    """Any keyword as a substring, or a number with a percentage or p-value cue."""
    q = F.lower(strip(c))
    number = q.rlike(f"{BOUND_L}\\d+(\\.\\d+)?{BOUND_R}") & q.rlike("%|95|p<|p =|p=")
    return (q != "") & (any_contains(q, TABLE_KEYWORDS) | number)


def needs_regeneration(want: Column, have: Column, stale: Column) -> Column:
    """U11."""
    return (F.size(F.array_except(want, have)) > 0) | stale


# Relation operators in words.
OPERATOR_WORDS = [(">", "大于"), (">=", "大于等于"), ("<", "小于"), ("<=", "小于等于"), ("=", "等于"), ("!=", "不等于")]


def relation_claim(var: Column, op: Column, val: Column) -> Column:
    """Claim sentence of a relation; null when the relation is invalid."""
    v, o, x = strip(var), strip(op), strip(val)
    parts = F.filter(F.transform(F.split(x, ","), strip), lambda p: p != "")
    word = reduce(lambda acc, kv: acc.when(o == kv[0], kv[1]), OPERATOR_WORDS[1:], F.when(o == OPERATOR_WORDS[0][0], OPERATOR_WORDS[0][1]))
    ranged = F.when(
        F.size(parts) == 2, F.concat(F.lit("临床变量"), v, F.lit("取值范围在"), F.get(parts, 0), F.lit("到"), F.get(parts, 1), F.lit("之间。"))
    )
    return F.when((v == "") | (x == ""), F.lit(None)).when(o == "range", ranged).when(word.isNotNull(), F.concat(F.lit("临床变量"), v, word, x, F.lit("。")))


def detail_lines(abstract: Column, notes: Column, relations: Column) -> Column:
    """Q32: abstract, numbered notes, relation claims; blanks dropped, distinct in order."""
    numbered = F.transform(notes, lambda n, i: F.when(strip(n) != "", F.concat((i + 1).cast("string"), F.lit(". "), strip(n))))
    lines = F.concat(F.array(strip(abstract)), numbered, relations)
    return F.array_distinct(F.filter(lines, lambda x: x.isNotNull() & (x != "")))


def fuzzy_key(c: Column, vocab: list[str]) -> Column:
    """Exact normalized match, else containment; vocabulary order breaks ties."""
    v = F.translate(F.lower(c), "- ", "__")
    exact = [F.when(v == k.lower().replace("-", "_").replace(" ", "_"), F.lit(k)) for k in vocab]
    part = [F.when((v != "") & (F.contains(F.lit(k.lower()), v) | F.contains(v, F.lit(k.lower()))), F.lit(k)) for k in vocab]
    return F.coalesce(*exact, *part)


def parse_triples(raw: Column) -> Column:
    """JSON array of a model output (fenced or embedded) as an array of structs."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*\n?(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(raw)
    arr = F.regexp_extract(body, r"(?s)\[.*\]", 0)
    schema = "array<struct<subject:string,subject_type:string,predicate:string,object:string,object_type:string,confidence:double,sentence_index:int>>"
    rows = F.from_json(arr, schema)
    full = F.filter(rows, lambda t: (F.coalesce(strip(t["subject"]), F.lit("")) != "") & (F.coalesce(strip(t["predicate"]), F.lit("")) != "") & (F.coalesce(strip(t["object"]), F.lit("")) != ""))
    return F.coalesce(full, F.array().cast(schema))




# Cues of a question's target type, as written and in lower case; the order is that of the types.
TARGET_CUES = {
    "symptom": (["临床表现", "症状", "表现"], ["manifestation", "symptom"]),
    "drug": (["治疗", "药物", "用药", "批准", "获批"], ["fda", "drug", "treat"]),
    "location": (["地区", "哪里", "哪些地方", "分布", "省", "市"], ["where", "distribution", "reported in"]),
    "mechanism": (["机制", "作用机制", "发病机制", "致病机制"], ["pathogenesis", "mechanism"]),
}


def target_types(question: Column, contract_types: Column | None = None) -> Column:
    """Q23: struct(target, types). One type given by a contract decides; else the cues do: one, several ("multi") or none ("unknown").

    Types of a contract that say nothing (generic, other, blank) do not count.
    """
    q = strip(F.coalesce(question, F.lit("")))
    low = F.lower(q)
    active = F.array_compact(F.array(*[F.when(any_contains(q, seen) | any_contains(low, lower), F.lit(t)) for t, (seen, lower) in TARGET_CUES.items()]))
    by_cue = F.struct(F.when(F.size(active) == 1, F.get(active, 0)).when(F.size(active) > 1, "multi").otherwise("unknown").alias("target"), active.alias("types"))
    if contract_types is None:
        return by_cue
    named = F.array_distinct(F.filter(F.transform(contract_types, lambda t: F.lower(strip(t))), lambda t: ~t.isin("", "generic", "other")))
    return F.when(F.coalesce(F.size(named) == 1, F.lit(False)), F.struct(F.get(named, 0).alias("target"), named.alias("types"))).otherwise(by_cue)


def denied_terms(answer: Column, question: Column, terms: Column) -> Column:
    """Q20: denied terms that the answer has and the question did not ask about, in the given order."""
    clean = F.filter(F.transform(terms, strip), lambda t: t != "")
    return F.filter(clean, lambda t: ~F.contains(question, t) & F.contains(answer, t))


def items_not_in_evidence(items: Column, evidence: Column) -> Column:
    """Q20: enumerated items that the joined evidence does not contain; nothing to say without evidence."""
    return F.when(strip(F.coalesce(evidence, F.lit(""))) == "", F.array().cast("array<string>")).otherwise(F.filter(F.array_distinct(items), lambda x: ~F.contains(evidence, x)))


def slot_rejection(pattern_id: Column, schema_id: Column, slot_type: Column, evidence_type: Column) -> Column:
    """Q08: why a schema slot refuses an evidence, else null; blanks on either side match anything."""
    clean = lambda c: strip(F.coalesce(c, F.lit("")))
    p, s, a, b = clean(pattern_id), clean(schema_id), F.lower(clean(slot_type)), F.lower(clean(evidence_type))
    return F.when((p != "") & (s != "") & (p != s), "SCHEMA_MISMATCH").when((a != "") & (b != "") & (a != b), "SEMANTIC_TYPE_MISMATCH")
