"""Pattern, gating, hygiene and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sentences as N, slots as L, text as T
from ..functions.rows import explode_rows
from ..operators import aggregate as A, extract as X, folds as Fo, gating as G, hygiene as H, joins as J, values as V, vectors as Ve
from ..registry import query
from ..session import spread
from ..sources.tables import documents, table
from . import sqlparts as S
from .vectors import MEANS, _ranked, bank, class_queries

FIRST = "regexp_extract(text, '^[A-Za-z]{3,}')"


def bench(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def first_words(spark, d):
    """A dictionary that grows with the corpus: the first word of every document."""
    w = F.regexp_extract("text", "^[A-Za-z]{3,}", 0)
    return documents(spark, d).select(w.alias("term")).where("term <> ''").distinct()


HITS = rf"""t as (select distinct {FIRST} as term from documents where {FIRST} <> ''),
    tok as (select item_id as qid, unnest(regexp_extract_all(text, '[A-Za-z0-9_/-]+')) as w from benchmark),
    h as (select item_id as qid, 'fixed_entity:' || term as block_id, unnest(['fixed_entity', 'literal']) as kind, 0.95 as confidence from benchmark join t on contains(text, term)
      union all select qid, 'abbr:' || term, unnest(['abbreviation_expansion', 'literal']), 0.95 from tok join t on lower(w) = lower(term)
      union all select qid, 'abbr_heur:' || w, unnest(['abbreviation_candidate', 'literal']), 0.35 from tok where length(w) between 2 and 10 and regexp_matches(w, '[A-Z]') and not regexp_matches(w, '[a-z]')
      union all select item_id, 'schema:' || term, unnest(['schema_trigger', 'structure']), 0.7 from benchmark join t on contains(lower(text), lower(term)))"""


@query(
    "pattern_hits", "Q01,Q02,U04,J04,J05,T21,S19",
    rf"""with t as (select distinct {FIRST} as term from documents where {FIRST} <> ''),
    tok as (select item_id as qid, unnest(regexp_extract_all(text, '[A-Za-z0-9_/-]+')) as w from benchmark),
    h as (select item_id as qid, 'fixed_entity:' || term as block_id, unnest(['fixed_entity', 'literal']) as kind, 0.95 as confidence from benchmark join t on contains(text, term)
      union all select qid, 'abbr:' || term, unnest(['abbreviation_expansion', 'literal']), 0.95 from tok join t on lower(w) = lower(term)
      union all select qid, 'abbr_heur:' || w, unnest(['abbreviation_candidate', 'literal']), 0.35 from tok where length(w) between 2 and 10 and regexp_matches(w, '[A-Z]') and not regexp_matches(w, '[a-z]')
      union all select item_id, 'schema:' || term, unnest(['schema_trigger', 'structure']), 0.7 from benchmark join t on contains(lower(text), lower(term)))
    select qid, block_id, string_agg(distinct kind, ',' order by kind) as hit_types, max(confidence)::double as confidence from h group by all""",
)
def pattern_hits(spark, d):
    t = first_words(spark, d)
    out = G.pattern_hits(bench(spark, d), t.withColumn("canonical", F.col("term")), t, t)
    return out.select("qid", "block_id", F.array_join("hit_types", ",").alias("hit_types"), "confidence")


@query(
    "contract_levels", "Q05",
    f"""with {HITS}, d as (select qid, block_id, max(confidence) as c from h group by all),
    k as (select case when block_id like 'abbr%' then 'abbr' when block_id like 'schema:%' then 'schema' when block_id like 'fixed_entity:%' then 'entity' else 'other' end as kind,
      regexp_replace(block_id, '^[a-z_]+:', '') as name, c from d)
    select kind, case when kind = 'abbr' and length(name) >= 4 and c >= 0.9 then 'hard' else 'soft' end as level,
     case kind when 'abbr' then 0.3 when 'schema' then 0.45 when 'entity' then 0.35 else 0.2 end::double as min_density, count(*) as n from k group by all""",
)
def contract_levels(spark, d):
    t = first_words(spark, d)
    hits = G.pattern_hits(bench(spark, d), t.withColumn("canonical", F.col("term")), t, t)
    return G.contracts_from_hits(hits).groupBy("kind", "level", "min_density").agg(F.count(F.lit(1)).alias("n"))


CONTRACTS = [
    {"pattern_id": "abbr:THE", "forms": ["What is X", "What does X stand for"], "slots": ["abbr"], "schema": False},
    {"pattern_id": "schema:the", "forms": ["how is the X", "where is the thing of X"], "slots": ["the"], "schema": True},
    {"pattern_id": "schema:treatment", "forms": ["what treatment has X"], "slots": ["treatment"], "schema": True},
]


@query("contract_match", "Q03,S20")
def contract_match(spark, d):
    q = bench(spark, d).withColumn("hit_ids", F.array().cast("array<string>"))
    return G.match_contracts(q, CONTRACTS)


@query("schema_scores", "Q04")
def schema_scores(spark, d):
    s = G.schema_scores(F.col("text"), ["schema:treatment", "schema:epidemiology", "abbr:SFTS", "entity:x"])
    rows = explode_rows(documents(spark, d), ["doc_id"], s, "rank", "s")
    return rows.groupBy("rank", "s.schema_id", "s.score").agg(F.count(F.lit(1)).alias("n"))


def signal_rows(spark, d):
    c = F.col("text")
    rows = documents(spark, d, "text", "source").select(
        F.col("source").alias("qid"), F.col("doc_id").alias("block_id"), X.abbreviation_pairs(c).alias("pairs"), X.entity_candidates(c).alias("ents"),
        L.registry_slots(c).alias("slots"), T.is_table_text(c).alias("tab"),
    )
    sig = G.block_signals(F.col("pairs"), F.col("ents"), F.col("slots"), L.block_type(F.col("slots"), F.col("tab")), F.col("tab"))
    return explode_rows(rows, ["qid", "block_id"], sig, "s").select("qid", "block_id", "s.signal", "s.info")


@query("contract_validation", "A15,A16,Q06,Q07")
def contract_validation(spark, d):
    srcs = table(spark, d, "documents").select(F.col("source").alias("qid")).distinct()
    c = srcs.select(
        "qid", F.explode(F.array(
            F.struct(F.lit("schema:treatment").alias("pattern_id"), F.lit("schema").alias("kind"), F.lit("soft").alias("level"), F.lit("schema_slot:treatment").alias("required"), F.lit(0.45).alias("min_density")),
            F.struct(F.lit("entity:The").alias("pattern_id"), F.lit("entity").alias("kind"), F.lit("hard").alias("level"), F.lit("entity:The").alias("required"), F.lit(0.35).alias("min_density")),
        )).alias("c"),
    ).select("qid", "c.*")
    return G.contract_summary(G.validate_contracts(c, signal_rows(spark, d)))


@query(
    "slot_status", "A17,A18",
    """with i as (select user_id as qid, event_type as slot, case when event_type in ('click', 'view') then 'schema' else 'soft' end as level, (case when value > 10 then 1 else 0 end) as c, (case when value <= 5 then 1 else 0 end) as r from events),
    g as (select qid, slot, level, count(*) as n, sum((c > 0)::int) as b, sum(c) as k, sum(r) as x from i group by all)
    select qid, slot, case when case when level = 'schema' then b >= 2 and k / greatest(1, k + x) >= 0.34 else n >= 2 end then 'satisfied' else 'missing' end as status, round(k / greatest(1, k + x), 6) as keep_ratio from g""",
)
def slot_status(spark, d):
    e = table(spark, d, "events")
    items = e.select(
        F.col("user_id").alias("qid"), F.col("event_type").alias("slot"), F.when(F.col("event_type").isin("click", "view"), "schema").otherwise("soft").alias("level"),
        F.lit(2).alias("min_evidence"), (F.col("value") > 10).cast("int").alias("n_cleaned"), (F.col("value") <= 5).cast("int").alias("n_removed"),
    )
    return G.slot_status(items)


@query(
    "slot_coverage", "A18",
    """with w as (select distinct user_id as qid, event_type as slot from events), f as (select user_id as qid, event_type as slot, count(distinct event_id) as n from events where value > 25 group by all)
    select qid, slot, coalesce(n, 0) as evidence_count, n is not null as covered from w left join f using (qid, slot)""",
)
def slot_coverage(spark, d):
    e = table(spark, d, "events")
    want = e.select(F.col("user_id").alias("qid"), F.col("event_type").alias("slot"))
    fac = e.where("value > 25").select(F.col("user_id").alias("qid"), F.col("event_id").alias("block_id"), F.col("event_type").alias("slot"))
    return G.slot_coverage(want, fac)


@query(
    "gate_decisions", "Q09,U07",
    """with o as (select l_orderkey, max(l_linenumber) as n, sum((l_returnflag = 'R')::int) as mh, sum((l_returnflag = 'A')::int) as ms, bool_and(l_linestatus = 'O') as bare, sum((l_linenumber > 4)::int) as ss,
       sum((l_linenumber > 5)::int) as rs, sum((l_quantity > 45)::int) as rf, sum((l_quantity < 3)::int) as rh from lineitem group by 1),
    a as (select *, rs = 0 and ss = 0 and not (ss > 0 and ms = 0) and not bare as fact, rf = 0 and rh = 0 as lst, rh = 0 as expl, ss > 0 and ms = 0 as sat from o),
    b as (select *, case when sat and lst then 'LIST_ONLY' when sat and expl then 'EXPLANATION' else 'FACTUAL_ASSERTION' end as w from a),
    r as (select *, case when bare and expl then 'required slots missing; downgrade to explanation' when bare then 'required slots missing; no safe answer capability' when mh > 0 then 'hard-slot-missing'
      when sat and (fact or lst or expl) then 'schema-slot-satisfied; limit-style' when not (fact or lst or expl) then 'no-allowed-capability'
      when not case w when 'FACTUAL_ASSERTION' then fact when 'LIST_ONLY' then lst else expl end then 'schema-level-slot-limits-answer' when ms > 0 then 'schema-level-slot-limits-answer' else 'capability-allowed' end as reason from b)
    select reason, case when reason in ('required slots missing; downgrade to explanation', 'schema-slot-satisfied; limit-style', 'capability-allowed') then case when bare then 'EXPLANATION' else w end end as final_style, count(*) as n from r group by all""",
)
def gate_decisions(spark, d):
    li = table(spark, d, "lineitem")
    cnt = lambda c: F.sum(c.cast("int"))
    o = li.groupBy("l_orderkey").agg(
        cnt(F.col("l_returnflag") == "R").alias("mh"), cnt(F.col("l_returnflag") == "A").alias("ms"), F.bool_and(F.col("l_linestatus") == "O").alias("bare"),
        cnt(F.col("l_linenumber") > 4).alias("ss"), cnt(F.col("l_linenumber") > 5).alias("rs"), cnt(F.col("l_quantity") > 45).alias("rf"), cnt(F.col("l_quantity") < 3).alias("rh"),
    )
    g = G.gate_decision(F.lit("factual"), *[F.col(c) for c in ("mh", "ms", "bare", "ss", "rs", "rf", "rh")])
    return o.select(g.alias("g")).groupBy("g.reason", "g.final_style").agg(F.count(F.lit(1)).alias("n"))


@query(
    "injection_check", "K12,K13",
    """with u as (select l_orderkey, l_linenumber, l_discount as conf, 'schema:' || l_returnflag as sid, case when l_linestatus = 'O' then 'drug' else '' end as sem, l_tax > 0.01 as ok from lineitem)
    select case when conf < 0.03 then 'LOW_CONFIDENCE' when sid <> 'schema:A' then 'SCHEMA_MISMATCH' when sem <> '' and sem <> 'symptom' then 'SEMANTIC_TYPE_MISMATCH' when not ok then 'NOT_APPROVED' end as code, count(*) as n from u group by 1""",
)
def injection_check(spark, d):
    li = table(spark, d, "lineitem")
    code = G.injection_check(
        F.col("l_discount"), 0.03, F.concat(F.lit("schema:"), "l_returnflag"), F.lit("schema:A"), F.when(F.col("l_linestatus") == "O", "drug").otherwise(""),
        F.lit("symptom"), F.col("l_tax") > 0.01,
    )
    return li.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "approved_runtime", "K12",
    """with u as (select doc_id, trim(source) as src, text, case when quality = 1 then 'approved' else 'draft' end as status from documents join labels using (doc_id))
    select doc_id as evidence_id, md5({}) as text_md5, src as provenance from u where status = 'approved' and {} <> ''""".format(S.strip("text"), S.strip("text")),
)
def approved_runtime(spark, d):
    u = documents(spark, d, "text", "source").join(table(spark, d, "labels"), "doc_id").select(
        F.col("doc_id").alias("evidence_id"), F.col("text").alias("claim"), F.lit("generic").alias("semantic_type"), F.lit("s").alias("schema_id"),
        F.col("source").alias("provenance"), F.when(F.col("quality") == 1, "approved").otherwise("draft").alias("status"),
    )
    return G.approved_records(u).select("evidence_id", F.md5("semantic_text").alias("text_md5"), "provenance")


@query("schema_choice", "Q11,U05,U06")
def schema_choice(spark, d):
    """The best three documents of each benchmark text compete on slots, then on words."""
    from ..operators.retrieval import text_search

    q = bench(spark, d)
    docs = documents(spark, d)
    hits = text_search(q, docs, k=3)
    c = hits.join(q.withColumnRenamed("text", "query"), "qid").join(docs, "doc_id").select(
        "qid", F.col("rank").alias("cand_no"), "query", "text", L.registry_slots(F.col("text")).alias("slots"), L.registry_slots(F.col("query")).alias("required"),
        F.array().cast("array<string>").alias("answered"),
    )
    return G.choose_schema(c)


@query(
    "table_routing", "U10",
    f"""select doc_id, (regexp_matches(q, '{"|".join(k.replace("%", "%") for k in G.TABLE_KEYWORDS)}') or (regexp_matches(q, '(^|[^{S.WORD}])\\d+(\\.\\d+)?($|[^{S.WORD}])') and regexp_matches(q, '%|95|p<|p =|p='))) as tables
    from (select doc_id, lower(text) as q from documents)""",
)
def table_routing(spark, d):
    return documents(spark, d).select("doc_id", G.routes_to_tables(F.col("text")).alias("tables"))


@query(
    "self_critique", "Q26",
    f"""with t as (select conv_id, turn, lower(text) as a, length({S.strip('text')}) < 80 as short from conversations)
    select conv_id, turn, round(greatest(0.0, 0.85 - 0.2 * least(3, {" + ".join(f"contains(a, {S.sql_str(h)})::int" for h in G.HEDGES)}) - case when short then 0.25 else 0 end), 6)::double as confidence,
    regexp_matches(a, '{"|".join(G.MEDICAL_WORDS)}') as is_medical from t""",
)
def self_critique(spark, d):
    c = table(spark, d, "conversations")
    r = G.self_critique(F.col("text"), F.col("text"))
    return c.select("conv_id", "turn", r.alias("r")).select("conv_id", "turn", "r.confidence", "r.is_medical")


@query(
    "low_quality", "Q29",
    rf"""select doc_id, (length(t) < 12 or contains(t, chr(65533)) or regexp_matches(t, '<>|><') or {S.has_run('cs', 7)}
     or len(regexp_extract_all(t, '[A-Za-z0-9{S.CJK}]')) / greatest(1, length(t)) < 0.52 or len(regexp_extract_all(t, '[<>{{}}\\\[\]|`~^_*=&$#@%]')) / greatest(1, length(t)) > 0.10) as low
    from (select doc_id, t, string_split(t, '') as cs from (select doc_id, {S.strip('text')} as t from documents))""",
)
def low_quality(spark, d):
    return documents(spark, d).select("doc_id", G.is_low_quality(F.col("text")).alias("low"))


@query("keyword_display", "Q30")
def keyword_display(spark, d):
    c = table(spark, d, "conversations")
    kw = G.display_keywords(F.col("text"))
    shown = c.select("conv_id", "turn", "text", kw.alias("kw")).select("conv_id", "turn", "kw", F.explode(G.keyword_sentences(F.col("text"), F.col("kw"))).alias("s"))
    return shown.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(G.highlight(F.col("s"), F.col("kw")))).alias("chars"))


@query("violations", "Q20,Q31")
def violations(spark, d):
    docs = documents(spark, d, "text", "source")
    v = G.unapproved_expansions(F.col("text"), F.col("source"))
    r = docs.select("doc_id", "text", v.alias("v"))
    return r.select(
        "doc_id", F.size("v").alias("n"), F.length(G.strip_expansions(F.col("text"), F.col("v"))).alias("n_chars"),
        G.regeneration(F.when(F.size("v") > 0, F.array(F.lit(G.REGENERATE_ON[0]))).otherwise(F.array().cast("array<string>")), G.is_low_quality(F.col("text")), F.lit(False)).alias("action"),
    )


@query(
    "priming_filter", "Q22",
    """with e as (select *, case event_type when 'click' then 'definition' when 'view' then 'drug' else 'symptom' end as intent from events)
    select case when value > 20 and intent <> 'definition' then 'rag_sufficiency_gate' when event_type = 'purchase' then 'intent_tag_match' when event_type = 'error' then 'intent_tag_mismatch'
      when contains('ep_' || event_type || '_' || user_id, '_name') then 'name_item' when contains(props, event_type || ' ' || user_id) then 'entity_in_context' else 'entity_not_in_context' end as reason, count(*) as n from e group by 1""",
)
def priming_filter(spark, d):
    e = table(spark, d, "events")
    et = F.col("event_type")
    intent = F.when(et == "click", "definition").when(et == "view", "drug").otherwise("symptom")
    tags = F.when(et == "purchase", F.array(F.lit("Symptom"))).when(et == "error", F.array(F.lit("other")))
    bid = F.concat(F.lit("ep_"), et, F.lit("_"), F.col("user_id").cast("string"))
    r = G.priming_verdict(intent, F.col("value") > 20, tags, bid, F.lower("props"))
    return e.groupBy(r.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "evidence_projection", "Q21",
    """select source as qid, doc_id as evidence_id, 'clinical_manifestation' as projection_type from documents join labels using (doc_id) where quality >= 1 and lang = 'en' and source <> ''""",
)
def evidence_projection(spark, d):
    ev = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(
        F.col("source").alias("qid"), F.col("doc_id").alias("evidence_id"), "text", F.col("source").alias("source_name"), "quality",
        F.when(F.col("lang") == "en", "Symptom").otherwise("drug").alias("semantic_primary"),
    )
    return G.evidence_projection(ev, "symptom", 1).select("qid", "evidence_id", "projection_type")


@query(
    "relation_claims", "C32,Q32",
    """select l_orderkey, l_linenumber, '临床变量' || l_returnflag || case l_linestatus when 'O' then '大于等于' else '小于' end || l_quantity::int || '。' as claim from lineitem""",
)
def relation_claims(spark, d):
    li = table(spark, d, "lineitem")
    claim = G.relation_claim(F.col("l_returnflag"), F.when(F.col("l_linestatus") == "O", ">=").otherwise("<"), F.col("l_quantity").cast("int").cast("string"))
    return li.select("l_orderkey", "l_linenumber", claim.alias("claim"))


@query(
    "detail_lines", "Q32",
    f"""with x as (select doc_id, [{S.strip('text')}, '1. ' || lang, '2. ' || source] as ls from documents)
    select doc_id, i::int - 1 as line_no, ls[i] as line from (select doc_id, list_filter(ls, lambda v: v <> '') as ls, unnest(range(1, len(list_filter(ls, lambda v: v <> '')) + 1)) as i from x)""",
)
def detail_lines(spark, d):
    docs = documents(spark, d, "text", "lang", "source")
    lines = G.detail_lines(F.col("text"), F.array("lang", "source"), F.array().cast("array<string>"))
    return explode_rows(docs, ["doc_id"], lines, "line_no", "line")


@query(
    "triple_parse", "X17,C33,G15,T04,T08",
    """select case o_orderstatus when 'F' then 'located_in' when 'O' then 'treats' else 'unheard of' end as predicate, o_orderpriority as object, 0.9::double as confidence, count(*) as n from orders group by 1, 2""",
)
def triple_parse(spark, d):
    """Orders rendered as a model's JSON answer, parsed back with vocabulary repair."""
    from ..functions.taxonomy import RELATIONS

    o = table(spark, d, "orders")
    raw = F.concat(
        F.lit('Here:\n```json\n[{"subject": "order '), F.col("o_orderkey").cast("string"), F.lit('", "predicate": "'),
        F.when(F.col("o_orderstatus") == "F", "Located In").when(F.col("o_orderstatus") == "O", "treat").otherwise("unheard of"),
        F.lit('", "object": "'), "o_orderpriority", F.lit('", "confidence": 0}, {"subject": "", "predicate": "x", "object": "y"}]\n```'),
    )
    t = o.select(F.explode(G.parse_triples(raw)).alias("t"))
    pred = F.coalesce(G.fuzzy_key(F.col("t.predicate"), [r for r, _, _ in RELATIONS]), F.col("t.predicate"))
    conf = F.when(F.coalesce(F.col("t.confidence"), F.lit(0.0)) == 0, 0.9).otherwise(F.col("t.confidence"))
    return t.groupBy(pred.alias("predicate"), F.col("t.object").alias("object"), conf.alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


_CHAT_ROLE = r"(?i)^\s*(Human|User|Assistant|System)\s*:\s*(.*)$"


def _sql_lf(e: str) -> str:
    return f"replace(replace({e}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def _sql_chat(e: str) -> str:
    """P01 in SQL: a later user turn cuts the text, user lines go, role prefixes go."""
    turn, role = S.sql_str(r"(?i)(Human|User)\s*:\s*"), S.sql_str(_CHAT_ROLE)
    s = S.strip(_sql_lf(e))
    head = f"string_split_regex({s}, {turn})[1]"
    cut = f"case when regexp_matches({s}, {turn}) and length({head}) > 0 then rtrim({head}) else {s} end"
    line = f"case when lower(regexp_extract(l, {role}, 1)) in ('human', 'user') then null when regexp_extract(l, {role}, 1) <> '' then nullif({S.strip(f'regexp_extract(l, {role}, 2)')}, '') else rtrim(l) end"
    return S.strip(f"array_to_string(list_filter(list_transform(string_split({cut}, chr(10)), lambda l: {line}), lambda x: x is not null), chr(10))")


def _sql_collapse(e: str) -> str:
    tails = f"regexp_replace({_sql_lf(e)}, '[ \\t\\f\\v\\x{{a0}}\\x{{3000}}]+(\\n|$)', '\\1', 'g')"
    return S.strip(f"regexp_replace({tails}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


_PUNCT = f"(t = '' or (not regexp_matches(t, '[A-Za-z0-9{S.CJK}]') and length(t) >= 6 and not regexp_matches(t, '[\\p{{L}}\\p{{N}}]')))"
_INSTRUCT = (
    f"(t <> '' and ({_PUNCT} or regexp_matches(t, '^[【\\[][^】\\]]{{1,24}}[】\\]]$') or (regexp_matches(t, {S.sql_str(H.INSTRUCTION)}) and length(t) <= 200)"
    f" or (length(t) <= 220 and regexp_matches(t, {S.sql_str(H.RULE_LINE)}) and regexp_matches(t, {S.sql_str(H.RULE_WORDS)}))))"
)


@query(
    "chat_strip", "P01,P02,P03,P04",
    f"""with c as (select conv_id, turn, {_sql_chat("upper(role[1]) || lower(role[2:]) || ': ' || text")} as stripped, regexp_replace({_sql_chat('text')}, '(?s)```.*?```', '', 'g') as s from conversations),
    l as (select conv_id, turn, stripped, array_to_string(list_filter(list_transform(string_split({_sql_lf('s')}, chr(10)), lambda x: {S.strip('x')}), lambda t: t = '' or not ({_INSTRUCT} or {_PUNCT})), chr(10)) as t from c),
    p as (select conv_id, turn, stripped, list_filter(list_transform(string_split_regex({_sql_collapse('t')}, '\\n\\s*\\n+'), lambda x: {S.strip('x')}), lambda x: x <> '') as ps from l)
    select conv_id, turn, md5(stripped) as stripped_md5, len(list_filter(ps, lambda x: not (regexp_matches(x, {S.sql_str(H.BOILERPLATE)}) and length(x) <= 240)))::int as n_paragraphs from p""",
)
def chat_strip(spark, d):
    c = spread(table(spark, d, "conversations"), "conv_id")
    marked = F.concat(F.initcap("role"), F.lit(": "), "text")
    return c.select("conv_id", "turn", F.md5(H.strip_chat(marked)).alias("stripped_md5"), F.size(H.surviving_paragraphs(F.col("text"))).alias("n_paragraphs"))


@query("answer_hygiene", "P05,P06,P07,P09,P10,P11,P12")
def answer_hygiene(spark, d):
    c = spread(table(spark, d, "conversations"), "conv_id").where("role = 'assistant'")
    p = c.select("conv_id", "turn", "text", H.dedupe_paragraphs(H.surviving_paragraphs(F.col("text"))).alias("ps"))
    u = p.withColumn("units", H.answer_units(F.col("ps")))
    pol = H.evidence_policy(F.col("units"), F.col("text"), F.array().cast("array<string>"))
    return u.select(
        "conv_id", "turn", F.md5(H.finish_answer(F.col("ps"))).alias("clean_md5"), F.size("units").alias("n_units"), pol["failure_reason"].alias("failure_reason"),
        H.looks_like_bullets(F.col("text")).alias("bullets"), F.md5(H.concise_answer(F.col("text"))).alias("concise_md5"), F.md5(H.clean_prediction(F.col("text"))).alias("pred_md5"),
    )


_HEAD_LINE = r"^\s*Assistant\s*(?:[:：]\s*(.*))?\s*$"


@query(
    "section_format", "P08",
    f"""with c as (select conv_id, turn, role, {S.strip("upper(role[1]) || lower(role[2:]) || ': ' || text")} as s from conversations), l as (select *, string_split({_sql_lf('s')}, chr(10)) as ls from c),
    b as (select *, {S.strip(f"regexp_extract(ls[1], {S.sql_str(_HEAD_LINE)}, 1)")} as inl from l), d as (select *, {_sql_collapse("array_to_string(case when inl <> '' then list_concat([inl], ls[2:]) else ls[2:] end, chr(10))")} as body from b)
    select conv_id, turn, md5(case when role = 'assistant' and body <> '' then 'Assistant：' || chr(10) || body else s end) as section_md5 from d""",
)
def section_format(spark, d):
    c = table(spark, d, "conversations")
    text = F.concat(F.initcap("role"), F.lit(": "), "text")
    out = H.format_sections(text, {"answer": "Assistant", "question": "User"}, ["answer"])
    return c.select("conv_id", "turn", F.md5(out).alias("section_md5"))


@query(
    "budget_selection", "Q28",
    """with recursive c as (select l_orderkey as k, l_linenumber, l_quantity::int as q, row_number() over (partition by l_orderkey order by -l_extendedprice, l_linenumber) as i from lineitem),
    r as (select k, 0::bigint as i, 0 as used, 0 as cnt, null::int as item, null::int as cost from (select distinct k from c)
      union all select r.k, r.i + 1, case when ok then used + q2 else used end, case when ok then cnt + 1 else cnt end, case when ok then l_linenumber end, case when ok then q2 end
      from (select r.*, c.l_linenumber, least(40, q) as q2, used + least(40, q) <= 64 and cnt < 4 as ok from r join c on c.k = r.k and c.i = r.i + 1) r)
    select k as l_orderkey, row_number() over (partition by k order by i)::int - 1 as pos, item as l_linenumber, cost from r where item is not null""",
)
def budget_selection(spark, d):
    li = table(spark, d, "lineitem").withColumn("neg", -F.col("l_extendedprice"))
    return Fo.budgeted_selection(li, "l_orderkey", ["neg", "l_linenumber"], "l_linenumber", "l_quantity", 64, 40, 4)


@query("list_projection", "W07,T15")
def list_projection(spark, d):
    q = Ve.search(class_queries(spark, d), bank(spark, d), 12)
    docs = documents(spark, d).select(F.col("doc_id").alias("rid"), N.split_claims(F.col("text")).alias("items"))
    return Fo.list_projection(q.join(docs, "rid"), "qid", "rank", "rid", "items").select("qid", "pos", "block", F.md5("item").alias("item_md5"))


@query(
    "unused_retrieval", "J12,Q27",
    f"""with {MEANS}, t as {_ranked('scored', 24)}, u as (select qid, rid from t where rank <= 8)
    select qid, rid, row_number() over (partition by qid order by rank)::int as pick from t where not exists (select 1 from u where u.qid = t.qid and u.rid = t.rid) qualify pick <= 8""",
)
def unused_retrieval(spark, d):
    t = Ve.search(class_queries(spark, d), bank(spark, d), 24)
    return J.next_unused(t, t.where("rank <= 8"), 8).select("qid", "rid", "pick")


@query(
    "request_order_lookup", "J09",
    """select c_custkey as qid, pos::int as pos, x as n_nationkey, n_name from (select c_custkey, unnest([c_nationkey, (c_nationkey + 7) % 30, 3]) as x, unnest([0, 1, 2]) as pos from customer) join nation on n_nationkey = x""",
)
def request_order_lookup(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("qid"), F.array(F.col("c_nationkey"), (F.col("c_nationkey") + 7) % 30, F.lit(3)).alias("ids"))
    n = table(spark, d, "nation").withColumn("ord", F.col("n_nationkey")).select("n_nationkey", "n_name", "ord")
    return J.items_in_request_order(c, n, "n_nationkey", "ord").select("qid", "pos", "n_nationkey", "n_name")


@query(
    "last_wins_lookup", "J06,J07,J08",
    """with l as (select user_id, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value from events group by 1)
    select c_custkey as user_id, c_name, event_type, value from customer left join l on user_id = c_custkey""",
)
def last_wins_lookup(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return J.lookup(c, table(spark, d, "events"), "user_id", "event_id", "event_type", "value")


@query(
    "incremental_import", "J11,J23,ST2",
    """with o as (select *, 'k' || user_id || event_type as k from events), old as (select distinct k from o where ts < timestamp '2024-01-03')
    select min(event_id) as event_id, k from o where ts >= timestamp '2024-01-03' and k not in (select k from old) group by k""",
)
def incremental_import(spark, d):
    e = table(spark, d, "events").withColumn("k", F.concat(F.lit("k"), F.col("user_id").cast("string"), "event_type"))
    cut = F.lit("2024-01-03").cast("timestamp_ntz")
    return J.not_present(e.where(F.col("ts") >= cut).select("event_id", "k"), e.where(F.col("ts") < cut), "k", "event_id")


@query(
    "slot_evidence", "J14",
    """with ev as (select event_id as evidence_id, [event_type, case when value > 15 then 'High' else 'low' end] as types from events), s as (select * from (values ('a', ['CLICK ']), ('b', ['high', 'view']), ('c', [])) t(slot, wanted))
    select slot, count(*) as n from ev join s on len(wanted) = 0 or list_has_any(list_transform(types, lambda x: lower(x)), list_transform(wanted, lambda x: lower(trim(x)))) group by slot""",
)
def slot_evidence(spark, d):
    ev = table(spark, d, "events").select(F.col("event_id").alias("evidence_id"), F.array("event_type", F.when(F.col("value") > 15, "High").otherwise("low")).alias("types"))
    s = spark.createDataFrame([("a", ["CLICK "]), ("b", ["high", "view"]), ("c", [])], "slot string, wanted array<string>")
    return J.evidence_for_slots(ev, s).groupBy("slot").agg(F.count(F.lit(1)).alias("n"))


@query(
    "doc_listing", "J21,W08",
    """select source, count(*) as n_docs, sum(coalesce(quality, 0))::bigint as approved, arg_min(doc_id, doc_id) as first_doc from documents left join labels using (doc_id) group by source""",
)
def doc_listing(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    return docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.coalesce("quality", F.lit(0))).alias("approved"), F.min_by("doc_id", "doc_id").alias("first_doc")
    )


@query(
    "supporting_sentences", "J22",
    f"""select conv_id, turn, md5(unnest(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda p: {S.strip('p')}), lambda p: p <> '')))) as s_md5 from conversations""",
)
def supporting_sentences(spark, d):
    """Every line of a turn is pointed at by its index; one index lies before the first."""
    def all_lines(lines):
        n = F.size(lines)
        return J.supporting_sentences(F.array_repeat("role", n + 1), F.sequence(F.lit(-1), n - 1), F.array("role"), F.array(lines))

    c = explode_rows(table(spark, d, "conversations"), ["conv_id", "turn"], T.bind(F.split("text", "\n"), all_lines), "s")
    return c.select("conv_id", "turn", F.md5("s").alias("s_md5"))


@query(
    "evidence_merge", "U03,U08",
    f"""with g as (select conv_id as qid, turn as pos, {S.strip('text')} as t, 0 as src from conversations where role = 'assistant'), x as (select conv_id as qid, turn as pos, {S.strip('text')} as t, 1 as src from conversations where role = 'user'),
    u as (select * from g union all select * from x)
    select qid, count(distinct t) as n, count(distinct t) filter (regexp_matches(t, '(?i)https?://\\S+')) as with_url from u where t <> '' group by qid""",
)
def evidence_merge(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("pos"), "text", "role")
    m = J.merge_evidence(c.where("role = 'assistant'"), c.where("role = 'user'"))
    return m.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.sum(J.has_url(F.col("text")).cast("int")).alias("with_url"))


@query(
    "bridge_triples", "G16",
    """with t as (select conv_id, turn, role || ' ' || turn as title, lead(role || ' ' || turn) over (partition by conv_id order by turn) as nxt from conversations)
    select 'tri_bridge_' || conv_id || '_' || turn as triple_id, title as subject, 'bridge_to' as predicate, nxt as object from t where nxt is not null""",
)
def bridge_triples(spark, d):
    """Consecutive titles of a question, linked by an equi-join on the next position."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(" ", "role", F.col("turn").cast("string")).alias("title"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("title").alias("object"))
    return c.join(nxt, ["conv_id", "turn"]).select(
        F.concat_ws("_", F.lit("tri_bridge"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("triple_id"), F.col("title").alias("subject"),
        F.lit("bridge_to").alias("predicate"), "object",
    )


@query(
    "step_deltas", "W12,W13",
    """with w as (select event_id, user_id, value, lag(value) over p as prev, lag(value, 2) over p as prev2 from events window p as (partition by user_id order by event_id))
    select event_id, round(value - prev, 6) as delta, coalesce(value < prev and prev < prev2, false) as falling from w""",
)
def step_deltas(spark, d):
    from ..operators.windows import step_deltas as steps

    return steps(table(spark, d, "events"), "user_id", "event_id", "value").select("event_id", F.round("delta", 6).alias("delta"), "falling")


@query(
    "contract_autogen", "A06",
    """with t as (select doc_id, {strip} as w from (select doc_id, unnest(string_split(lower(text), ' ')) as w from documents) where {strip} <> '')
    select 'schema:' || w as pattern_id, count(*) as n from t group by w having count(*) >= 3 order by n desc, min(doc_id), w limit 20""".replace("{strip}", S.strip("w")),
)
def contract_autogen(spark, d):
    w = documents(spark, d).select("doc_id", F.explode(F.split(F.lower("text"), " ")).alias("w"))
    w = w.select("doc_id", T.strip(F.col("w")).alias("w")).where("w <> ''")
    return A.contract_candidates(w.select("doc_id", "w"), "w", 3, ["doc_id", "w"], 20, "schema:")


@query("value_slots", "X18,A17,Q08")
def value_slots(spark, d):
    """Cleaned values per document source decide the location slot."""
    rows = documents(spark, d, "text", "source").select(F.col("source").alias("qid"), V.clean_values(X.entity_candidates(F.col("text")), "location").alias("r"))
    items = rows.select(
        "qid", F.lit("geographic_distribution").alias("slot"), F.lit("schema").alias("level"), F.lit(1).alias("min_evidence"), F.size("r.cleaned_values").alias("n_cleaned"),
        F.size("r.removed_values").alias("n_removed"),
    )
    return G.slot_status(items)
