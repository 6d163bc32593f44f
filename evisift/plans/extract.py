"""Extraction queries over documents, benchmark texts and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import noise, sentences as N, slots as L, text as T
from ..functions.rows import explode_rows
from ..functions.text import bind
from ..operators import extract as X
from ..operators import values as V
from ..registry import query
from ..sources.tables import documents, table
from . import sqlparts as S

_A = r"([.!?\x{3002}\x{ff01}\x{ff1f}])\s*|\n+"
_C = r"([.!?\x{3002}\x{ff01}\x{ff1f}])\s+|\n+"
_E = r"([\x{3002}\x{ff01}\x{ff1f}.!?])"
_F = r"([.!?])\s+"
_G = r"([.!?\x{3002}\x{ff01}\x{ff1f}])\s+"
_B = r"([.!?\x{3002}\x{ff01}\x{ff1f};\x{ff1b}])\s+"


def split_sql(e: str, rx: str, extra: str = "") -> str:
    marked = f"regexp_replace({e}, '{rx}', '\\1' || chr(30), 'g')"
    return f"list_filter(list_transform(string_split_regex({marked}, '[\x1e{extra}]'), lambda p: {S.strip('p')}), lambda p: p <> '')"


SPLIT_A = split_sql("text", _A)
SPLIT_D = f"list_filter(list_transform(string_split_regex(text, '[\\x{{3002}}\\x{{ff01}}\\x{{ff1f}}\\n]+'), lambda p: {S.strip('p')}), lambda p: p <> '')"


@query(
    "sentence_counts", "C26,T05",
    f"""select doc_id, len({SPLIT_A})::int as n_a, len({split_sql(S.squash('text'), _B)})::int as n_b, len({split_sql('text', _C)})::int as n_c, len({SPLIT_D})::int as n_d,
    len({split_sql('text', _E, chr(92) + 'n')})::int as n_e, len({split_sql('text', _F)})::int as n_f, len({split_sql('text', _G)})::int as n_g,
    md5(array_to_string({SPLIT_A}, '|')) as md5_a, md5(array_to_string({split_sql('text', _C)}, '|')) as md5_c from documents""",
)
def sentence_counts(spark, d):
    c = F.col("text")
    fns = {"a": N.split_units, "b": N.split_ws_semicolon, "c": N.split_claims, "d": N.split_cjk_stops, "e": N.split_keep_stop, "f": N.split_ascii, "g": N.split_ws}
    return documents(spark, d).select(
        "doc_id", *[F.size(f(c)).alias(f"n_{k}") for k, f in fns.items()],
        F.md5(F.array_join(N.split_units(c), "|")).alias("md5_a"), F.md5(F.array_join(N.split_claims(c), "|")).alias("md5_c"),
    )


@query(
    "sentences", "C27,K10",
    f"""select doc_id, doc_id || '#s' || (i - 1) as sentence_id, ss[i] as text from (select doc_id, ss, unnest(range(1, len(ss) + 1)) as i from (select doc_id, {SPLIT_A} as ss from documents))""",
)
def sentences(spark, d):
    s = explode_rows(documents(spark, d), ["doc_id"], N.split_units(F.col("text")), "i", "s").withColumnRenamed("s", "text")
    return s.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("#s"), F.col("i").cast("string")).alias("sentence_id"), "text")


@query("sentence_offsets", "C27")
def sentence_offsets(spark, d):
    return X.sentence_table(documents(spark, d), "doc_id", "text").select("sentence_id", "offset", F.length("text").alias("n"))


def _re_word(rx: str) -> str:
    """Unicode word boundaries for RE2: consume one non-word character on either side."""
    return f"(^|[^{S.WORD}])({rx})($|[^{S.WORD}])"


_NOISE = rf"""(s = '' or regexp_matches(s, '{noise.REF_HEADER}') or regexp_matches(s, '(?i)\b10\.\d{{4,9}}/\S+') or regexp_matches(s, '\b[A-Z][A-Za-z\-'']+\s+et al\.?,?\s*\(?\d{{4}}\)?')
  or regexp_matches(s, '{_re_word("(?i:vol.?|issue|pages?|doi|journal|proceedings|copyright)").replace("vol.?", "vol[.]?")}') or len(regexp_extract_all(s, '\(\d{{4}}\)')) >= 3
  or (length(s) - length(replace(replace(s, ',', ''), '，', '')) >= 6 and length(s) < 280))"""


@query(
    "noise_sentences", "C20,C21,C22",
    f"""select doc_id, count(*) as n, sum({_NOISE}::int)::bigint as noisy,
    sum((s = '' or regexp_matches(s, '(?i)\\b10\\.\\d{{4,9}}/\\S+') or regexp_matches(s, '\\b[A-Z][A-Za-z\\-'']+\\s+et al\\.?,?\\s*\\(?\\d{{4}}\\)?') or len(regexp_extract_all(s, '\\(\\d{{4}}\\)')) >= 3)::int)::bigint as light,
    sum((s = '' or regexp_matches(s, '{noise.REF_HEADER}') or length(s) < 40 or len(regexp_extract_all(s, '\\(\\d{{4}}\\)')) >= 6)::int)::bigint as low_para
    from (select doc_id, unnest({SPLIT_A}) as s from documents) group by doc_id""",
)
def noise_sentences(spark, d):
    s = explode_rows(documents(spark, d), ["doc_id"], N.split_units(F.col("text")), "s")
    one = lambda c, n: F.sum(c.cast("int")).alias(n)
    c = F.col("s")
    return s.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), one(noise.is_low_value_sentence(c), "noisy"), one(noise.is_sentence_noise(c), "light"),
        one(noise.is_low_value_paragraph(c), "low_para"),
    )


_HEADS = ["Abstract", "Methods", "Results", "Discussion", "No heading at all"]
_LINES = "list_filter(string_split(text, chr(10)), lambda l: {strip} <> '')".replace("{strip}", S.strip("l"))


@query(
    "section_of_paragraphs", "C23,C24,J19,W10",
    f"""with l as (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from (select doc_id, {_LINES} as ls from documents)),
    p as (select doc_id, {S.strip('ls[i]')} as p, (i - 1) // 3 as g from l), h as (select *, case when g % 5 = 4 then g - 1 else g end as hg from p)
    select lower((['Abstract', 'Methods', 'Results', 'Discussion'])[hg % 5 + 1]) as section, count(*) as n from h where length(p) >= 30 and hg >= 0 group by 1""",
)
def section_of_paragraphs(spark, d):
    """Lines of documents as paragraphs; every third gets the next of five heading lines in front, one of which is none."""
    from ..operators.sections import paragraph_sections

    heads = F.array(*[F.lit(h) for h in _HEADS])
    lines = F.filter(F.split("text", "\n"), lambda l: T.strip(l) != "")
    marked = F.transform(lines, lambda l, i: F.concat(F.when(i % 3 == 0, F.concat(F.lit("\n\n"), F.get(heads, (F.floor(i / 3) % 5).cast("int")))).otherwise(""), F.lit("\n\n"), l))
    docs = documents(spark, d).select("doc_id", F.array_join(marked, "").alias("text"))
    out = paragraph_sections(docs, "doc_id", "text")
    return out.groupBy("section").agg(F.count(F.lit(1)).alias("n"))


@query("abstract_seeds", "C25,S26")
def abstract_seeds(spark, d):
    return documents(spark, d).select("doc_id", noise.seeds(F.col("text")).alias("s")).select("doc_id", "s.window", "s.seed", "s.abstract_seed")


_W = f"[^{S.WORD}]"
_TITLE_NOISE = (
    f"(?i)^(\\s*\\d+\\s*$|(.*{_W})?(vol\\.?|issue|pages?|proceedings)({_W}.*)?$|(.*{_W})?(received|accepted|published|copyright)({_W}.*)?$"
    "|.*@.*\\.(com|edu|org|cn)|\\s*https?://\\S+\\s*$)"
)


@query(
    "doc_meta_heuristics", "C28",
    f"""with l as (select doc_id, source, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: {S.strip('x')}),
      lambda x: length(x) between 10 and 300 and not regexp_matches(x, '(^|{_W})10\\.\\d{{4,9}}/') and not regexp_matches(x, '{_TITLE_NOISE}')) as ts from documents)
    select doc_id, coalesce(ts[1], 'doc') as title, nullif(regexp_extract(text, '(?:^|{_W})(10\\.\\d{{4,9}}/[-._;()/:A-Za-z0-9]*[A-Za-z0-9_])', 1), '') as doi,
     nullif(regexp_extract(substr(text, 1, 4000), '(?:^|{_W})(19\\d{{2}}|20\\d{{2}})(?:{_W}|$)', 1), '')::int as publication_year from l""".replace("\\\\", "\\"),
)
def doc_meta_heuristics(spark, d):
    m = noise.doc_meta(F.col("text"), F.concat(F.col("source"), F.lit("/doc.pdf")), F.col("doc_id"))
    return documents(spark, d, "text", "source").select("doc_id", m.alias("m")).select("doc_id", "m.*")


_TOKENS = f"regexp_extract_all({S.squash('text')}, '[{S.WORD}]+|[^{S.WORD}]+')"


@query(
    "entity_topk", "X02,A05",
    f"""with t as (select doc_id, unnest(toks) as tok, generate_subscripts(toks, 1) as i from (select doc_id, {_TOKENS} as toks from documents)),
    l as (select *, lag(tok) over w as sep, regexp_full_match(tok, '[A-Z][a-z]{{2,}}') as title, coalesce(regexp_full_match(lag(tok, 2) over w, '[A-Z][a-z]{{2,}}'), false) as before from t window w as (partition by doc_id order by i)),
    c as (select *, sum((not (before and sep in (' ', '-')))::int) over (partition by doc_id order by i) as chain from l where title),
    n as (select *, row_number() over (partition by doc_id, chain order by i) as k from c),
    p as (select doc_id, min(i) as i, string_agg(case when (k - 1) % 6 = 0 then tok else sep || tok end, '' order by i) as entity from n group by doc_id, chain, (k - 1) // 6),
    f as (select doc_id, entity, i from p where length(entity) between 3 and 80 qualify row_number() over (partition by doc_id, lower(entity) order by i) = 1),
    e as (select *, row_number() over (partition by doc_id order by i) - 1 as pos from f),
    g as (select substring(entity, 1, 1) as grp, entity, count(*) as n, min([doc_id, pos]) as first from e group by 1, 2)
    select grp, entity, n, row_number() over (partition by grp order by n desc, first, entity)::int as rank from g qualify rank <= 8""",
)
def entity_topk(spark, d):
    from ..operators.aggregate import top_values

    e = explode_rows(documents(spark, d), ["doc_id"], X.entity_candidates(F.col("text")), "pos", "entity")
    ranked = top_values(e.withColumn("grp", F.substring("entity", 1, 1)), "grp", "entity", ["doc_id", "pos"], 8)
    return ranked.select("grp", "entity", "n", "rank")


def _pairs_sql(rx: str, full: int, conf: float) -> str:
    abbr, long = (f"regexp_extract_all(t, {S.sql_str(rx)}, {g})" for g in (3 - full, full))
    return f"list_transform(list_zip({abbr}, {long}), lambda z: {{'a': upper({S.squash('z[1]')}), 'f': {S.squash('z[2]')}, 'c': {conf}}})"


@query(
    "abbr_topk", "X01,A05",
    f"""with x as (select doc_id as id, {S.squash('text')} as t from documents union all select p_partkey, {S.squash("'The ' || p_name || ' (' || upper(replace(p_brand, '#', '')) || ')'")} from part),
    p as (select id, list_filter(list_concat({_pairs_sql(X.ABBR_EN, 1, 0.95)}, {_pairs_sql(X.ABBR_ZH, 1, 0.9)}, list_filter({_pairs_sql(X.ABBR_REV, 2, 0.55)}, lambda y: length(y.f) <= 60 and regexp_matches(y.f, '[A-Za-z{S.CJK}]'))),
      lambda y: length(y.a) between 2 and 12 and length(y.f) between 2 and 120 and upper(y.f) <> y.a) as ps from x),
    u as (select id, row_number() over () as r, ps from p), e as (select id, r, unnest(ps) as y, generate_subscripts(ps, 1) as i from u),
    f as (select id, r, y.a as abbr, y.f as "full", y.c as c, i from e qualify row_number() over (partition by r, y.a, y.f order by i) = 1),
    q as (select *, row_number() over (partition by r order by i) - 1 as pos from f),
    g as (select abbr, "full", count(*) as n, min([id, pos]) as first from q where c >= 0.6 group by 1, 2)
    select abbr, "full", n, row_number() over (partition by abbr order by n desc, first, "full")::int as rank from g qualify rank <= 8""",
)
def abbr_topk(spark, d):
    from ..operators.aggregate import top_values

    # Parts named in parentheses after a phrase stand in for expansions next to the prose.
    docs = documents(spark, d).select(F.col("doc_id").alias("id"), "text")
    parts = table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("The "), "p_name", F.lit(" ("), F.upper(F.regexp_replace("p_brand", "#", "")), F.lit(")")).alias("text")
    )
    p = explode_rows(docs.unionByName(parts), ["id"], X.abbreviation_pairs(F.col("text")), "pos", "p")
    p = p.select("id", "pos", "p.*").where(F.col("confidence") >= 0.6)
    return top_values(p, "abbr", "full", ["id", "pos"], 8).select("abbr", "full", "n", "rank")


_SLOT_SQL = " ".join(
    f"case when regexp_matches(q, '(?i){rx}') then '{slot}' end," for slot, rx in L.FALLBACK_SLOTS
)
_QUEST_SQL = " ".join(f"case when regexp_matches(q, '(?i){rx}') then '{slot}' end," for rx, slot in L.QUESTION_SLOTS)


@query(
    "slot_inference", "X03,X04,X05,Q12",
    f"""with s as (select doc_id, list_sort(list_distinct(list_filter([{_QUEST_SQL} {_SLOT_SQL} null], lambda x: x is not null))) as sl, q from (select doc_id, {S.strip('text')} as q from documents)),
    c as (select doc_id, q, list_sort(list_distinct(list_concat(sl, list_filter([{", ".join(f"nullif(regexp_replace(regexp_replace(lower(regexp_extract(q, '(?i)(?:^|[^{S.WORD}])({rx})(?:$|[^{S.WORD}])', 1)), '{chr(92)}s+', '_', 'g'), '[^a-z0-9_{S.CJK}]', '', 'g'), '')" for rx in L.CONCEPT_SLOTS)}], lambda x: x is not null)))) as sl from s)
    select doc_id, array_to_string(sl, ',') as slots,
     array_to_string(list_filter([{", ".join(f"'{x}'" for x in L.SLOT_REGISTRY)}], lambda x: list_contains(sl, x)), ',') as registered,
     case when list_contains(sl,'treatment') then 'treatment' when list_contains(sl,'diagnosis') then 'diagnosis' when list_contains(sl,'transmission') then 'transmission'
      when list_contains(sl,'pathogenesis') then 'pathogenesis' when list_contains(sl,'clinical_features') then 'clinical_features' when list_contains(sl,'prevention') then 'prevention' else 'general' end as block_type,
     not regexp_matches(lower(q), '(?i){L.FACT_TYPES[1][1]}') as domain_prior from c""",
)
def slot_inference(spark, d):
    c = F.col("text")
    both = T.bind(L.infer_slots(c), lambda s: F.struct(s.alias("s"), L.registered(s).alias("r")))
    out = T.bind(
        both,
        lambda b: F.struct(
            F.array_join(b["s"], ",").alias("slots"), F.array_join(b["r"], ",").alias("registered"), L.block_type(b["r"], F.lit(False)).alias("block_type")
        ),
    )
    return documents(spark, d).select("doc_id", out.alias("o"), L.fact_policy(c)["domain_prior"].alias("domain_prior")).select("doc_id", "o.*", "domain_prior")


@query("list_features", "X06,X07,X08,X13,X23,S18")
def list_features(spark, d):
    c = F.col("text")
    # Lower-casing long texts is the dearest step: once for all that ask for it.
    docs = documents(spark, d).select("doc_id", "text", F.lower(c).alias("low"))
    rows = docs.select("doc_id", "text", "low", L.registry_slots(c, F.col("low")).alias("slots"), X.list_like_features(c, low=F.col("low")).alias("like"))
    out = X.list_features(rows, "text", "slots", low="low")
    return out.select(
        "doc_id", X.list_bank_meta(F.col("lf"), F.col("like"), F.col("slots")).alias("m"), F.size(X.bullet_items(c)).alias("n_bullets"),
        F.round("like.list_density", 6).alias("density"),
    ).select(
        "doc_id", "m.list_like", "m.list_feature_count", "m.list_confidence", F.array_join("m.list_signals", ",").alias("signals"), "m.list_type",
        "n_bullets", "density",
    )


def unit_rows(spark, d):
    c = F.col("text")
    rows = documents(spark, d).select("doc_id", "text", X.list_like_items(c).alias("items"))
    sec = X.section_type(c, F.lit(""), T.is_table_text(c))
    return rows.select("doc_id", X.evidence_units(F.col("doc_id").cast("string"), c, sec, F.col("items")).alias("units"))


@query("evidence_units", "X09,X10,X11,X12,K10")
def evidence_units(spark, d):
    u = explode_rows(unit_rows(spark, d), ["doc_id"], F.col("units"), "unit_no", "u")
    return u.select(
        "doc_id", "unit_no", "u.sentence_id", "u.unit_type", "u.semantic_role", "u.confidence", F.md5("u.text").alias("text_md5"),
        F.array_join("u.reasons", ",").alias("reasons"), X.injectable(F.col("u")).alias("allowed"),
    )


@query("simple_facts", "X25")
def simple_facts(spark, d):
    return unit_rows(spark, d).select("doc_id", F.size(X.simple_facts(F.col("units"))).alias("n_facts"))


@query("sidecar_facts", "X14")
def sidecar_facts(spark, d):
    c = F.col("text")
    rows = documents(spark, d, "text", "lang", "source").select(
        "doc_id", "text", X.abbreviation_pairs(c).alias("pairs"), F.get(X.entity_candidates(c), 0).alias("primary"),
        F.array(F.struct(F.lit("lang").alias("slot"), F.col("lang").alias("value")), F.struct(F.lit("source").alias("slot"), F.col("source").alias("value"))).alias("fills"),
    )
    facts = X.sidecar_facts(F.col("doc_id"), F.col("pairs"), F.col("primary"), F.lit(False), c, F.col("fills"))
    return explode_rows(rows, ["doc_id"], facts, "f").select("doc_id", "f.*")


_NOTES = ", ".join(f"min(doc_id) filter (regexp_matches(lower(text), '{rx.replace(X.BOUND_L, '').replace(X.BOUND_R, '')}')) as n{i}" for i, (_, rx, _) in enumerate(X.SCHEMA_NOTES) if "ifn" not in rx)


def _field_sql(field: str) -> str:
    cells = ", ".join(
        f"case when n{i} is not null then {{'o': n{i}, 'i': {i}, 't': {S.sql_str(note)}}} end" for i, (f, _, note) in enumerate(X.SCHEMA_NOTES) if f == field
    )
    return f"array_to_string(list_transform(list_sort(list_filter([{cells}], lambda x: x is not null)), lambda x: x.t), '; ')"


_IFN = f"min(doc_id) filter (regexp_matches(lower(text), 'interferon|干扰素|(^|[^{S.WORD}])ifn($|[^{S.WORD}])')) as n6"


@query(
    "schema_blocks", "A07,X15,X16",
    f"""select source, {_field_sql('transmission_primary')} as transmission_primary, {_field_sql('transmission_secondary')} as transmission_secondary, {_field_sql('pathogenesis_notes')} as pathogenesis_notes
    from (select source, {_NOTES}, {_IFN} from documents group by source)""",
)
def schema_blocks(spark, d):
    s = X.schema_blocks(documents(spark, d, "text", "source"), "source", "text", "doc_id")
    return s.select("source", *[F.array_join(f, "; ").alias(f) for f in X.SCHEMA_FIELDS])


def _shown_sql(field: str) -> str:
    cells = _field_sql(field).removeprefix("array_to_string(").removesuffix(", '; ')")
    return f"'- {field}: ' || coalesce(nullif(array_to_string(({cells})[1:3], '; '), ''), 'N/A') || chr(10)"


@query(
    "schema_texts", "X16",
    f"""select source, 'Confirmed evidence slots (do NOT treat as a full answer; do NOT invent new facts):' || chr(10) || {" || ".join(_shown_sql(f) for f in X.SCHEMA_FIELDS)} as text
    from (select source, {_NOTES}, {_IFN} from documents group by source)""",
)
def schema_texts(spark, d):
    s = X.schema_blocks(documents(spark, d, "text", "source"), "source", "text", "doc_id")
    return s.select("source", X.schema_text().alias("text"))


@query("value_cleaning", "X18,X19,T18,T19")
def value_cleaning(spark, d):
    vals = X.entity_candidates(F.col("text"))
    rows = documents(spark, d).select("doc_id", vals.alias("v"))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.array("p_name", "p_type").alias("v"))
    return V.cleaned_counts(rows.unionByName(parts), "v", ("location", "symptom", "drug", "generic"))


@query("quote_validation", "X22")
def quote_validation(spark, d):
    # Not a filter on the computed counts: that would be pushed below the spread and computed there a second time.
    counts = X.quote_counts(F.col("text"), N.split_ws(F.col("text")))
    some = bind(counts, lambda r: F.array(F.when(r["n"] > 0, r)))
    return explode_rows(documents(spark, d), ["doc_id"], some, "r").select("doc_id", "r.valid", "r.n")


# The invented documents hold no prose about patients: one wording for each verdict, chosen by id, stands before the whole text.
_SYMPTOM_TEXTS = [
    "Symptoms include fever, rash and bleeding.", "See table 3. Symptoms include fever, rash.", "Nothing listed.", "The drug presents with alpha, beta.",
    "Symptoms include alpha, beta.", "Patients present with fatigue; vomiting.",
]
_SPLIT_F = split_sql("text", _F)


def _sql_any(e: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains(lower({e}), '{w}')" for w in words) + ")"


def _sql_symptom_items(parts: str) -> str:
    cue = f"{_sql_any('x', X.SYMPTOM_CUES + X.SYMPTOM_TERMS)} or regexp_matches(lower(x), {S.sql_str(X.PATIENT_PATTERNS)})"
    return f"list_filter(list_transform({parts}, lambda x: {S.strip('x')}), lambda x: x <> '' and ({cue}))"


def _sql_conjunctions(e: str, to: str) -> str:
    """Whole words and / or become ``to``; twice, as two of them may share a blank."""
    for _ in range(2):
        e = f"regexp_replace({e}, '(?i)(^|[^{S.WORD}])(?:and|or)([^{S.WORD}]|$)', '\\1{to}\\2', 'g')"
    return e


_FRAGMENTS = "list_concat(" + ", ".join(f"regexp_extract_all(text, {S.sql_str(rx)}, 2)" for rx in X.LIST_CUES) + ")"
_LISTED = f"flatten(list_transform({_FRAGMENTS}, lambda f: string_split_regex({_sql_conjunctions(S.squash('f'), ',')}, '[，,、;；]+')))"
_LISTED = f"list_distinct(list_filter(list_transform({_LISTED}, lambda x: {S.squash('x')}), lambda x: length(x) between 2 and 64))"
_LEAD_WORDS = "with|including|include|present with|characterized by"
_LEAD = S.strip(f"regexp_replace({S.strip('s')}, '(?i)^(?:.*?[^{S.WORD}\\n])??(?:{_LEAD_WORDS})([^{S.WORD}]|$)', '\\1')")
_TAIL = f"list_filter(list_transform(list_filter(string_split_regex({_sql_conjunctions(_LEAD, ',')}, '[;,]'), lambda x: {S.strip('x')} <> ''), lambda x: trim(x, ' .;:,')), lambda x: length(x) between 2 and 60)"
_WINDOW = "array_to_string(ss[greatest(i - 1, 1):i + 1], ' ')"


@query(
    "symptom_lists", "X20,X21,W09",
    f"""with d as (select doc_id, {_SYMPTOM_TEXTS}[doc_id % 6 + 1] || ' ' || text as text from documents),
    p as (select doc_id, lower(text) as low, {_SPLIT_F} as ss, {_LISTED} as listed from d),
    w as (select doc_id, low, listed, len(ss) as n_sentences, list_distinct({_sql_symptom_items('listed')}) as kept,
      list_bool_or(list_transform(range(1, len(ss) + 1), lambda i: {_sql_any(_WINDOW, X.SYMPTOM_CUES)} or regexp_matches(lower({_WINDOW}), {S.sql_str(X.PATIENT_PATTERNS)}))) as cue,
      list_sum(list_transform(ss, lambda s: len(list_distinct({_sql_symptom_items(_TAIL)})))) as tail from p),
    r as (select *, case {" ".join(f"when contains(low, '{e}') then 'excluded:{e}'" for e in X.EXCLUDED)} when len(listed) = 0 then 'missing_structure'
      when not cue then 'missing_symptom_cue' when len(kept) = 0 then 'list_items_not_symptom' else 'ok' end as reason from w)
    select reason, count(*) as n, sum(n_sentences)::bigint as n_sentences, sum(case when reason = 'ok' then len(kept) else 0 end)::bigint as n_items,
      array_to_string(list_sort(list_distinct(flatten(list(case when reason = 'ok' then kept else [] end)))), ',') as items, sum(tail)::bigint as tail_items from r group by reason""",
)
def symptom_lists(spark, d):
    """Verdict and listed symptoms of every whole text; enumerations of each of its sentences."""
    texts = F.array(*[F.lit(t) for t in _SYMPTOM_TEXTS])
    docs = documents(spark, d).select("doc_id", F.concat_ws(" ", F.get(texts, (F.col("doc_id") % 6).cast("int")), "text").alias("text"))
    r = X.symptom_table(docs, "doc_id", "text").select("reason", "n_sentences", F.size("tail").alias("tail"), F.posexplode_outer("items").alias("i", "item"))
    # One partial count for each reason and item, not a list of a whole reason's items; a text counts at its first item (or none).
    head = lambda v: F.sum(F.when(F.coalesce("i", F.lit(0)) == 0, v).otherwise(0))
    per = r.groupBy("reason", "item").agg(head(F.lit(1)).alias("n"), head(F.col("n_sentences")).alias("n_sentences"), F.count("item").alias("n_items"), head(F.col("tail")).alias("tail_items"))
    items = F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items")
    return per.groupBy("reason").agg(*[F.sum(c).alias(c) for c in ("n", "n_sentences", "n_items", "tail_items")], items)


_CLAIMS = split_sql("t", r"([.!?\x{3002}\x{ff01}\x{ff1f}])\s+|\n+")


@query(
    "claim_chunks", "C29,C30,W07",
    f"""with recursive d as (select doc_id, {S.strip('text')} as t from documents), p as (select doc_id, t, {_CLAIMS} as ps from d),
    f as (select doc_id, t, flatten(list_transform(case when len(ps) <= 1 then [t] else ps end, lambda x: case when length(x) // 2 <= 64 then [x] else case when len({split_sql("x", "([,，;；、])\\s*")}) > 0 then {split_sql("x", "([,，;；、])\\s*")} else [x] end end)) as segs from p),
    r as (select doc_id, t, segs, 0::bigint as i, '' as buf, []::varchar[] as o from f where length(t) // 2 > 64
      union all select doc_id, t, segs, i + 1, case when buf = '' then segs[i + 1] when length({S.strip("buf || ' ' || segs[i + 1]")}) // 2 <= 64 then {S.strip("buf || ' ' || segs[i + 1]")} else segs[i + 1] end,
        case when buf = '' or length({S.strip("buf || ' ' || segs[i + 1]")}) // 2 <= 64 then o else list_append(o, buf) end from r where i < len(segs)),
    e as (select doc_id, case when buf <> '' then list_append(o, buf) else o end as c, true as s from r where i = len(segs) union all select doc_id, case when t = '' then [] else [t] end, false from d where length(t) // 2 <= 64)
    select doc_id, len(c)::int as n_chunks, s as was_split, s and len(c) = 1 and length(c[1]) // 2 > 64 as was_truncated, md5(array_to_string(c, '|')) as chunks_md5 from e""",
)
def claim_chunks(spark, d):
    from ..operators.folds import split_claim_to_budget

    r = documents(spark, d).select("doc_id", split_claim_to_budget(F.col("text"), 64).alias("r"))
    return r.select("doc_id", F.size("r.chunks").alias("n_chunks"), "r.was_split", "r.was_truncated", F.md5(F.array_join("r.chunks", "|")).alias("chunks_md5"))
