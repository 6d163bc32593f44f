"""Evaluation, audit and statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sentences as N, text as T
from ..functions.rows import explode_rows
from ..operators import aggregate as A, evalmetrics as E, joins as J, retrieval as R
from ..registry import query
from ..session import cut_lineage, spread
from ..sources.tables import documents, table
from . import sqlparts as S
from .extract import SPLIT_D

PUNCT_SQL = S.sql_str(E.PUNCTUATION)
SQUAD = lambda e: S.squash(f"translate(lower({e}), {PUNCT_SQL}, '')")
STRICT = lambda e: S.strip(f"regexp_replace(lower({S.strip(e)}), '[^{S.WORD}]+', ' ', 'g')")

TURNS = """turns as (select a.conv_id, a.turn, a.text as pred, u.text as gold from conversations a join conversations u on u.conv_id = a.conv_id and u.turn = a.turn - 1 where a.role = 'assistant' and u.role = 'user')"""


def turns(spark, d):
    """Assistant turns as predictions, the user turn before as the gold."""
    c = spread(table(spark, d, "conversations"), "conv_id")
    a = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("pred"))
    u = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("gold"))
    return a.join(u, ["conv_id", "turn"])


@query(
    "answer_metrics", "E01,E02,E03,E04,E07",
    f"""with {TURNS}, n as (select *, {STRICT('pred')} as sp, {STRICT('gold')} as sg, {SQUAD('pred')} as qp, {SQUAD('gold')} as qg from turns),
    tp as (select conv_id, turn, t, count(*) as c from (select conv_id, turn, unnest(list_filter(string_split(qp, ' '), lambda x: x <> '')) as t from n) group by all),
    tg as (select conv_id, turn, t, count(*) as c from (select conv_id, turn, unnest(list_filter(string_split(qg, ' '), lambda x: x <> '')) as t from n) group by all),
    o as (select conv_id, turn, sum(least(tp.c, tg.c)) as o from tp join tg using (conv_id, turn, t) group by all),
    sz as (select conv_id, turn, len(list_filter(string_split(qp, ' '), lambda x: x <> '')) as np, len(list_filter(string_split(qg, ' '), lambda x: x <> '')) as ng from n)
    select n.conv_id, n.turn, (sp = sg)::int as em, (qg <> '' and contains(qp, qg))::int as relaxed, coalesce(round(2 * o / (np + ng), 6), 0)::double as f1, md5(sp) as strict_md5, md5(qp) as squad_md5
    from n join sz using (conv_id, turn) left join o using (conv_id, turn)""",
)
def answer_metrics(spark, d):
    t = turns(spark, d)
    p, g = F.col("pred"), F.col("gold")
    return t.select(
        "conv_id", "turn", E.exact_match(p, F.array(g)).alias("em"), E.relaxed_match(p, g).alias("relaxed"),
        F.round(E.token_f1(p, g), 6).alias("f1"), F.md5(E.normalize_strict(p)).alias("strict_md5"), F.md5(E.normalize_squad(p)).alias("squad_md5"),
    )


@query(
    "label_parse", "E05",
    """select label, count(*) as n from (select case least(s, r, m) when 999 then null when s then 'SUPPORTS' when r then 'REFUTES' else 'NOT ENOUGH INFO' end as label from (
      select case when contains(t, 'SUPPORTS') then position('SUPPORTS' in t) else 999 end as s, case when contains(t, 'REFUTES') then position('REFUTES' in t) else 999 end as r,
       case when contains(t, 'NOT ENOUGH INFO') then position('NOT ENOUGH INFO' in t) else 999 end as m from (
       select upper('The order ' || o_orderkey || case o_orderstatus when 'F' then ' refutes, then supports ' when 'O' then ' Supports ' when 'P' then ' has not enough info ' else ' says nothing ' end || o_orderpriority) as t from orders))) group by label""",
)
def label_parse(spark, d):
    o = table(spark, d, "orders")
    verdict = (
        F.when(F.col("o_orderstatus") == "F", " refutes, then supports ").when(F.col("o_orderstatus") == "O", " Supports ")
        .when(F.col("o_orderstatus") == "P", " has not enough info ").otherwise(" says nothing ")
    )
    text = F.concat(F.lit("The order "), F.col("o_orderkey").cast("string"), verdict, F.col("o_orderpriority"))
    return o.groupBy(E.veracity_label(text).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "mc_proxy", "E06",
    """with x as (select p_partkey, [1.0, 0.5 * (p_size % 3), 0.25 * (p_size % 5)] as s, [(p_size < 25)::int, 0, 1] as y from part),
    b as (select *, list_position(s, list_max(s)) as i, s[1] * y[1] + s[2] * y[2] + s[3] * y[3] as t from x)
    select p_partkey, (y[i] > 0)::double as acc, round(t / (list_sum(s) + 1e-8), 6)::double as mass, 1.0::double as valid from b""",
)
def mc_proxy(spark, d):
    p = table(spark, d, "part")
    size = F.col("p_size")
    sims = F.array(F.lit(1.0), F.lit(0.5) * (size % 3), F.lit(0.25) * (size % 5))
    labels = F.array((size < 25).cast("int"), F.lit(0), F.lit(1))
    m = E.mc_proxy(F.array("p_name", "p_type", "p_brand"), sims, labels)
    return p.select("p_partkey", m.alias("m")).select("p_partkey", "m.acc", F.round("m.mass", 6).alias("mass"), "m.valid")


@query(
    "option_likelihood", "E10",
    """with x as (select p_partkey, [ln(p_size + 1.0), ln(p_retailprice / 100), 0.5] as s, [1, 0, (p_size > 10)::int] as y from part),
    e as (select *, list_transform(s, lambda v: exp(v - list_max(s))) as w from x)
    select p_partkey, (y[list_position(s, list_max(s))] > 0)::int as acc, round((w[1] * y[1] + w[2] * y[2] + w[3] * y[3]) / list_sum(w), 6) as mass from e""",
)
def option_likelihood(spark, d):
    p = table(spark, d, "part")
    s = F.array(F.log(F.col("p_size") + 1.0), F.log(F.col("p_retailprice") / 100), F.lit(0.5))
    m = E.softmax_mass(s, F.array(F.lit(1), F.lit(0), (F.col("p_size") > 10).cast("int")))
    return p.select("p_partkey", m.alias("m")).select("p_partkey", "m.acc", F.round("m.mass", 6).alias("mass"))


@query(
    "prediction_choice", "E08",
    """select conv_id, turn, case role when 'assistant' then coalesce(nullif(lower(text), ''), text) else text end as prediction from conversations""",
)
def prediction_choice(spark, d):
    c = table(spark, d, "conversations")
    method = F.when(F.col("role") == "assistant", "graph_grounded").otherwise("graph")
    p = E.pick_prediction(method, F.col("text"), F.lower("text"), F.lit(""), F.lit(""))
    return c.select("conv_id", "turn", p.alias("prediction"))


@query(
    "answer_quality", "E09",
    rf"""select doc_id, case when t = '' then -10000 else (case when length(t) between 24 and 180 then 30 when length(t) between 12 and 240 then 15 else -10 end)
      + (case when regexp_matches(t, '!\[[^\]]*\]\([^)]*\)') then -60 else 0 end) + (case when regexp_matches(t, '(?i)https?://') then -40 else 0 end)
      + (case when regexp_matches(t, '!{{2,}}|`{{2,}}') then -20 else 0 end) + least(25, len(regexp_extract_all(t, '[A-Za-z]{{2,}}')) * 2 + len(regexp_extract_all(t, '[{S.CJK}]')) // 4) end::int as quality
    from (select doc_id, {S.strip('text')} as t from documents)""",
)
def answer_quality(spark, d):
    return documents(spark, d).select("doc_id", E.answer_quality(F.col("text")).alias("quality"))


@query("best_candidate", "E09")
def best_candidate(spark, d):
    c = F.col("text")
    cands = F.concat(F.array(c), N.split_claims(c), T.paragraphs(c))
    return documents(spark, d).select("doc_id", F.md5(E.best_candidate(cands)).alias("best_md5"))


@query(
    "latency_summary", "A09",
    """select event_type, count(*) as n, round(avg(value), 6) as avg_ms, list_sort(list(value))[round_even((count(*) - 1) * 0.5, 0)::int + 1] as p50, list_sort(list(value))[round_even((count(*) - 1) * 0.95, 0)::int + 1] as p95
    from events group by event_type""",
)
def latency_summary(spark, d):
    e = table(spark, d, "events")
    q = E.order_statistic(e, ["event_type"], "value", {"p50": E.nearest_rank(0.5), "p95": E.nearest_rank(0.95)})
    return q.join(e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("avg_ms")), "event_type").select("event_type", "n", "avg_ms", "p50", "p95")


@query(
    "quality_report", "A08,C15,C16",
    f"""with t as (select {S.normalize('text')} as t, lang from documents),
    m as (select lang, len(regexp_extract_all(t, '[A-Za-z0-9]+|[{S.CJK}]'))::int as tc, (length(regexp_replace(t, '[\\x20-\\x7e{S.CJK}\\n\\r\\t]', '', 'g')) / greatest(1, length(t)) >= 0.02)::int as np,
      (length(t) - length(replace(t, '|', '')) >= 8)::int as tab, sha256(t) as h from t where t <> '')
    select lang, count(*) as n, min(tc) as min_tokens, round(avg(tc), 6) as avg_tokens, list_sort(list(tc))[(floor(0.5 * (count(*) - 1)))::int + 1] as p50, list_sort(list(tc))[(floor(0.95 * (count(*) - 1)))::int + 1] as p95,
     max(tc) as max_tokens, sum(np)::bigint as nonprintable, sum(tab)::bigint as tables, count(distinct h) as unique_texts from m group by lang""",
)
def quality_report(spark, d):
    t = T.normalize_text(F.col("text"))
    m = documents(spark, d, "text", "lang").select("lang", t.alias("t")).where("t <> ''").select(
        "lang", T.approx_token_count(F.col("t")).alias("tc"), (T.nonprintable_ratio(F.col("t")) >= 0.02).cast("int").alias("np"),
        (F.length("t") - F.length(F.translate("t", "|", "")) >= 8).cast("int").alias("tab"), F.sha2("t", 256).alias("h"),
    )
    m = cut_lineage(m)  # five narrow columns per text, read four times below
    q = E.order_statistic(m, ["lang"], "tc", {"p50": E.floor_rank(0.5), "p95": E.floor_rank(0.95)}).drop("n")
    base = m.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.min("tc").alias("min_tokens"), F.round(F.avg("tc"), 6).alias("avg_tokens"), F.max("tc").alias("max_tokens"),
        F.sum("np").alias("nonprintable"), F.sum("tab").alias("tables"),
    )
    uniq = m.select("lang", "h").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("unique_texts"))
    return base.join(q, "lang").join(uniq, "lang")


@query(
    "length_tertiles", "A24,J18",
    """with s as (select list_sort(list(n_chars)) as l, count(*) as n from documents), q as (select l[(n // 3)::int + 1] as q1, l[(2 * n // 3)::int + 1] as q2 from s)
    select case when n_chars <= q1 then 'short' when n_chars <= q2 then 'medium' else 'long' end as bucket, count(*) as n, round(100.0 * avg(quality), 6) as quality_em, round(100.0 * avg(toxic), 6) as toxic_em
    from documents join labels using (doc_id), q group by 1""",
)
def length_tertiles(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    q = A.tertiles(docs, "n_chars").select("q1", "q2").withColumn("_k", F.lit(0))
    rows = docs.join(table(spark, d, "labels"), "doc_id").join(F.broadcast(q), F.lit(0) == F.col("_k"))
    b = F.when(F.col("n_chars") <= F.col("q1"), "short").when(F.col("n_chars") <= F.col("q2"), "medium").otherwise("long")
    return rows.groupBy(b.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("quality") * 100, 6).alias("quality_em"), F.round(F.avg("toxic") * 100, 6).alias("toxic_em")
    )


def outcomes(spark, d):
    """0/1 outcomes of two methods per document, with the document source as the dataset."""
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id")


@query("bootstrap_ci", "A26,T20")
def bootstrap_ci(spark, d):
    b = E.bootstrap_ci(outcomes(spark, d), "lang", "quality")
    return b.select("lang", "n", F.round("mean", 6).alias("mean"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def _weights_sql(scores: str, rounds: int = 1000, seed: int = 42) -> str:
    """``scores(rid text, ...)`` x rounds with the Poisson weight ``w`` of each row and round."""
    m = 2**32 - 1
    x = f"""select s.*, b, ('0x' || substr(md5(rid), 9, 8))::ubigint as _c, xor(('0x' || substr(md5(rid), 1, 8))::ubigint, ((b * 2654435769 + {seed}) & {m})::ubigint) as _x
      from {scores} s cross join (select unnest(range(1, {rounds + 1})) as b)"""
    for word in ("_c", "0::ubigint"):
        x = f"select * replace ((xor(_x, _x >> 16) * 2146121005::ubigint) & {m}::ubigint as _x) from ({x})"
        x = f"select * replace ((xor(_x, _x >> 15) * 2221713035::ubigint) & {m}::ubigint as _x) from ({x})"
        x = f"select * replace (xor(xor(_x, _x >> 16), {word}) as _x) from ({x})"
    return f"select *, {' + '.join(f'(_x >= {c})::int' for c in E.poisson_cuts())} as w from ({x})"


def method_turns(spark, d):
    """Three methods of answering a turn: the whole reply, its first sentence, its last sentence."""
    t = turns(spark, d)
    parts = F.filter(F.transform(F.split("pred", r"\."), T.strip), lambda x: x != "")
    sent = F.when(F.size(parts) == 0, F.array(F.lit(""))).otherwise(parts)
    preds = F.create_map(F.lit("reply"), F.col("pred"), F.lit("first"), F.get("_s", F.lit(0)), F.lit("last"), F.element_at("_s", -1))
    return t.withColumn("_s", sent).select("conv_id", "turn", "gold", F.explode(preds).alias("method", "pred"))


@query(
    "method_intervals", "A25,A26,E01,E04",
    f"""with {TURNS}, p as (select *, list_filter(list_transform(string_split(pred, '.'), lambda x: {S.strip('x')}), lambda x: x <> '') as l from turns),
    m as (select conv_id, turn, gold, 'reply' as method, pred from p union all select conv_id, turn, gold, 'first', coalesce(l[1], '') from p union all select conv_id, turn, gold, 'last', coalesce(l[-1], '') from p),
    t as (select conv_id || '-' || turn as rid, method, string_split({SQUAD('pred')}, ' ') as p, string_split({SQUAD('gold')}, ' ') as g, {STRICT('pred')} as sp, {STRICT('gold')} as sg from m),
    f as (select rid, method, (sp = sg)::int as em, list_filter(p, lambda x: x <> '') as p, list_filter(g, lambda x: x <> '') as g from t),
    tp as (select rid, method, w, count(*) as c from (select rid, method, unnest(p) as w from f) group by all), tg as (select rid, method, w, count(*) as c from (select rid, method, unnest(g) as w from f) group by all),
    o as (select rid, method, sum(least(tp.c, tg.c)) as o from tp join tg using (rid, method, w) group by all),
    scores as materialized (select rid, method, em::double * 100 as em, coalesce(2 * o / (len(p) + len(g)), 0)::double as f1 from f left join o using (rid, method)),
    r as (select method, b, sum(w * em) / sum(w) as em, sum(w * f1) / sum(w) as f1 from ({_weights_sql('scores')}) group by method, b having sum(w) > 0),
    i as (select method, list_sort(list(em)) as e, list_sort(list(f1)) as f from r group by method),
    h as (select method, count(*) as n, avg(em) as em, avg(f1) as f1 from scores group by method)
    select method, n, round(h.em, 6) as em_mean, round(e[greatest(0, floor(len(e) * 0.025)::int - 1) + 1], 6) as em_lo, round(e[greatest(0, floor(len(e) * 0.975)::int - 1) + 1], 6) as em_hi,
    round(h.f1, 6) as f1_mean, round(f[greatest(0, floor(len(f) * 0.025)::int - 1) + 1], 6) as f1_lo, round(f[greatest(0, floor(len(f) * 0.975)::int - 1) + 1], 6) as f1_hi from h join i using (method)""",
)
def method_intervals(spark, d):
    """Exact match (percent) and F1 of each method with resampled intervals; a turn weighs alike under every method."""
    p, g = F.col("pred"), F.col("gold")
    em = E.exact_match(p, F.array(g)).cast("double") * 100
    t = method_turns(spark, d).select("conv_id", "turn", "method", em.alias("em"), E.token_f1(p, g).alias("f1"))
    out = E.poisson_intervals(t, "method", F.concat_ws("-", "conv_id", "turn"), ["em", "f1"])
    return out.select("method", "n", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


@query("paired_permutation", "A27,T20")
def paired_permutation(spark, d):
    o = outcomes(spark, d).withColumn("diff", F.col("quality") - F.col("toxic"))
    return E.paired_permutation(o, "lang", "diff").select("lang", "n", F.round("p_value", 6).alias("p_value"))


@query(
    "method_panel", "A31,A32",
    """with m as (select doc_id, source, 'quality' as method, quality as em from documents join labels using (doc_id) union all select doc_id, source, 'toxic', toxic from documents join labels using (doc_id))
    select source, round(100.0 * avg(em) filter (method = 'quality'), 6) as quality, round(100.0 * avg(em) filter (method = 'toxic'), 6) as toxic, round(100.0 - 100.0 * avg(em) filter (method = 'quality'), 6) as error_rate from m group by source""",
)
def method_panel(spark, d):
    o = outcomes(spark, d)
    m = o.select("source", F.explode(F.create_map(F.lit("quality"), F.col("quality"), F.lit("toxic"), F.col("toxic"))).alias("method", "em"))
    p = m.groupBy("source").pivot("method", ["quality", "toxic"]).agg(F.round(F.avg("em") * 100, 6))
    return p.withColumn("error_rate", F.round(F.lit(100.0) - F.col("quality"), 6))


@query(
    "keyword_counts", "A29",
    """select p as pattern, count(*) as n from documents, (values ('the', 'the'), ('und', 'und'), ('phone', '\\+1 \\([0-9]+\\)'), ('*any*', 'the|und|\\+1 \\([0-9]+\\)')) v(p, rx) where regexp_matches(text, '(?i)' || rx) group by p""".replace("\\\\", "\\"),
)
def keyword_counts(spark, d):
    return A.keyword_counts(documents(spark, d), "text", {"the": "the", "und": "und", "phone": r"\+1 \([0-9]+\)"})


@query("keyword_sample", "A29,W16,T20")
def keyword_sample(spark, d):
    docs = table(spark, d, "documents").where(F.col("text").rlike("(?i)und")).select("doc_id", "lang")
    return A.hash_sample(docs, "doc_id", 20, seed=7)


@query(
    "error_buckets", "A23,W14",
    f"""with {TURNS}, f as (select turn, regexp_matches(pred, '(?i)https?://') as has_url, length(pred) - length(replace(pred, '!', '')) >= 3 as has_many_exclaim, length({S.strip('pred')}) < 16 as is_too_short,
      regexp_matches(pred, '(?i)(^|[^{S.WORD}])(generally|typically|usually|it is recommended|likely|possibly|in general)($|[^{S.WORD}])') as has_hedging from turns where length(pred) < length(gold))
    select count(*) as losers, sum(has_url::int)::bigint as has_url, sum(has_many_exclaim::int)::bigint as has_many_exclaim, sum(is_too_short::int)::bigint as is_too_short, sum(has_hedging::int)::bigint as has_hedging from f""",
)
def error_buckets(spark, d):
    t = turns(spark, d).where(F.length("pred") < F.length("gold"))
    fl = A.text_flags(F.col("pred"))
    names = ["has_url", "has_many_exclaim", "is_too_short", "has_hedging"]
    return t.agg(F.count(F.lit(1)).alias("losers"), *[F.sum(fl[n].cast("int")).alias(n) for n in names])


@query(
    "worst_cases", "A23,W14",
    f"with {TURNS} select conv_id, turn, length(pred)::int - length(gold)::int as delta from turns order by delta, conv_id, turn limit 10",
)
def worst_cases(spark, d):
    t = turns(spark, d).select("conv_id", "turn", (F.length("pred") - F.length("gold")).alias("delta"))
    return t.orderBy("delta", "conv_id", "turn").limit(10)


@query(
    "audit_report", "A22",
    """with a as (select event_type as method_key, user_id % 5 > 0 as av, value > 5 as r, value > 10 as d, value > 20 as p from events),
    c as (select *, case when not av then 'NO_ORACLE' when not r then 'MISS_RETRIEVAL' when not d then 'MISS_DRM' when not p then 'MISS_PROMPT' else 'HIT_PROMPT' end as k from a)
    select method_key, count(*) filter (k = 'NO_ORACLE') as no_oracle, count(*) filter (k = 'MISS_RETRIEVAL') as miss_retrieval, count(*) filter (k = 'MISS_DRM') as miss_drm, count(*) filter (k = 'MISS_PROMPT') as miss_prompt,
     count(*) filter (k = 'HIT_PROMPT') as hit_prompt, round(count(*) filter (av and r) / greatest(1, count(*) filter (av)), 6) as retrieval_rate from c group by 1""",
)
def audit_report(spark, d):
    e = table(spark, d, "events")
    av, r, m, p = F.col("user_id") % 5 > 0, F.col("value") > 5, F.col("value") > 10, F.col("value") > 20
    k = A.failure_class(av, r, m, p)
    names = ["NO_ORACLE", "MISS_RETRIEVAL", "MISS_DRM", "MISS_PROMPT", "HIT_PROMPT"]
    wide = e.groupBy(F.col("event_type").alias("method_key"), k.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    piv = wide.groupBy("method_key").pivot("k", names).agg(F.coalesce(F.sum("n"), F.lit(0)))
    rate = e.groupBy(F.col("event_type").alias("method_key")).agg(
        F.round(F.sum((av & r).cast("int")) / F.greatest(F.lit(1), F.sum(av.cast("int"))), 6).alias("retrieval_rate")
    )
    return piv.select("method_key", *[F.coalesce(n, F.lit(0)).alias(n.lower()) for n in names]).join(rate, "method_key")


@query(
    "protocol_score", "A28",
    f"""with k as (select doc_id, list_filter(list_transform(string_split(text, ','), lambda x: {S.strip('x')}), lambda x: x <> '') as kp,
      list_distinct(list_filter(list_transform(string_split(text, '.'), lambda x: {S.strip('x')}), lambda x: x <> '')) as cl from documents)
    select doc_id, len(kp)::int as key_points, len(list_filter(kp, lambda x: list_contains(cl, x)))::int as covered, (len(kp) - len(list_filter(kp, lambda x: list_contains(cl, x))))::int as overclaim from k""",
)
def protocol_score(spark, d):
    head = F.col("text")
    claims = F.array_distinct(F.filter(F.transform(F.split(head, r"\."), T.strip), lambda x: x != ""))
    p = A.protocol_score(F.split(head, ","), F.col("claims"))
    return documents(spark, d).withColumn("claims", claims).select("doc_id", p.alias("p")).select("doc_id", "p.key_points", "p.covered", "p.overclaim")


def _tokens2(e: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({e}), '[a-z0-9]{{2,}}'))"


@query(
    "weak_oracle", "A33,J17",
    f"""with g as (select item_id as qid, {_tokens2('text')} as t from benchmark), gx as (select qid, len(t) as n, unnest(t) as tok from g),
    o as (select qid, n, doc_id as rid, count(*) as o from gx join (select doc_id, unnest({_tokens2('text')}) as tok from documents) using (tok) group by all),
    s as (select qid, rid, round(o / n, 6) as score from o)
    select qid, rid, score, row_number() over (partition by qid order by score desc, rid)::int as rank from s where score >= 0.18 qualify rank <= 3""",
)
def weak_oracle(spark, d):
    g = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return R.weak_oracle(g, documents(spark, d).withColumnRenamed("doc_id", "rid"))


@query(
    "shingle_overlap", "Q18",
    f"""with b as (select item_id as qid, regexp_replace(text, '[{S.WS}]+', '', 'g') as t from benchmark), dd as (select doc_id as rid, regexp_replace(text, '[{S.WS}]+', '', 'g') as t from documents),
    bs as (select qid, list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) as s from b where length(t) >= 3),
    ds as (select rid, case when length(t) < 3 then [t] else list_distinct([t[i:i+2] for i in range(1, length(t) - 1)]) end as s from dd where t <> ''),
    bx as (select qid, len(s) as n, unnest(s) as g from bs), dx as (select rid, len(s) as m, unnest(s) as g from ds),
    o as (select qid, n, rid, m, count(*) as o from bx join dx using (g) group by all),
    sc as (select qid, rid, round(case when n < 18 then o / n else greatest(o / (n + m - o), o / m * 0.6) end, 6) as score from o)
    select qid, rid, score, row_number() over (partition by qid order by score desc, rid)::int as rank from sc qualify rank <= 1""",
)
def shingle_overlap(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return R.best_shingle_match(q, documents(spark, d).withColumnRenamed("doc_id", "rid"))


_SENT_D = SPLIT_D


@query(
    "grounding", "Q17",
    f"""with a as (select conv_id, conv_id || '-' || turn as k, {_SENT_D} as ss from conversations where role = 'assistant'), s as (select conv_id, k, i, ss[i] as t from (select conv_id, k, ss, unnest(range(1, len(ss) + 1)) as i from a)),
    st as (select conv_id, k || '-' || (i - 1) as sid, {S.overlap_tokens('t')} as toks from s),
    ev as (select distinct conv_id, unnest({S.overlap_tokens('text')}) as tok from conversations where role = 'user'),
    h as (select sid, count(*) as hit from (select conv_id, sid, unnest(toks) as tok from st) join ev using (conv_id, tok) group by sid)
    select conv_id, sid, len(toks)::bigint as n, coalesce(hit, 0) as hit, (len(toks) > 0 and coalesce(hit, 0) * 10 >= len(toks)) as grounded from st left join h using (sid)""",
)
def grounding(spark, d):
    c = spread(table(spark, d, "conversations"), "conv_id")
    s = explode_rows(c.where("role = 'assistant'"), ["conv_id", "turn"], N.split_cjk_stops(F.col("text")), "i", "s").withColumnRenamed("s", "text")
    s = s.select("conv_id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col("i").cast("string")).alias("sid"), "text")
    return R.ground_sentences(s, c.where("role = 'user'").select("conv_id", "text"), "conv_id")


@query(
    "retrieval_audit", "J16,Q25",
    f"""with {TURNS}, g as (select conv_id || '-' || turn as qid, regexp_replace({S.strip('lower(gold)')}, '[{S.WS}]+', ' ', 'g') as g, regexp_replace({S.strip('lower(pred)')}, '[{S.WS}]+', ' ', 'g') as p from turns)
    select qid, 1::bigint as golds, (p <> '' and (contains(p, g) or contains(g, p)))::bigint as hits from g where g <> ''""",
)
def retrieval_audit(spark, d):
    t = turns(spark, d).withColumn("qid", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return J.oracle_hits(t.select("qid", F.col("pred").alias("text")), t.select("qid", F.lit(0).alias("gold_no"), F.col("gold").alias("text")))


@query(
    "answer_choice", "Q19",
    f"""with c as (select conv_id, turn, text, len(list_intersect({S.overlap_tokens('text')}, ['the', 'que', 'de', 'la', 'and', 'of'])) as o, case role when 'assistant' then 0 else 1 end as prio from conversations)
    select conv_id, md5(arg_max(text, [o, -length(text), -prio])) as text_md5 from c group by conv_id""",
)
def answer_choice(spark, d):
    c = table(spark, d, "conversations")
    from ..functions.tokens import overlap_tokens

    support = F.array(*[F.lit(x) for x in ("the", "que", "de", "la", "and", "of")])
    cand = c.select(
        "conv_id", F.col("turn").alias("ord"), "text", F.size(F.array_intersect(overlap_tokens(F.col("text")), support)).alias("overlap"), F.length("text").alias("n_chars"),
        F.when(F.col("role") == "assistant", 0).otherwise(1).alias("prio"),
    )
    return R.answer_choice(cand, "conv_id").select("conv_id", F.md5("text").alias("text_md5"))
