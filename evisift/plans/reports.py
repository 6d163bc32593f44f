"""Report, trace, storage and filter queries over the remaining operator families."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sentences as N, text as T
from ..functions.rows import explode_rows
from ..operators import aggregate as A, evalmetrics as E, extract as X, filters as Fi, gating as G, joins as J, retrieval as R, vectors as V
from ..registry import query
from ..session import broadcast_if_small, cut_lineage, spread
from ..sources import bank as B, jsonl as JL, pages as P
from ..sources.tables import documents, table
from . import sqlparts as S
from .evaluate import TURNS, turns
from .extract import SPLIT_D
from .search import bench_queries
from .vectors import MEANS, _ranked, bank, class_queries


@query(
    "claim_set_stats", "A20",
    f"""with c as (select source, {S.strip('c')} as claim, doc_id from (select source, doc_id, unnest(string_split(text, chr(10))) as c from documents)),
    k as (select source, claim, count(*) as n, count(distinct doc_id) as docs from c where claim <> '' group by all)
    select source, sum(n)::bigint as claims, count(*) as distinct_claims, sum(docs)::bigint as links from k group by source""",
)
def claim_set_stats(spark, d):
    """Lines of documents as claims, document sources as sets."""
    c = explode_rows(documents(spark, d, "text", "source"), ["source", "doc_id"], F.split("text", "\n"), "claim")
    return A.claim_set_stats(c.withColumn("claim", T.strip(F.col("claim"))).where("claim <> ''"), "source", "claim", "doc_id")


_ITEMS = "case when p_size >= 10 then case when len(list_filter(string_split(p_name, ' '), lambda w: length(w) > 5)) > 0 then list_filter(string_split(p_name, ' '), lambda w: length(w) > 5) else string_split(p_type, ' ') end end"


@query(
    "alignment_report", "A21",
    f"""with b as (select {_ITEMS} as items from part) select count(*) as total_blocks, count(*) filter (len(items) > 0) as list_like_blocks,
    round(coalesce(avg(len(items)) filter (len(items) > 0), 0), 6) as avg_list_feature_count, count(*) filter (items is null) as blocks_missing_enriched from b""",
)
def alignment_report(spark, d):
    """Parts as enriched blocks: long words of the name are list items, words of the type the fallback; small sizes are not enriched."""
    long_words = F.filter(F.split("p_name", " "), lambda w: F.length(w) > 5)
    b = table(spark, d, "part").select(F.when(F.col("p_size") >= 10, F.struct(long_words.alias("list_items"), F.split("p_type", " ").alias("list_like_items"))).alias("features"))
    return A.alignment_report(b, "features")


@query(
    "paragraph_filter_stats", "A30",
    """with l as (select source, case when quality = 0 then 'DROP' when toxic = 1 then 'UNCERTAIN' else 'KEEP' end as v from documents join labels using (doc_id))
    select source, count(*) as total, count(*) filter (v = 'KEEP') as kept, count(*) filter (v <> 'KEEP') as dropped, count(*) filter (v = 'UNCERTAIN') as uncertain from l group by source""",
)
def paragraph_filter_stats(spark, d):
    """Verdicts of a given label column; in strict mode the uncertain are dropped too."""
    lab = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 0, "DROP").when(F.col("toxic") == 1, "UNCERTAIN").otherwise("KEEP").alias("verdict"))
    return A.verdict_stats(table(spark, d, "documents").select("doc_id", "source").join(lab, "doc_id"), "source", "verdict", strict=True)


@query(
    "evidence_rows", "K09",
    f"""with s as (select conv_id || '-' || turn as block_id, {SPLIT_D} as ss from conversations where {S.strip('text')} <> '')
    select block_id || '::ev' || i as evidence_id, block_id, md5(ss[i]) as text_md5 from (select block_id, ss, unnest(range(1, len(ss) + 1)) as i from s)""",
)
def evidence_rows(spark, d):
    c = spread(table(spark, d, "conversations"), "conv_id").where(T.strip(F.col("text")) != "")
    blocks = c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("block_id"), "text")
    return X.evidence_rows(blocks, "block_id", N.split_cjk_stops(F.col("text"))).select("evidence_id", "block_id", F.md5("text").alias("text_md5"))


@query(
    "seen_aliases", "G05",
    """with t as (select distinct c_name as name from orders join customer on c_custkey = o_custkey where o_orderpriority = '1-URGENT'), a as (select c_name as name, c_mktsegment || ' ' || c_custkey as alias from customer)
    select name, alias from a where name in (select name from t)""",
)
def seen_aliases(spark, d):
    """Alias records of customers, kept for those that occur in a triple (an urgent order)."""
    c = table(spark, d, "customer")
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    triples = c.join(o, "c_custkey", "left_semi").select(F.col("c_name").alias("subject"), F.lit("urgent").alias("object"))
    return J.seen_aliases(c.select(F.col("c_name").alias("name"), F.concat_ws(" ", "c_mktsegment", F.col("c_custkey").cast("string")).alias("alias")), triples)


@query(
    "anchor_triples", "G16",
    """with t as (select conv_id, turn, role || ' ' || turn as title, md5(text) as answer, row_number() over (partition by conv_id order by turn desc) as back from conversations),
    a as (select conv_id, answer from t where back = 1)
    select 'tri_answer_' || conv_id || '_' || turn as triple_id, title as subject, 'answer_anchor' as predicate, a.answer as object from t join a using (conv_id)""",
)
def anchor_triples(spark, d):
    """Every title of a conversation is anchored at its last text; the answer is a partial maximum, not a window over the key."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(" ", "role", F.col("turn").cast("string")).alias("title"), F.md5("text").alias("answer"))
    return J.answer_anchors(c.select(F.col("conv_id").alias("qid"), F.col("turn").alias("pos"), "title"), c.groupBy(F.col("conv_id").alias("qid")).agg(F.max_by("answer", "turn").alias("answer")))


@query(
    "win_cases", "J20",
    f"""with {TURNS}, p as (select conv_id || '-' || turn as id, length(pred) > length(gold) as win from turns),
    s as (select conv_id || '-' || turn as id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {S.strip('x')}), lambda x: x <> '') as ss from conversations)
    select id, len(ss)::int as n_support, md5(array_to_string(ss, '|')) as support_md5 from p join s using (id) where win""",
)
def win_cases(spark, d):
    """Turns whose prediction is longer than its gold, with their supporting sentences."""
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    p = turns(spark, d).select(key.alias("id"), (F.length("pred") > F.length("gold")).alias("win"))
    s = table(spark, d, "conversations").select(key.alias("id"), F.split("text", "\n").alias("sentences"))
    w = J.win_cases(p, s)
    return w.select("id", F.size("support").alias("n_support"), F.md5(F.array_join("support", "|")).alias("support_md5"))


@query("single_doc", "K15", "select conv_id, turn from conversations where coalesce(nullif(trim(role), ''), '?') || conv_id = 'user1'")
def single_doc(spark, d):
    """Rows of one document; the first filled id column names it."""
    c = table(spark, d, "conversations").withColumn("doc", F.concat("role", F.col("conv_id").cast("string"))).withColumn("other", F.lit("?"))
    return Fi.single_document(c, ["doc", "other"], "user1").select("conv_id", "turn")


@query(
    "method_f1", "A25,A31",
    """with m as (select doc_id, lang, 'quality' as method, quality as em from documents join labels using (doc_id) union all select doc_id, lang, 'toxic', toxic from documents join labels using (doc_id))
    select method, lang, count(*) as n, round(avg(em), 6) as accuracy, round(greatest(0.0, avg(em) - 1.96 * sqrt(avg(em) * (1 - avg(em)) / count(*))), 6) as lo,
    round(least(1.0, avg(em) + 1.96 * sqrt(avg(em) * (1 - avg(em)) / count(*))), 6) as hi from m group by method, lang""",
)
def method_f1(spark, d):
    """Accuracy with a normal interval for each method and language (resampled intervals: ``bootstrap_ci``)."""
    o = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    m = o.select("lang", F.explode(F.create_map(F.lit("quality"), F.col("quality"), F.lit("toxic"), F.col("toxic"))).alias("method", "em"))
    return E.accuracy_panel(m, ["method", "lang"], "em")


@query(
    "turn_f1", "A25",
    f"""with {TURNS}, g as (select conv_id, {S.words('lower(pred)')} as p, {S.words('lower(gold)')} as g from turns),
    o as (select conv_id, len(p) as np, len(g) as ng, coalesce(list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda x: x = w)), len(list_filter(g, lambda x: x = w))))), 0) as k from g)
    select conv_id, count(*) as n, round(avg(case when np = 0 or ng = 0 then (np = ng)::int else 2.0 * k / (np + ng) end), 6) as f1 from o group by conv_id""",
)
def turn_f1(spark, d):
    w = lambda c: F.filter(F.split(T.squash(F.lower(F.col(c))), " "), lambda x: x != "")
    t = turns(spark, d).select("conv_id", w("pred").alias("p"), w("gold").alias("g"))
    k = E.multiset_overlap(F.col("p"), F.col("g"))
    empty = (F.size("p") == 0) | (F.size("g") == 0)
    f1 = F.when(empty, (F.size("p") == F.size("g")).cast("double")).otherwise(2.0 * k / (F.size("p") + F.size("g")))
    return t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(f1), 6).alias("f1"))


@query(
    "evidence_chain", "Q13,Q15,Q16",
    f"""with q as (select item_id, text as qtext, {S.overlap_tokens('text')} as qt from benchmark),
    qx as (select item_id, len(qt)::bigint as nq, unnest(qt) as tok from q), dx as (select doc_id, unnest({S.overlap_tokens('text')}) as tok from documents),
    o as (select item_id, nq, doc_id, count(*) as overlap from qx join dx using (tok) group by all),
    pool as (select *, row_number() over (partition by item_id order by overlap desc, doc_id)::int as r from o where overlap * 100 >= nq * 5 qualify r <= 12),
    s as (select item_id, doc_id, overlap / nq as score, least(64, greatest(1, length(text) // 100)) as cost, row_number() over (partition by item_id order by overlap / nq desc, doc_id) as n
      from pool join documents using (doc_id) where overlap / nq >= 0.2),
    b as (select *, sum(cost) over (partition by item_id order by n rows unbounded preceding) as used from s)
    select item_id, doc_id, round(score, 6) as score, row_number() over (partition by item_id order by n)::int as rank from b where used <= 256 qualify rank <= 8""",
)
def evidence_chain(spark, d):
    """Pool, relevance score, threshold, budget, rank and limit: the evidence of a prompt."""
    q, docs = bench_queries(spark, d), documents(spark, d)
    pool = cut_lineage(R.text_search(q, docs, k=12, min_pct=5).select("qid", "doc_id"))
    ids = broadcast_if_small(pool.select("doc_id").distinct())
    pairs = pool.join(q.withColumnRenamed("text", "question"), "qid").join(docs.join(ids, "doc_id", "left_semi"), "doc_id")
    return R.evidence_chain(pairs, threshold=0.2, budget=256, limit=8).withColumnRenamed("qid", "item_id")


@query(
    "candidate_trace", "Q24",
    f"""with {MEANS}, pool as {_ranked('scored', 50)} select qid, bool_or(label = qid) as in_pool, coalesce(bool_or(label = qid and rank <= 10), false) as in_final, min(rank) filter (label = qid) as first_rank,
    count(*) as pool_size from pool group by qid""",
)
def candidate_trace(spark, d):
    pool = V.search(class_queries(spark, d), bank(spark, d), 50)
    ids = broadcast_if_small(cut_lineage(pool).select("rid").distinct())
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("rid"), "label").join(ids, "rid", "left_semi")
    return E.candidate_trace(pool.join(labels, "rid"), "qid", "rank", F.col("label") == F.col("qid"), 10)


@query("strict_scan", "S01", "select role, count(*) as n, sum(length(text))::bigint as chars from conversations group by role")
def strict_scan(spark, d):
    c = table(spark, d, "conversations")
    path = B.scratch_path(spark, "lines")
    JL.replace_table(c, path)
    return JL.read_strict(spark, path, c.schema).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("limited_scan", "S03", "select o_orderkey, o_orderstatus from orders order by o_orderkey limit 50")
def limited_scan(spark, d):
    return JL.first_rows(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 50)


@query(
    "triple_lines", "S16,T04",
    "select o_orderpriority as object, case when o_orderstatus = 'F' then 1.0 else 0.5 end::double as confidence, count(*) as n from orders where o_orderstatus <> 'P' group by 1, 2",
)
def triple_lines(spark, d):
    """Orders as triple lines, pending ones as broken lines; a confidence of zero reads as one."""
    o = table(spark, d, "orders")
    line = F.to_json(F.struct(
        F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("triple_id"), F.lit("order").alias("subject"), F.lit("has").alias("predicate"), F.col("o_orderpriority").alias("object"),
        F.when(F.col("o_orderstatus") == "F", 0.0).otherwise(0.5).alias("confidence"),
    ))
    path = B.scratch_path(spark, "triples")
    o.select(F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("{broken "), F.col("o_orderkey").cast("string"))).otherwise(line).alias("value")).write.text(path)
    return JL.read_triples(spark, path).groupBy("object", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query("report_sink", "S23", "select lang, count(*) as n from documents group by lang")
def report_sink(spark, d):
    path = B.scratch_path(spark, "report")
    JL.write_report(table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.option("header", True).schema("lang string, n bigint").csv(path)


@query(
    "allowed_events", "J10",
    "select event_type, count(*) as n from events where user_id in (select c_custkey from customer where c_mktsegment = 'BUILDING') group by event_type",
)
def allowed_events(spark, d):
    allowed = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return Fi.allow_list(table(spark, d, "events").select("user_id", "event_type"), "user_id", allowed).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("unconsumed_slots", "J15", "select event_type, count(*) as n from events where event_type <> 'view' and value <= 15 group by event_type")
def unconsumed_slots(spark, d):
    """Evidence that neither of two slots took."""
    e = table(spark, d, "events").select(F.col("event_id").alias("evidence_id"), F.array("event_type", F.when(F.col("value") > 15, "High").otherwise("low")).alias("types"), "event_type")
    s = spark.createDataFrame([("a", ["view"]), ("b", [" high"])], "slot string, wanted array<string>")
    return J.unconsumed(e, J.evidence_for_slots(e, s)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("learned_gate", "V11", "select vec_id, round(least(0.6, greatest(0.4, 1 / (1 + exp(-4 * embedding[1]::double)))), 6) as gamma from embeddings")
def learned_gate(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.round(V.learned_gate(F.get("embedding", 0).cast("double") * 4, 0.4, 0.6), 6).alias("gamma"))


@query(
    "regenerate_check", "U11",
    """with w as (select distinct o_custkey, o_orderpriority as p from orders), h as (select distinct o_custkey, o_orderpriority as p from orders where o_orderstatus <> 'O'), s as (select o_custkey, bool_or(o_totalprice < 2000) as stale from orders group by 1)
    select o_custkey, (exists (select 1 from w where w.o_custkey = s.o_custkey and not exists (select 1 from h where h.o_custkey = w.o_custkey and h.p = w.p)) or stale) as regenerate from s""",
)
def regenerate_check(spark, d):
    """Wanted ids: priorities of all orders; existing: of those not open; stale: any cheap order."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.collect_set("o_orderpriority").alias("want"), F.collect_set(F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority"))).alias("have"), F.max(F.col("o_totalprice") < 2000).alias("stale")
    )
    return o.select("o_custkey", G.needs_regeneration(F.col("want"), F.col("have"), F.col("stale")).alias("regenerate"))


@query(
    "table_free_text", "C19",
    f"""select doc_id, md5(array_to_string(list_transform(list_filter(string_split(replace(text, ' | ', chr(10) || '| '), chr(10)), lambda l: not starts_with({S.strip('l')}, '|') and not starts_with(lower({S.strip('l')}), '<!-- table:')),
    lambda l: case when {S.strip('l')} = '' then '' else l end), chr(10))) as text_md5 from documents""",
)
def table_free_text(spark, d):
    """Cells of piped texts stand on lines of their own and are dropped as table rows."""
    docs = documents(spark, d)
    return docs.select("doc_id", F.md5(T.strip_table_lines(F.replace("text", F.lit(" | "), F.lit("\n| ")))).alias("text_md5"))


@query(
    "inherited_tables", "K08",
    """with c as (select o_custkey, list_sort(list_distinct(list(o_orderkey))) as ids from orders where o_orderpriority = '1-URGENT' group by 1)
    select o_orderkey, list_aggregate(list_transform(list_sort(list_distinct(list_concat(coalesce(ids, []), [o_orderkey]))), lambda x: x::varchar), 'string_agg', ',') as table_ids from orders left join c using (o_custkey)""",
)
def inherited_tables(spark, d):
    """A customer's urgent orders as tables of a chunk, every order as a block of it."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = o.where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderkey")).alias("ids"))
    own = P.inherit_tables(F.coalesce("ids", F.array().cast("array<bigint>")), F.array("o_orderkey"))
    return o.join(c, "o_custkey", "left").select("o_orderkey", F.array_join(own.cast("array<string>"), ",").alias("table_ids"))


@query(
    "nested_answers", "X26",
    f"""select conv_id, turn, md5(array_to_string(list_reduce(list_prepend([]::varchar[], list_transform(list_filter(list_transform(list_concat([role, role], string_split(text, chr(10))), lambda x: {S.strip('x')}), lambda x: x <> ''), lambda x: [x])),
    lambda a, b: case when list_contains(a, b[1]) then a else list_concat(a, b) end), '|')) as answers_md5 from conversations""",
)
def nested_answers(spark, d):
    """The role as a short answer given twice, the lines of a text as long ones."""
    c = spread(table(spark, d, "conversations"), "conv_id")
    return c.select("conv_id", "turn", F.md5(F.array_join(X.nested_answers(F.array(F.array("role"), F.array("role")), F.split("text", "\n")), "|")).alias("answers_md5"))


@query(
    "grounding_verdicts", "Q18",
    f"""with {TURNS}, t as (select conv_id, turn, pred, {S.overlap_tokens('pred')} as p, {S.overlap_tokens('gold')} as g from turns), o as (select *, case when len(p) = 0 or len(g) = 0 then 0.0 else len(list_intersect(p, g)) / len(p) end as o from t)
    select conv_id, turn, case when length(regexp_replace(pred, '[0-9.*#\\-\\s]+', '', 'g')) < 4 or o >= 0.1 then 'keep' when o > 0 then 'tag' else 'drop' end as verdict from o""",
)
def grounding_verdicts(spark, d):
    """Share of an answer's tokens found in its question decides: keep, keep with a tag, drop."""
    t = turns(spark, d).withColumn("o", R.relevance(F.col("pred"), F.col("gold")))
    v = R.grounding_filter(F.col("o"), F.col("pred"))
    return t.select("conv_id", "turn", F.when(v.isNull(), "drop").when(v == F.col("pred"), "keep").otherwise("tag").alias("verdict"))


_QUESTION = "case o_orderstatus when 'F' then 'Which symptoms has ' when 'O' then 'Where is it treated, ' else 'What about ' end || case when o_orderkey % 5 = 0 then '发病机制 ' else '' end || o_orderpriority"


@query(
    "target_types", "Q23",
    f"""with q as (select o_orderkey, {_QUESTION} as q from orders), f as (select o_orderkey, list_filter([case when contains(lower(q), 'symptom') then 'symptom' end, case when contains(lower(q), 'treat') then 'drug' end,
    case when contains(lower(q), 'where') then 'location' end, case when contains(q, '机制') then 'mechanism' end], lambda x: x is not null) as t from q)
    select case when len(t) = 1 then t[1] when len(t) > 1 then 'multi' else 'unknown' end as target, array_to_string(t, ',') as types, count(*) as n from f group by 1, 2""",
)
def target_types(spark, d):
    """Orders worded as questions after status and key."""
    q = F.concat(
        F.when(F.col("o_orderstatus") == "F", "Which symptoms has ").when(F.col("o_orderstatus") == "O", "Where is it treated, ").otherwise("What about "),
        F.when(F.col("o_orderkey") % 5 == 0, "发病机制 ").otherwise(""), "o_orderpriority",
    )
    t = table(spark, d, "orders").select(G.target_types(q).alias("t"))
    return t.groupBy("t.target", F.array_join("t.types", ",").alias("types")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "denied_terms", "Q20",
    f"""with {TURNS} select conv_id, turn, array_to_string(list_filter(['the', 'und', 'que', 'zzz'], lambda t: not contains(gold, t) and contains(pred, t)), ',') as leaked from turns""",
)
def denied_terms(spark, d):
    terms = F.array(*[F.lit(x) for x in ("the", "und", " ", "que", "zzz")])
    return turns(spark, d).select("conv_id", "turn", F.array_join(G.denied_terms(F.col("pred"), F.col("gold"), terms), ",").alias("leaked"))


@query(
    "items_in_evidence", "Q20",
    f"""with {TURNS}, w as (select conv_id, turn, gold, list_distinct(list_filter({S.words('pred')}, lambda x: length(x) > 6)) as items from turns)
    select conv_id, turn, len(items)::int as n_items, (case when {S.strip('gold')} = '' then 0 else len(list_filter(items, lambda x: not contains(gold, x))) end)::int as n_missing from w""",
)
def items_in_evidence(spark, d):
    """Long words of an answer as its items, the question's text as evidence."""
    items = F.array_distinct(F.filter(F.split(T.squash(F.col("pred")), " "), lambda x: F.length(x) > 6))
    return turns(spark, d).select("conv_id", "turn", F.size(items).alias("n_items"), F.size(G.items_not_in_evidence(items, F.col("gold"))).alias("n_missing"))


@query(
    "sidecar_guard", "Q10",
    """select case when value > 5 and event_type = 'click' and user_id % 3 > 0 and user_id % 2 = 0 then 'EXPLANATION' when event_type = 'click' then 'FACTUAL_ASSERTION' else 'LIST_ONLY' end as style,
    case when value > 5 and event_type = 'click' and user_id % 3 > 0 and user_id % 2 = 0 then 'slot-uncovered' end as guard, count(*) as n from events group by 1, 2""",
)
def sidecar_guard(spark, d):
    e = table(spark, d, "events")
    g = G.sidecar_guard(F.when(F.col("value") > 5, "ALLOW").otherwise("BLOCK"), F.when(F.col("event_type") == "click", "FACTUAL_ASSERTION").otherwise("LIST_ONLY"), F.col("user_id") % 3, F.col("user_id") % 2)
    return e.select(g.alias("g")).groupBy("g.style", "g.guard").agg(F.count(F.lit(1)).alias("n"))


@query(
    "drug_id_choice", "Q19",
    """with c as (select o_custkey, o_orderkey, case when o_orderstatus = 'P' then 'no id' else 'db' || (o_orderkey % 7) || ' or DB' || (o_orderkey % 3) end as pred, 'DB1, DB' || (o_custkey % 7) as support from orders),
    i as (select *, list_transform(regexp_extract_all(pred, '(?i)DB[0-9]+'), lambda x: upper(x)) as p, list_transform(regexp_extract_all(support, '(?i)DB[0-9]+'), lambda x: upper(x)) as s from c),
    k as (select *, case when len(p) = 0 then -1 else len(list_filter(p, lambda x: list_contains(s, x))) end as o from i)
    select o_custkey, arg_max(pred, [o, -length(pred), -o_orderkey]) as pred, max(o)::int as overlap from k group by 1""",
)
def drug_id_choice(spark, d):
    """Identifiers of a customer's orders against the customer's own: most hits, then the shortest, then the first."""
    o = table(spark, d, "orders")
    pred = F.when(F.col("o_orderstatus") == "P", "no id").otherwise(F.concat(F.lit("db"), (F.col("o_orderkey") % 7).cast("string"), F.lit(" or DB"), (F.col("o_orderkey") % 3).cast("string")))
    c = o.select("o_custkey", "o_orderkey", pred.alias("pred"), F.concat(F.lit("DB1, DB"), (F.col("o_custkey") % 7).cast("string")).alias("support"))
    k = c.withColumn("k", R.drug_id_key(F.col("pred"), F.col("support")))
    best = k.groupBy("o_custkey").agg(F.max(F.struct("k.overlap", "k.short", (-F.col("o_orderkey")).alias("first"), "pred")).alias("b"))
    return best.select("o_custkey", "b.pred", "b.overlap")


@query(
    "expansion_lookup", "X24",
    """with p as (select p_partkey, p_brand, p_type, p_name from part) select p_partkey, case when p_partkey % 3 = 0 then regexp_replace(p_type, '[0-9]', '', 'g') || ' of parts' else '' end as in_text,
    case when p_partkey % 2 = 0 then p_type || ' long form' else '' end as in_pairs from p""",
)
def expansion_lookup(spark, d):
    """Part types written out before an abbreviation, in a text for every third part and in metadata for every second."""
    p = table(spark, d, "part")
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.regexp_replace("p_type", "[0-9]", ""), F.lit(" of parts (PTX). More."))).otherwise("Nothing (ABC) here.")
    pair = lambda full, conf: F.struct(F.lit("PTX").alias("abbr"), full.alias("full"), F.lit(conf).alias("confidence"))
    pairs = F.when(F.col("p_partkey") % 2 == 0, F.array(pair(F.col("p_type"), 0.5), pair(F.concat("p_type", F.lit(" long form")), 0.9))).otherwise(F.array(pair(F.concat("p_type", F.lit(" long form")), 0.5)))
    return p.select("p_partkey", X.expansion_in_text(text, "PTX").alias("in_text"), X.best_expansion(pairs, F.lit("ptx")).alias("in_pairs"))


@query(
    "slot_rejections", "Q08",
    """with e as (select case when user_id % 2 = 0 then 'schema:a' else '' end as schema_id, upper(event_type) as sem, case when value > 10 then 'schema:a' else 'schema:b' end as pattern_id from events)
    select case when schema_id <> '' and schema_id <> pattern_id then 'SCHEMA_MISMATCH' when lower(sem) <> 'click' then 'SEMANTIC_TYPE_MISMATCH' end as reason, count(*) as n from e group by 1""",
)
def slot_rejections(spark, d):
    """Why events are refused by a slot for clicks."""
    e = table(spark, d, "events")
    why = G.slot_rejection(
        F.when(F.col("value") > 10, "schema:a").otherwise("schema:b"), F.when(F.col("user_id") % 2 == 0, "schema:a").otherwise(""), F.lit("Click"), F.upper("event_type")
    )
    return e.groupBy(why.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
