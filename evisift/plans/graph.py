"""Knowledge-graph queries. The star schema stands in for extracted triples: customers and
suppliers are located in nations, nations are part of regions, suppliers are associated
with the parts they ship (part names are few, so they become hubs)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import stable_id
from ..functions.taxonomy import INTENT_KEYWORDS, LAYER_RANGES, RELATIONS, RELATION_VERBS
from ..operators import graph as G
from ..registry import query
from ..session import cut_lineage
from ..sources.tables import documents, table
from . import sqlparts as S

STEP = 500_000_000_000_000_000

TRIPLES = f"""raw as (
 select c_custkey as ord, c_name as subject, 'disease' as subject_type, 'located_in' as predicate, n_name as object, 'anatomy' as object_type from customer join nation on c_nationkey = n_nationkey
 union all select {STEP} + s_suppkey, s_name, 'pathogen', 'located_in', n_name, 'anatomy' from supplier join nation on s_nationkey = n_nationkey
 union all select {2 * STEP} + n_nationkey, n_name, 'anatomy', 'part_of', r_name, 'epidemiology' from nation join region on n_regionkey = r_regionkey
 union all select {3 * STEP} + l_suppkey * 2147483648 + min(l_partkey), s_name, 'pathogen', 'associated_with', p_name, 'drug'
   from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey group by l_suppkey, s_name, p_name),
tr as (select ord::bigint as ord, 't_' || substr(sha256(concat_ws('|', subject, predicate, object)), 1, 16) as triple_id, subject, subject_type, predicate, object, object_type,
  subject || ' ' || predicate || ' ' || object as sentence_text from raw),
ment as (select subject as name, subject_type as etype, ord * 2 as mo from tr union all select object, object_type, ord * 2 + 1 from tr),
ent as (select name, arg_min(etype, mo) as entity_type from ment group by name),
nodes as (select 'node_' || printf('%04d', row_number() over (order by name) - 1) as node_id, name, entity_type from ent),
inv as (select * from (values {", ".join(f"('{r}', '{i}')" for r, i, _ in RELATIONS)}) t(rel, inverse)),
ends as (select triple_id, ord, predicate, a.node_id as s, b.node_id as o from tr join nodes a on a.name = subject join nodes b on b.name = object),
edges as (select src, rel, tgt, triple_id, min(eord) as eord from (
   select s as src, predicate as rel, o as tgt, triple_id, ord * 2 as eord from ends
   union all select o, inverse, s, triple_id, ord * 2 + 1 from ends join inv on rel = predicate where inverse <> predicate) group by all),
eo as (select *, min(eord) over (partition by src, rel) as rord from edges)"""


def kg_triples(spark, d):
    cust, supp, nat, reg, part, li = (
        table(spark, d, n) for n in ("customer", "supplier", "nation", "region", "part", "lineitem")
    )
    n = F.broadcast(nat.select("n_nationkey", "n_name", "n_regionkey"))  # 25 rows at every scale

    def rows(df, no, key, subj, styp, pred, obj, otyp):
        return df.select(
            (F.lit(no * STEP).cast("bigint") + key).alias("ord"), F.col(subj).alias("subject"), F.lit(styp).alias("subject_type"),
            F.lit(pred).alias("predicate"), F.col(obj).alias("object"), F.lit(otyp).alias("object_type"),
        )

    a = rows(cust.join(n, F.col("c_nationkey") == F.col("n_nationkey")), 0, F.col("c_custkey"), "c_name", "disease", "located_in", "n_name", "anatomy")
    b = rows(supp.join(n, F.col("s_nationkey") == F.col("n_nationkey")), 1, F.col("s_suppkey"), "s_name", "pathogen", "located_in", "n_name", "anatomy")
    c = rows(
        nat.join(F.broadcast(reg), F.col("n_regionkey") == F.col("r_regionkey")), 2, F.col("n_nationkey").cast("bigint"),
        "n_name", "anatomy", "part_of", "r_name", "epidemiology",
    )
    # Distinct (supplier, part) first: a map-side aggregate shrinks lineitem before the joins.
    pairs = li.groupBy("l_suppkey", "l_partkey").agg(F.lit(1).alias("x"))
    ships = (
        pairs.join(part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_suppkey", "p_name").agg(F.min("l_partkey").alias("first_part"))
        .join(supp.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    e = rows(ships, 3, F.col("l_suppkey") * 2147483648 + F.col("first_part"), "s_name", "pathogen", "associated_with", "p_name", "drug")
    t = reduce(lambda x, y: x.unionByName(y), [a, b, c, e])
    text = F.concat_ws(" ", "subject", "predicate", "object")
    return t.withColumn("triple_id", stable_id("t_", F.col("subject"), F.col("predicate"), F.col("object"))).select(
        "*", F.lit(1.0).alias("confidence"), text.alias("sentence_text"), F.concat(F.lit("s_"), "triple_id").alias("sentence_id"),
        F.col("predicate").alias("source_block_id"), F.col("predicate").alias("source_doc_id"),
    )


def kg_parts(spark, d):
    t = kg_triples(spark, d)
    nodes = G.build_nodes(G.entities(t)).withColumn("aliases", F.array().cast("array<string>")).withColumn("description", F.lit(""))
    return t, nodes, G.build_edges(t, nodes)


def kg_tables(spark, d):
    """The graph written once (checkpoint folder) for queries that read it many times."""
    t = cut_lineage(kg_triples(spark, d))
    nodes = G.build_nodes(G.entities(t)).withColumn("aliases", F.array().cast("array<string>")).withColumn("description", F.lit(""))
    nodes = cut_lineage(nodes)
    return t, nodes, cut_lineage(G.build_edges(t, nodes))


@query("kg_triples", "C31", f"with {TRIPLES} select ord, triple_id, subject, predicate, object from tr")
def q_triples(spark, d):
    return G.last_triples(kg_triples(spark, d)).select("ord", "triple_id", "subject", "predicate", "object")


@query("kg_nodes", "G01,W15,J01", f"with {TRIPLES} select node_id, name, entity_type from nodes")
def q_nodes(spark, d):
    return G.build_nodes(G.entities(kg_triples(spark, d))).select("node_id", "name", "entity_type")


@query("kg_edges", "G04,A13,J02,J03,T10", f"with {TRIPLES} select src, rel, tgt, triple_id, eord::bigint as eord from edges")
def q_edges(spark, d):
    return kg_parts(spark, d)[2]


@query(
    "kg_stats", "A14",
    f"""with {TRIPLES} select (select count(*) from nodes) as num_nodes, (select count(*) from tr) as num_triples,
    (select count(distinct lower(name)) from nodes) as num_index_entries, (select count(distinct triple_id) from tr) as num_sentences""",
)
def q_stats(spark, d):
    t, nodes, _ = kg_tables(spark, d)
    n = nodes.agg(F.count(F.lit(1)).alias("num_nodes"))
    i = G.entity_index(nodes).agg(F.count(F.lit(1)).alias("num_index_entries"))
    tt = t.agg(F.count(F.lit(1)).alias("num_triples"))
    s = G.sentence_index(t).agg(F.count(F.lit(1)).alias("num_sentences"))
    one = [x.withColumn("one", F.lit(1)) for x in (n, tt, i, s)]
    return reduce(lambda x, y: x.join(y, "one"), one).drop("one")


@query(
    "kg_sentence_index", "A12",
    f"with {TRIPLES} select 's_' || triple_id as sid, arg_min(sentence_text, ord) as text, count(distinct triple_id) as n_triples from tr group by triple_id",
)
def q_sentences(spark, d):
    return G.sentence_index(kg_triples(spark, d)).select("sid", "text", "n_triples")


@query("kg_sentence_triples", "A12", f"with {TRIPLES} select distinct 's_' || triple_id as sid, triple_id from tr")
def q_sentence_triples(spark, d):
    return G.sentence_triples(kg_triples(spark, d))


WALK2 = """h1 as (select node_id as start, tgt as node, arg_min(rel, [rord, eord]) as relation, arg_min(triple_id, [rord, eord]) as triple_id, 1 as hop, min([rord, eord]) as path
   from st join eo on src = node_id where tgt <> node_id group by 1, 2),
 c2 as (select start, tgt as node, rel, eo.triple_id as tid, list_concat(path, [rord, eord]) as path from h1 join eo on src = node
   where tgt <> start and not exists (select 1 from h1 x where x.start = h1.start and x.node = eo.tgt)),
 h2 as (select start, node, arg_min(rel, path) as relation, arg_min(tid, path) as triple_id, 2 as hop, min(path) as path from c2 group by 1, 2)"""


@query(
    "kg_walk_2hop", "G06",
    f"""with {TRIPLES}, st as (select node_id from nodes where entity_type = 'epidemiology'), {WALK2}
    select start, node, relation, triple_id, hop from h1 union all select start, node, relation, triple_id, hop from h2""",
)
def q_walk(spark, d):
    _, nodes, edges = kg_tables(spark, d)
    starts = nodes.where("entity_type = 'epidemiology'").select(
        F.col("node_id").alias("start"), F.col("node_id").alias("node"), F.array().cast("array<string>").alias("rels")
    )
    return G.walk(edges, starts, 2).select("start", "node", "relation", "triple_id", "hop")


@query(
    "kg_walk_incoming", "G06,G08",
    f"""with {TRIPLES}, rv as (select tgt as src, rel, src as tgt, triple_id, eord from edges where rel in ('located_in', 'location_of')),
    ro as (select *, min(eord) over (partition by src, rel) as rord from rv)
    select node_id as start, tgt as node, arg_min(rel, [rord, eord]) as relation, arg_min(triple_id, [rord, eord]) as triple_id, 1 as hop from nodes join ro on src = node_id
    where entity_type = 'anatomy' and tgt <> node_id group by 1, 2""",
)
def q_walk_in(spark, d):
    _, nodes, edges = kg_parts(spark, d)
    starts = nodes.where("entity_type = 'anatomy'").select(
        F.col("node_id").alias("start"), F.col("node_id").alias("node"), G.intent_relation_column(F.lit("location")).alias("rels")
    )
    return G.walk(G.reverse_edges(edges), starts, 1).select("start", "node", "relation", "triple_id", "hop")


@query(
    "kg_relation_gating", "A19,Q15,W01",
    """with g as (select l_suppkey, l_returnflag || l_linestatus as rel, round(sum(l_discount), 6) as total, min(l_orderkey * 16 + l_linenumber) as seen, count(*) as n from lineitem group by 1, 2)
    select l_suppkey, rel, row_number() over (partition by l_suppkey order by total desc, seen)::int as rel_rank, total, n from g qualify rel_rank <= 2""",
)
def q_gating(spark, d):
    li = table(spark, d, "lineitem").select(
        "l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("rel"), "l_discount",
        (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("ord"),
    )
    kept = G.relation_gating(li, "l_suppkey", "rel", "l_discount", "ord", 2)
    return kept.groupBy("l_suppkey", "rel", "rel_rank", "total").agg(F.count(F.lit(1)).alias("n"))


def supplier_questions(spark, d):
    s = table(spark, d, "supplier")
    text = F.concat(F.lit("What is the location of "), "s_name", F.lit("?"))
    return s.select(F.col("s_suppkey").alias("qid"), text.alias("text")).withColumn("intent", G.classify_intent(F.col("text")))


@query(
    "kg_recognise", "G07,J04,T23",
    f"""with {TRIPLES}, qs as (select s_suppkey as qid, 'What is the location of ' || s_name || '?' as text from supplier)
    select qid, name as mention, node_id, position(lower(name) in lower(text))::int - 1 as start_at from qs join nodes on contains(lower(text), lower(name))""",
)
def q_recognise(spark, d):
    _, nodes, _ = kg_parts(spark, d)
    return G.recognise(supplier_questions(spark, d), G.entity_index(nodes)).select("qid", "mention", "node_id", "start_at")


@query(
    "kg_retrieve", "G08,G09,G10,U03",
    f"""with {TRIPLES}, qs as (select s_suppkey as qid, s_name from supplier),
    w as (select qid, triple_id, sentence_text, predicate, 0 as branch, 1 as hop, ord from qs join tr on subject = s_name and predicate = 'located_in'),
    sc as (select triple_id, sentence_text, predicate, ord from tr where predicate in ('located_in', 'location_of') order by ord limit 20),
    a as (select qid, triple_id, sentence_text as text, predicate as relation, hop, branch, ord from w
      union all select qid, triple_id, sentence_text, predicate, 0, 1, sc.ord from qs, sc where not exists (select 1 from w where w.qid = qs.qid and w.triple_id = sc.triple_id))
    select qid, row_number() over (partition by qid order by branch, ord)::int as rank, 's_' || triple_id as sentence_id, text, relation, hop from a qualify rank <= 10""",
)
def q_retrieve(spark, d):
    t, nodes, edges = kg_tables(spark, d)
    out = G.retrieve(supplier_questions(spark, d), t, nodes, edges, max_hops=1, max_evidence=10)
    return out.select("qid", "rank", "sentence_id", "text", "relation", "hop")


@query(
    "kg_entity_context", "G11",
    f"""with {TRIPLES} select s_suppkey as qid, '### 实体背景' || chr(10) || '- ' || name || '，类型：' || entity_type as context from supplier join nodes on name = s_name""",
)
def q_context(spark, d):
    _, nodes, _ = kg_parts(spark, d)
    m = G.recognise(supplier_questions(spark, d), G.entity_index(nodes))
    return G.entity_context(m.select("qid", "match_no", "node_id"), nodes)


_VERB = "case predicate " + " ".join(f"when '{r}' then '{v}'" for r, v in RELATION_VERBS.items()) + " else predicate end"
_LAY = [
    "case predicate " + " ".join(f"when '{r}' then {v[i]}" for r, v in LAYER_RANGES.items()) + f" else {(0, 7)[i]} end" for i in (0, 1)
]


@query(
    "kg_compile_items", "G12,G13",
    f"""with {TRIPLES}, ats as (select src, triple_id, min([rord, eord]) as p from eo group by 1, 2),
    num as (select *, row_number() over (partition by src order by p) - 1 as no from ats)
    select 'anchor_' || substr(replace(replace(name, '/', '_'), ' ', '_'), 1, 30) as item_id, name as entity_name, 'subject_anchor' as item_type, name as text, '' as relation, 0 as layer_start, 3 as layer_end, null as triple_id from nodes
    union all select 'triple_' || substr(replace(replace(name, '/', '_'), ' ', '_'), 1, 30) || '_' || no, name, 'triple',
      rtrim(substr(subject || ' ' || {_VERB} || ' ' || object, 1, 45)), predicate, {_LAY[0]}, {_LAY[1]}, triple_id
    from num join nodes on node_id = src join tr using (triple_id)""",
)
def q_items(spark, d):
    return G.compile_items(*kg_tables(spark, d))


@query(
    "kg_select_items", "G14,J13,V10",
    f"""with {TRIPLES} select s_suppkey as qid, 'anchor_' || replace(s_name, ' ', '_') as item_id, 'subject_anchor' as item_type, 0 as layer_start, 3 as layer_end from supplier
    union all select s_suppkey, 'triple_' || replace(s_name, ' ', '_') || '_0', 'triple', 4, 11 from supplier join tr on subject = s_name and predicate = 'located_in'""",
)
def q_select(spark, d):
    t, nodes, edges = kg_tables(spark, d)
    items = G.compile_items(t, nodes, edges)
    qs = supplier_questions(spark, d)
    m = G.recognise(qs, G.entity_index(nodes)).join(nodes.select("node_id", F.col("name").alias("entity_name")).hint("merge"), "node_id")
    ev = G.retrieve(qs, t, nodes, edges, max_hops=1).where("hop > 0").select("qid", "triple_id")
    return G.select_items(items, m.select("qid", "entity_name"), ev).select("qid", "item_id", "item_type", "layer_start", "layer_end")


@query(
    "kg_layer_plan", "V10,G12",
    f"""with {TRIPLES}, i as (select {_LAY[0]} as a, {_LAY[1]} as b, count(*) as n from tr group by all)
    select layer::int as layer, sum(n)::bigint as items from i, range(0, 32) t(layer) where layer between a and b group by layer""",
)
def q_layers(spark, d):
    """Items active per layer: the range join runs on the few distinct layer ranges."""
    t = kg_triples(spark, d)
    lo, hi = G._layer(F.col("predicate"), 0), G._layer(F.col("predicate"), 1)
    per = t.groupBy(lo.alias("a"), hi.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return per.select(F.explode(F.sequence("a", "b")).alias("layer"), "n").groupBy("layer").agg(F.sum("n").alias("items"))


_TOKENS = f"len(regexp_extract_all(text, '[A-Za-z0-9]+|[{S.CJK}]'))"


@query(
    "kg_layer_prefix", "V10,G14",
    f"""with {TRIPLES}, ats as (select src, triple_id, min([rord, eord]) as p from eo group by 1, 2),
    num as (select *, row_number() over (partition by src order by p) - 1 as no from ats),
    it as (select s_suppkey as qid, 'anchor_' || replace(s_name, ' ', '_') as item_id, -1 as ord, s_name as text, 0 as layer_start, 3 as layer_end from supplier join nodes on name = s_name
      union all select s_suppkey, 'triple_' || replace(s_name, ' ', '_') || '_' || no, no, rtrim(substr(subject || ' ' || {_VERB} || ' ' || object, 1, 45)), {_LAY[0]}, {_LAY[1]}
      from supplier join nodes on name = s_name join num on src = node_id join tr using (triple_id)),
    held as (select qid, layer::int as layer, item_id, ord, {_TOKENS} as len from it, range(0, 32) t(layer) where layer between layer_start and layer_end),
    place as (select *, sum(len) over (partition by qid, layer order by ord) - len as before from held),
    w as (select qid, max(filled) as width from (select qid, layer, sum(len) as filled from held group by 1, 2) group by 1 having max(filled) > 0),
    al as (select qid, width, t.layer::int as layer, width - coalesce((select sum(len) from held h where h.qid = w.qid and h.layer = t.layer), 0) as pad from w, range(0, 32) t(layer))
    select al.qid, al.layer, item_id, (pad + before)::bigint as start, len::bigint as len, pad::bigint as pad, width::bigint as width from al left join place on place.qid = al.qid and place.layer = al.layer""",
)
def q_prefix(spark, d):
    """Layout of the prefix of each supplier's question over 32 layers: its anchor, then all triples at its node."""
    t, nodes, edges = kg_tables(spark, d)
    items = G.compile_items(t, nodes, edges)
    matched = table(spark, d, "supplier").select(F.col("s_suppkey").alias("qid"), F.col("s_name").alias("entity_name"))
    allowed = matched.join(t.select(F.col("subject").alias("entity_name"), "triple_id"), "entity_name").select("qid", "triple_id")
    mine = G.select_items(items, matched, allowed)
    no = F.when(F.col("item_type") == "triple", F.regexp_extract("item_id", r"_([0-9]+)$", 1).cast("int")).otherwise(-1)
    return G.layer_prefix(mine.withColumns({"ord": no, "len": T.approx_token_count(F.col("text"))}), "qid", 32)


@query(
    "alias_merge", "G02,G03,T11",
    f"""with {TRIPLES}, al as (select n_name as alias, 'NATION_' || n_regionkey as canonical from nation),
    mv as (select alias as name, canonical as moved from al where alias <> canonical)
    select coalesce(a.moved, subject) as subject_or_nation, predicate, coalesce(b.moved, object) as object, count(*) as n
    from (select case when predicate = 'part_of' then subject else '-' end as subject, predicate, object from tr) t left join mv a on a.name = subject left join mv b on b.name = object group by all""",
)
def q_alias(spark, d):
    nat = table(spark, d, "nation")
    aliases = nat.select(
        F.concat(F.lit("NATION_"), F.col("n_regionkey").cast("string")).alias("canonical"), F.col("n_name").alias("alias"), F.col("n_nationkey").cast("bigint").alias("ord")
    )
    _, _, t = G.merge_aliases(kg_triples(spark, d), aliases)
    subj = F.when(F.col("predicate") == "part_of", F.col("subject")).otherwise("-")
    return t.groupBy(subj.alias("subject_or_nation"), "predicate", "object").agg(F.count(F.lit(1)).alias("n"))


@query(
    "alias_entities", "G02,G03",
    f"""with {TRIPLES}, al as (select n_name as alias, 'NATION_' || n_regionkey as canonical from nation),
    fold as (select canonical as name, string_agg(alias, ',' order by alias) as aliases from (select *, row_number() over (partition by canonical order by alias) as n from al where alias <> canonical) where n <= 3 group by 1)
    select e.name, entity_type, coalesce(aliases, '') as aliases from ent e left join fold using (name) where e.name not in (select alias from al where alias <> canonical)""",
)
def q_alias_entities(spark, d):
    nat = table(spark, d, "nation")
    aliases = nat.select(
        F.concat(F.lit("NATION_"), F.col("n_regionkey").cast("string")).alias("canonical"), F.col("n_name").alias("alias"), F.col("n_nationkey").cast("bigint").alias("ord")
    )
    ents, absorbed, _ = G.merge_aliases(kg_triples(spark, d), aliases)
    shown = ents.join(G.display_aliases(absorbed), "name", "left")
    return shown.select("name", "entity_type", F.coalesce(F.array_join("aliases", ","), F.lit("")).alias("aliases"))


_HITS = {
    i: " + ".join(f"contains(lower(text), {S.sql_str(w.lower())})::int" for w in ws) for i, ws in INTENT_KEYWORDS.items()
}
_WORDS = [*(w for ws in INTENT_KEYWORDS.values() for w in ws), ""]
_BEST = ", ".join(f"[{h}, {-n}]" for n, h in enumerate(_HITS.values()))


@query(
    "intent_classify", "G09",
    f"""select intent, count(*) as n from (select case when b[1] = 0 then '' else list_extract([{", ".join(f"'{i}'" for i in INTENT_KEYWORDS)}], (1 - b[2])::int) end as intent
    from (select greatest({_BEST}) as b from (select ([{", ".join(S.sql_str(w) for w in _WORDS)}])[doc_id % {len(_WORDS)} + 1] || ' ' || text as text from documents))) group by intent""",
)
def q_intent(spark, d):
    """Documents with one of the keywords (the last: none) in front, by id."""
    word = F.get(F.array(*[F.lit(w) for w in _WORDS]), (F.col("doc_id") % len(_WORDS)).cast("int"))
    text = F.concat(word, F.lit(" "), "text")
    return documents(spark, d).groupBy(G.classify_intent(text).alias("intent")).agg(F.count(F.lit(1)).alias("n"))
