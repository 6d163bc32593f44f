"""Source, sink and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import table_marker_ids
from ..operators import chunking as K, graph as G
from ..registry import query
from ..session import spread
from ..sources import bank as B, jsonl as J, pages as P
from ..sources.tables import table, table_path
from ..streaming import logs as L
from . import sqlparts as S
from .graph import TRIPLES, kg_tables


def pages(spark, d):
    return spread(table(spark, d, "pages").select("page_id", "url", "html"), "page_id")


_ENT = "x"
for _a, _b in P.ENTITIES:
    _ENT = f"replace({_ENT}, {S.sql_str(_a)}, {S.sql_str(_b)})"
_BLOCK = r"(?i)<(br|p|div|h[1-6]|li|tr|ul|ol|table|article|nav|title|head|body|html|header|footer|section)\b[^>]*>"
HTML_TEXT = rf"""array_to_string(list_filter(list_transform(string_split({_ENT.replace('x', "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)" + chr(92) + "b.*?</(script|style)>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '" + _BLOCK + "', chr(10), 'g'), '<[^>]*>', '', 'g')", 1)}, chr(10)), lambda l: {S.squash('l')}), lambda l: l <> ''), chr(10))"""


@query(
    "html_text", "S07,S10",
    f"select page_id, md5(t) as text_md5, length(t)::int as n_chars from (select page_id, {HTML_TEXT} as t from pages)",
)
def html_text(spark, d):
    t = pages(spark, d).select("page_id", P.html_text(F.col("html")).alias("t"))
    return t.select("page_id", F.md5("t").alias("text_md5"), F.length("t").alias("n_chars"))


@query(
    "page_chunks", "S06,S07,K06,C06,C09",
    f"""with p as (select page_id, coalesce(regexp_extract(url, '//([^/]+)/', 1), '') || '-' || (page_id // 64) as doc_id, {HTML_TEXT} as t from pages),
    n as (select doc_id, row_number() over (partition by doc_id order by page_id)::int as page_no, {S.strip('t')} as t from p),
    w as (select doc_id, page_no, {S.words('t')} as w from n where length(t) >= 50),
    s as (select *, unnest(range(0, len(w), 297)) as s from w),
    c as (select doc_id, page_no, (s // 297)::int as chunk_no, array_to_string(w[s + 1:s + 350], ' ') as t from s where s = 0 or s - 297 + 350 < len(w)),
    h as (select *, sha256(t) as h from c)
    select doc_id, doc_id || '_p' || page_no || '_c' || chunk_no as chunk_id, page_no, chunk_no, case when regexp_matches(t, '[{S.CJK}]') then 'zh' else 'en' end as lang,
    concat(h[15:16],h[13:14],h[11:12],h[9:10],h[7:8],h[5:6],h[3:4],h[1:2]) as dedupe_hash, length(t) as n_chars from h""",
)
def page_chunks(spark, d):
    """Pages of a host (64 ids a document) written to document files, read back and chunked page by page."""
    host = F.coalesce(F.regexp_extract("url", "//([^/]+)/", 1), F.lit(""))
    doc = F.concat(host, F.lit("-"), F.expr("page_id div 64").cast("string"))
    path = B.scratch_path(spark, "files")
    P.write_page_bundles(table(spark, d, "pages").select("page_id", "html", doc.alias("doc")), "doc", "page_id", "html", path)
    files = P.read_page_bundles(spark, path).where("error is null")
    out = K.page_chunks(files.withColumn("text", P.html_text(F.col("text"))))
    return out.select("doc_id", "chunk_id", "page_no", "chunk_no", "lang", "dedupe_hash", F.length("text").cast("bigint").alias("n_chars"))


@query("html_tables", "S09,S10,K07")
def html_tables(spark, d):
    """Navigation lists are read as two-column tables next to real ones."""
    nav = F.regexp_replace(F.regexp_replace("html", "(?i)<ul>", "<table><tr><th>entry</th><th>link</th></tr>"), "(?i)</ul>", "</table>")
    nav = F.regexp_replace(nav, r"(?is)<li>\s*<a[^>]*>(.*?)</a>\s*</li>", "<tr><td>$1</td><td>a</td></tr>")
    m = pages(spark, d).select("page_id", P.tables_to_markdown(P.html_tables(nav)).alias("m"))
    ids = table_marker_ids(F.col("m.markdown"))
    return m.select(
        "page_id", F.size("m.metas").alias("n_tables"), F.length("m.markdown").alias("n_chars"), F.size(P.tables_of_chunk(ids, F.col("m.metas"))).alias("n_linked"),
        F.array_join(F.transform("m.metas", lambda x: x["header_hash"]), ",").alias("hashes"),
    )


@query(
    "scanned_documents", "S08",
    f"""select regexp_extract(url, '//([^/]+)/', 1) as host, round(avg(length(t)), 6) as avg_chars, sum(length(t))::bigint as total_chars, (avg(length(t)) < 50 or sum(length(t)) < 500) as needs_ocr
    from (select url, {HTML_TEXT} as t from pages) group by 1""",
)
def scanned_documents(spark, d):
    p = pages(spark, d).select(F.regexp_extract("url", "//([^/]+)/", 1).alias("host"), P.html_text(F.col("html")).alias("t"))
    out = P.scanned_documents(p, "host", "t")
    return out.select("host", F.round("avg_chars", 6).alias("avg_chars"), "total_chars", "needs_ocr")


@query(
    "bank_roundtrip", "S11,S12,S13,S14,U09",
    "select label >= 8 as is_table, count(*) as n_items, 64 as dim from embeddings group by 1",
)
def bank_roundtrip(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("rid"), F.col("embedding").alias("item"), (F.col("label") >= 8).alias("is_table"))
    path = B.scratch_path(spark, "bank")
    B.save_bank(e, path)
    return B.manifest(B.load_bank(spark, path))


@query(
    "jsonl_roundtrip", "S02,S22",
    "select event_type, count(*) as n, count(distinct user_id) as users from events where user_id <> 0 group by 1",
)
def jsonl_roundtrip(spark, d):
    """Events written as JSON lines and read back tolerantly; rows without a usable id are skipped."""
    e = table(spark, d, "events").select(
        F.when(F.col("user_id") != 0, F.col("event_id").cast("string")).otherwise("").alias("id"), "user_id", "event_type"
    )
    path = B.scratch_path(spark, "events")
    J.replace_table(e, path)
    rows, _ = J.read_tolerant(spark, path, e.schema, F.col("id"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query(
    "read_counters", "S02",
    """select count(*) as "read", sum((user_id <> 0)::int)::bigint as parsed, sum((user_id = 0)::int)::bigint as skipped, 0::bigint as errors from events""",
)
def read_counters(spark, d):
    e = table(spark, d, "events").select(F.when(F.col("user_id") != 0, F.col("event_id").cast("string")).otherwise("").alias("id"), "user_id")
    path = B.scratch_path(spark, "counters")
    J.replace_table(e, path)
    return J.read_tolerant(spark, path, e.schema, F.col("id"))[1]


@query(
    "chunk_store", "S04,S05",
    "select doc_id::varchar as doc_id, lang, md5(text) as text_md5, source as extra_origin from documents where trim(text) <> ''",
)
def chunk_store(spark, d):
    docs = table(spark, d, "documents").where(F.trim("text") != "")
    c = docs.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("source").alias("source_uri"),
        F.lit("web").alias("source_type"), "text", F.lit("v1").alias("dataset_version"), "lang", F.col("source").alias("origin"),
    )
    path = B.scratch_path(spark, "chunks")
    J.write_chunks(c, path)
    r = J.read_chunks(spark, path)
    return r.select("doc_id", "lang", F.md5("text").alias("text_md5"), F.col("extra")["origin"].alias("extra_origin"))


@query(
    "graph_store", "S15",
    f"""with {TRIPLES} select 'nodes' as part, count(*) as n from nodes union all select 'edges', count(*) from edges
    union all select 'entity_index', count(distinct lower(name)) from nodes union all select 'sentence_index', count(distinct triple_id) from tr""",
)
def graph_store(spark, d):
    t, nodes, edges = kg_tables(spark, d)
    path = B.scratch_path(spark, "graph")
    B.save_graph({"nodes": nodes, "edges": edges, "entity_index": G.entity_index(nodes), "sentence_index": G.sentence_index(t)}, path)
    parts = B.load_graph(spark, path, "nodes", "edges", "entity_index", "sentence_index")
    out = None
    for n, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "append_stream", "S21,ST1",
    "select event_type, count(*) as n, round(sum(value), 4) as total from events group by 1",
)
def append_stream(spark, d):
    schema = table(spark, d, "events").schema
    out, ck = L.run_paths(spark, "log")
    L.append_log(L.file_stream(spark, table_path(d, "events"), schema), out, ck)
    back = spark.read.schema(schema).json(out)
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "import_stream", "ST2,J11",
    "select event_type, count(distinct user_id) as users from events group by 1",
)
def import_stream(spark, d):
    schema = table(spark, d, "events").schema
    out, ck = L.run_paths(spark, "import")
    s = L.file_stream(spark, table_path(d, "events"), schema).select("user_id", "event_type")
    L.import_once(s, ["user_id", "event_type"], out, ck)
    return spark.read.schema("user_id bigint, event_type string").parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("users"))


@query(
    "resumable_log", "ST3",
    "select conv_id, turn from conversations where conv_id >= (select max(conv_id) // 2 from conversations)",
)
def resumable_log(spark, d):
    """The stored half of the conversations is skipped, the rest is still to run."""
    c = table(spark, d, "conversations").select("conv_id", "turn").withColumn("id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    from ..operators.ranking import global_position

    ex = global_position(c, "conv_id", "turn", name="ord")
    half = c.agg(F.floor(F.max("conv_id") / 2).alias("h"))
    stored = c.join(F.broadcast(half), F.col("conv_id") < F.col("h")).select("id")
    return L.resume(ex, stored).select("conv_id", "turn")
