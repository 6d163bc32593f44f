"""Queries over cleaning, chunking and de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rows import explode_rows
from ..operators import chunking as K
from ..operators import dedupe as D
from ..registry import query
from ..sources.tables import documents, table
from . import sqlparts as S

NORM = S.normalize("text")


@query(
    "doc_normalize", "C01,T01,T02",
    f"select doc_id, md5(t) as norm_md5, length(t)::int as norm_len from (select doc_id, {NORM} as t from documents)",
)
def doc_normalize(spark, d):
    t = T.normalize_text(F.col("text"))
    return documents(spark, d).select("doc_id", t.alias("t")).select(
        "doc_id", F.md5("t").alias("norm_md5"), F.length("t").alias("norm_len")
    )


@query(
    "doc_lang_detect", "C05,C06",
    f"""select lang, case when regexp_matches(text,'[{S.KANA}]') then 'ja' when regexp_matches(text,'[{S.CJK}]') then 'zh' else 'en' end as detected,
    case when regexp_matches(text,'[{S.CJK}]') then 'zh' else 'en' end as detected_two_way, count(*) as n
    from documents group by all""",
)
def doc_lang_detect(spark, d):
    return (
        documents(spark, d, "text", "lang")
        .groupBy(
            "lang", T.detect_lang(F.col("text")).alias("detected"),
            T.detect_lang_two_way(F.col("text")).alias("detected_two_way"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "doc_quality_score", "C11,T03",
    f"""select doc_id, case when length(t) < 50 then 0.0 when {S.has_run('cs', 9)} then 0.2 else 1.0 end::double as quality
    from (select doc_id, t, string_split(t, '') as cs from (select doc_id, {NORM} as t from documents))""",
)
def doc_quality_score(spark, d):
    return documents(spark, d).select("doc_id", T.quality_score(F.col("text")).alias("quality"))


@query(
    "chunk_filter", "K11,T17",
    """select doc_id, d.lang, l.quality from documents d left join labels l using (doc_id)
    where (l.quality is null or l.quality >= 1) and (d.lang is null or d.lang in ('en','de')) and d.source in ('src0','src1','src2','src3')""",
)
def chunk_filter(spark, d):
    from ..operators.filters import filter_chunks

    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    rows = docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    out = filter_chunks(
        rows, langs=["en", "de"], min_quality=1, source_types=["src0", "src1", "src2", "src3"], source_col="source"
    )
    return out.select("doc_id", "lang", "quality")


_PARAS = f"""list_filter(list_transform(string_split_regex(text, {S.sql_str(f'{chr(92)}n[{S.WS}]*{chr(92)}n')}), lambda p: {S.strip('p')}), lambda p: length(p) >= 30)"""


@query(
    "scalar_signals", "C12,C13,C14,C15,C16,C17,C18,S10",
    rf"""select doc_id, nullif(regexp_extract(text, '(?:^|[^{S.WORD}])(19\d{{2}}|20\d{{2}})(?:[^{S.WORD}]|$)', 1), '') as year,
    case when contains(lower(text),'sfts') then 'SFTS' when contains(lower(text),'severe fever with thrombocytopenia') then 'severe fever with thrombocytopenia'
      when contains(text,'传染病') then '传染病' when contains(text,'流感') then '流感' when contains(lower(text),'covid') then 'COVID' when contains(lower(text),'sars') then 'SARS' end as disease,
    case when contains(h,'abstract') then 'abstract' when contains(h,'introduction') then 'introduction' when contains(h,'method') then 'methods'
      when contains(h,'result') then 'results' when contains(h,'conclusion') then 'conclusion' else 'paragraph' end as para_type,
    array_to_string(list_transform(list_transform({_PARAS}, lambda p: substr(lower(p), 1, 200)), lambda h: case when contains(h,'abstract') then 'abstract' when contains(h,'introduction') then 'introduction'
      when contains(h,'method') then 'methods' when contains(h,'result') then 'results' when contains(h,'conclusion') then 'conclusion' else 'paragraph' end), ',') as para_types,
    len(regexp_extract_all(t, '[A-Za-z0-9]+|[{S.CJK}]', 0))::int as approx_tokens,
    round(length(regexp_replace(t, '[\x20-\x7e{S.CJK}\n\r\t]', '', 'g')) / greatest(1, length(t)), 6) as nonprintable,
    (regexp_matches(text, '(?i)<\s*!\s*-\s*-\s*table\s*:\s*\d+\s*-\s*-\s*>') or length(text) - length(replace(text, '|', '')) >= 8) as is_table,
    (contains(text, '<!-- table:') or (regexp_matches(text, '(?m)^\s*\|.+\|\s*$') and regexp_matches(text, '(?m)^\s*\|\s*---'))) as md_table,
    coalesce(array_to_string(regexp_extract_all(text, '(?i)<\s*!\s*-\s*-\s*table\s*:\s*(\d+)\s*-\s*-\s*>', 1), ','), '') as table_ids
    from (select doc_id, text, {NORM} as t, substr(lower(text), 1, 200) as h from documents)""",
)
def scalar_signals(spark, d):
    c = F.col("text")
    return documents(spark, d).withColumn("t", T.normalize_text(c)).select(
        "doc_id",
        T.extract_year(c).alias("year"),
        T.disease_tag(c).alias("disease"),
        T.paragraph_type(c).alias("para_type"),
        F.array_join(F.transform(T.paragraphs(c), T.paragraph_type), ",").alias("para_types"),
        T.approx_token_count(F.col("t")).alias("approx_tokens"),
        F.round(T.nonprintable_ratio(F.col("t")), 6).alias("nonprintable"),
        T.is_table_text(c).alias("is_table"),
        T.looks_like_markdown_table(c).alias("md_table"),
        F.array_join(T.table_marker_ids(c).cast("array<string>"), ",").alias("table_ids"),
    )


@query(
    "content_keys", "C09,C30,C31,C34",
    """select doc_id, concat(h[15:16],h[13:14],h[11:12],h[9:10],h[7:8],h[5:6],h[3:4],h[1:2]) as exact_key,
    'd_' || substr(sha256(concat_ws('|', doc_id::varchar, coalesce(source,''), coalesce(lang,''))),1,16) as doc_key,
    'ev_' || substr(sha1(concat_ws('|', doc_id::varchar, text)),1,12) as evidence_key,
    (length(text) // 2)::bigint as fallback_tokens,
    case when text = '' then 0.0 when regexp_matches(text, 'https?://|www\\.') then -0.6 when length(text) < 8 then -0.4 when length(text) > 240 then -0.2 else 0.2 end::double as bonus
    from (select *, sha256(text) as h from documents)""".replace("\\\\", "\\"),
)
def content_keys(spark, d):
    c = F.col("text")
    return documents(spark, d, "text", "source", "lang").select(
        "doc_id",
        T.content_key(c).alias("exact_key"),
        T.stable_id("d_", F.col("doc_id"), F.col("source"), F.col("lang")).alias("doc_key"),
        T.stable_id("ev_", F.col("doc_id"), c, algo="sha1", width=12).alias("evidence_key"),
        T.token_len_fallback(c).alias("fallback_tokens"),
        T.text_quality_bonus(c).alias("bonus"),
    )


@query(
    "paragraphs", "C04",
    f"""select doc_id, (i - 1)::int as para_no, md5(ps[i]) as para_md5, length(ps[i])::int as para_len
    from (select doc_id, ps, unnest(range(1, len(ps) + 1)) as i from (select doc_id, {_PARAS} as ps from documents))""",
)
def paragraphs(spark, d):
    ps = explode_rows(documents(spark, d), ["doc_id"], T.paragraphs(F.col("text")), "para_no", "p")
    return ps.select("doc_id", "para_no", F.md5("p").alias("para_md5"), F.length("p").alias("para_len"))


@query("clean_text", "C02,C03")
def clean_text(spark, d):
    t = documents(spark, d).select("doc_id", T.clean_noise(F.col("text")).alias("t"))
    return t.select("doc_id", F.md5("t").alias("clean_md5"), F.length("t").alias("clean_len"))


def _windows_sql(size: int, overlap: int, drop: str) -> str:
    step = size - overlap
    return f"""select doc_id, row_number() over (partition by doc_id order by s)::int - 1 as chunk_no, s::int as start,
    least(n, s + {size})::int as "end", md5(array_to_string(ws[s+1:s+{size}], ' ')) as chunk_md5
    from (select doc_id, ws, len(ws) as n, unnest(range(0, len(ws), {step})) as s from (select doc_id, {S.words('text')} as ws from documents))
    where {drop}"""


def _hashed(df):
    return df.select("doc_id", "chunk_no", "start", "end", F.md5("text").alias("chunk_md5"))


@query("word_chunks", "K03", _windows_sql(350, 53, "(s = 0 or s - 297 + 350 < n)"))
def word_chunks(spark, d):
    return _hashed(K.explode_windows(documents(spark, d), K.word_chunks(F.col("text")), ["doc_id"], "chunk"))


@query("token_windows", "K01,K02", _windows_sql(256, 64, "(s = 0 or s - 192 + 256 < n)"))
def token_windows(spark, d):
    wins = K.windows(K.words(F.col("text")), 256, 64)
    return _hashed(K.explode_windows(documents(spark, d), wins, ["doc_id"], "chunk"))


@query("block_windows_all", "K04,T16", _windows_sql(256, 64, "true"))
def block_windows_all(spark, d):
    wins = K.strided_blocks(K.words(F.col("text")), 256, 192, drop_last_incomplete=False)
    return _hashed(K.explode_windows(documents(spark, d), wins, ["doc_id"], "chunk"))


@query("block_windows_full", "K04", _windows_sql(256, 64, "s + 256 <= n"))
def block_windows_full(spark, d):
    wins = K.strided_blocks(K.words(F.col("text")), 256, 192)
    return _hashed(K.explode_windows(documents(spark, d), wins, ["doc_id"], "chunk"))


@query(
    "two_level_blocks", "K05",
    f"""select doc_id, (s // 200)::int as chunk_no, ((s % 200) // 60)::int as block_no, s::int as start, least(n, s + 60, (s // 200 + 1) * 200)::int as "end",
    doc_id || ':' || s as block_id, md5(array_to_string(ws[s+1:least(s+60, (s//200+1)*200)], ' ')) as block_md5
    from (select doc_id, ws, len(ws) as n, unnest(list_filter(range(0, len(ws), 20), lambda x: (x % 200) % 60 = 0)) as s from (select doc_id, {S.words('text')} as ws from documents))""",
)
def two_level_blocks(spark, d):
    b = K.two_level_blocks(documents(spark, d), K.words(F.col("text")), ["doc_id"], 200, 60)
    return b.select("doc_id", "chunk_no", "block_no", "start", "end", "block_id", F.md5("text").alias("block_md5"))


@query(
    "doc_exact_dedupe", "A01,C31",
    f"select min(doc_id) as doc_id, sha256({NORM}) as text_sha, count(*) as copies from documents group by 2",
)
def doc_exact_dedupe(spark, d):
    h = documents(spark, d).select("doc_id", F.sha2(T.normalize_text(F.col("text")), 256).alias("text_sha"))
    return h.groupBy("text_sha").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def _simhash_sql(id_col: str, text: str, src: str) -> str:
    bits = ", ".join(
        f"sum(case when (('0x' || substr(h,{2 * j + 1},2))::int >> {b}) & 1 = 1 then 1 else -1 end) as v_{j}_{b}"
        for j in range(8) for b in range(8)
    )
    hexes = " || ".join(
        "lower(lpad(hex(" + " + ".join(f"(case when v_{j}_{b} > 0 then {1 << b} else 0 end)" for b in range(8)) + "), 2, '0'))"
        for j in range(8)
    )
    return f"""select {id_col}, {hexes} as fp from (select {id_col}, {bits} from
      (select {id_col}, md5(unnest({S.hash_tokens(text)})) as h from {src}) group by {id_col})
      union all select {id_col}, substr(sha256({text}),1,16) from {src} where len({S.hash_tokens(text)}) = 0"""


SIMHASH = _simhash_sql("doc_id", "t", f"(select doc_id, {NORM} as t from documents)")


def doc_fps(spark, d):
    t = documents(spark, d).select("doc_id", T.normalize_text(F.col("text")).alias("t"))
    return D.simhash(t, "doc_id", "t")


@query("doc_simhash", "C07,C08", SIMHASH)
def doc_simhash(spark, d):
    return doc_fps(spark, d)


@query(
    "dedupe_stats", "A01,A03",
    f"select count(*) as total_in, count(distinct fp) as total_out, count(*) - count(distinct fp) as duplicates from ({SIMHASH})",
)
def dedupe_stats(spark, d):
    per = doc_fps(spark, d).groupBy("fp").agg(F.count(F.lit(1)).alias("m"))
    return per.agg(
        F.sum("m").alias("total_in"), F.count(F.lit(1)).alias("total_out"),
        (F.sum("m") - F.count(F.lit(1))).alias("duplicates"),
    )


@query(
    "near_dup_pairs", "C10,A02",
    f"""with r as (select fp, min(doc_id) as ord from ({SIMHASH}) group by fp),
    x as (select ord, ('0x' || fp)::ubigint as v from r)
    select a.ord as a, b.ord as b, bit_count(xor(a.v, b.v))::int as dist from x a join x b on a.ord < b.ord where bit_count(xor(a.v, b.v)) <= 3""",
)
def near_dup_pairs(spark, d):
    reps = doc_fps(spark, d).groupBy("fp").agg(F.min("doc_id").alias("ord"))
    return D.near_pairs(reps.select("ord", T.hex_to_bigint(F.col("fp")).alias("fp")))


@query(
    "doc_near_dedupe", "A02,A03,T06",
    f"""with recursive s as materialized ({SIMHASH}), r as materialized (select fp, min(doc_id) as ord, ('0x' || fp)::ubigint as v from s group by fp),
    p as materialized (select a.ord as a, b.ord as b from r a join r b on a.ord < b.ord where bit_count(xor(a.v, b.v)) <= 3),
    e as materialized (select b, list(a) as near, row_number() over (order by b) as i from p group by b),
    g as (select 0::bigint as i, []::bigint[] as gone union all
      select e.i, case when len(list_filter(e.near, lambda x: not list_contains(g.gone, x))) > 0 then list_append(g.gone, e.b) else g.gone end from g join e on e.i = g.i + 1),
    dropped as (select unnest(arg_max(gone, i)) as ord from g)
    select s.doc_id, s.fp, case when r.ord <> s.doc_id then 'exact_dup' when d.ord is not null then 'near_dup' else 'kept' end as status
    from s join r using (fp) left join dropped d on d.ord = s.doc_id""",
)
def doc_near_dedupe(spark, d):
    out = D.near_dedupe(doc_fps(spark, d).withColumnRenamed("doc_id", "ord"))
    return out.select(F.col("ord").alias("doc_id"), "fp", "status")
