"""Text search and relevance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..registry import query
from ..sources.tables import documents, table
from . import sqlparts as S


def bench_queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


@query(
    "text_search_topk", "Q13,Q14,W01,J17",
    f"""with q as (select item_id, {S.overlap_tokens('text')} as qt from benchmark),
    qx as (select item_id, len(qt)::bigint as nq, unnest(qt) as tok from q),
    dx as (select doc_id, unnest({S.overlap_tokens('text')}) as tok from documents),
    o as (select item_id, nq, doc_id, count(*) as overlap from qx join dx using (tok) group by all),
    r as (select *, row_number() over (partition by item_id order by overlap desc, doc_id)::int as rank from o where overlap * 100 >= nq * 5)
    select item_id, rank, doc_id, overlap, nq as n_query_tokens from r where rank <= 3""",
)
def text_search_topk(spark, d):
    out = R.text_search(bench_queries(spark, d), documents(spark, d), k=3, min_pct=5)
    return out.withColumnRenamed("qid", "item_id")
