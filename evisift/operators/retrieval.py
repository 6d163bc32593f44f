"""Batched retrieval over a queries table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import overlap_tokens
from ..functions.rows import explode_rows
from .topk import TokenOverlap, top_k


def text_search(queries: DataFrame, docs: DataFrame, k: int = 10, min_pct: int = 5, **kw) -> DataFrame:
    """Q14: ``queries(qid, text)`` against ``docs(doc_id, text)``.

    Score is shared tokens over query tokens; the threshold is tested in integers
    (``overlap * 100 >= n_query_tokens * min_pct``), rank is per query. Because the
    denominator is constant within a query, overlap alone orders the candidates.
    """
    q = queries.select("qid", overlap_tokens(F.col("text")).alias("item")).where(F.size("item") > 0)
    d = docs.select(F.col("doc_id").alias("rid"), overlap_tokens(F.col("text")).alias("item"))
    hits = top_k(q, d, TokenOverlap, k, min_score=1, options={"min_pct": min_pct}, **kw)
    sizes = q.select("qid", F.size("item").cast("bigint").alias("n_query_tokens"))
    return (
        hits.join(sizes, "qid")
        .where(F.col("score") * 100 >= F.col("n_query_tokens") * min_pct)
        .select(
            "qid", "rank", F.col("rid").alias("doc_id"), F.col("score").alias("overlap"), "n_query_tokens"
        )
    )


def relevance(query: Column, evidence: Column) -> Column:
    """Q13 score: share of query tokens found in the evidence; 0 when either is empty."""
    q, e = overlap_tokens(query), overlap_tokens(evidence)
    return F.when((F.size(q) == 0) | (F.size(e) == 0), 0.0).otherwise(F.size(F.array_intersect(q, e)) / F.size(q))


def answer_tokens(c: Column) -> Column:
    """Lower-case alphanumeric runs of two or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{2,}"), F.lit(0)))


def weak_oracle(golds: DataFrame, sentences: DataFrame, k: int = 3, min_score: float = 0.18) -> DataFrame:
    """Sentences sharing the largest part of a gold's tokens, best k per gold."""
    from .topk import ShareOfRowTokens

    g = golds.select("qid", answer_tokens(F.col("text")).alias("item")).where(F.size("item") > 0)
    s = sentences.select("rid", answer_tokens(F.col("text")).alias("item"))
    return top_k(g, s, ShareOfRowTokens, k, min_score=min_score)


def char_shingles(c: Column, k: int = 3) -> Column:
    """Q18: distinct character k-grams of the text without whitespace, in no particular order; a shorter text is its own shingle.

    Cut out of the text in ``k`` passes, one for each place modulo ``k``; growing them by a character at a time makes every gram ``k`` times.
    """
    from ..functions.chars import WS_FAST
    from ..functions.text import bind

    def grams(t: Column) -> Column:
        every = F.concat(*[F.regexp_extract_all(F.substring(t, F.lit(i + 1), F.length(t)), F.lit(f"(?s).{{{k}}}"), F.lit(0)) for i in range(k)])
        one = F.when(t == "", F.array().cast("array<string>")).otherwise(F.array(t))
        return F.when(F.length(t) < k, one).otherwise(F.array_distinct(every))

    return bind(F.regexp_replace(c, f"[{WS_FAST}]+", ""), grams)


def best_shingle_match(texts: DataFrame, evidence: DataFrame, k: int = 1, **kw) -> DataFrame:
    """Q18: for each text the evidence row with the highest overlap score."""
    from .topk import ShingleOverlap

    q = texts.select("qid", char_shingles(F.col("text")).alias("item")).where(F.size("item") > 0)
    e = evidence.select("rid", char_shingles(F.col("text")).alias("item"))
    return top_k(q, e, ShingleOverlap, k, min_score=1e-6, **kw)


def ground_sentences(sentences: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Q17: ``sentences(key, sid, text)`` against the token union of ``evidence(key, text)``.

    The union is a distinct (key, token) table, built by a partial aggregate; it meets
    the sentence tokens by equality and only counts travel on.
    """
    from ..functions.tokens import overlap_tokens

    st = sentences.select(key, "sid", overlap_tokens(F.col("text")).alias("toks"))
    et = explode_rows(evidence, [key], overlap_tokens(F.col("text")), "tok").distinct()
    hit = st.select(key, "sid", F.explode("toks").alias("tok")).join(et, [key, "tok"]).groupBy("sid").agg(F.count(F.lit(1)).alias("hit"))
    out = st.select(key, "sid", F.size("toks").cast("bigint").alias("n")).join(hit, "sid", "left")
    hit0 = F.coalesce("hit", F.lit(0))
    return out.select(key, "sid", "n", hit0.alias("hit"), ((F.col("n") > 0) & (hit0 * 10 >= F.col("n"))).alias("grounded"))


def grounding_filter(overlap: Column, sentence: Column, min_overlap: float = 0.1) -> Column:
    """Q18 verdict: keep, keep with a tag, or drop (null)."""
    short = F.length(F.regexp_replace(sentence, r"[\d.*#\-\s]+", "")) < 4
    return F.when(short | (overlap >= min_overlap), sentence).when(overlap > 0, F.concat(sentence, F.lit(" [ungrounded]")))


def clause_boost(sentence_len: Column, overlap: Column, best_clause: Column) -> Column:
    """Q18 fallback: a clause of a long, weak sentence with containment of 0.3 lifts the score."""
    return F.when(
        (sentence_len > 30) & (overlap < 0.15) & (best_clause >= 0.3), F.greatest(overlap, best_clause * 0.8)
    ).otherwise(overlap)


def answer_choice(cands: DataFrame, key: str) -> DataFrame:
    """Q19: (overlap, shorter text, method order) decides; columns ``overlap, n_chars, prio, ord, text``.

    Of candidates equal in all three the first offered (least ``ord``) stays, as a running maximum keeps it.
    """
    better = F.struct("overlap", (-F.col("n_chars")).alias("short"), (-F.col("prio")).alias("first"), (-F.col("ord")).alias("earlier"))
    return cands.groupBy(key).agg(F.max_by(F.struct("text", "prio"), better).alias("b")).select(key, "b.text", "b.prio")


def drug_id_key(pred: Column, support: Column) -> Column:
    """Q19 for identifier answers: (overlap, -length); no ids in the answer ranks below no overlap."""
    ids = F.transform(F.regexp_extract_all(pred, F.lit(r"(?i)DB\d+"), F.lit(0)), F.upper)
    sup = F.transform(F.regexp_extract_all(support, F.lit(r"(?i)DB\d+"), F.lit(0)), F.upper)
    short = -F.least(F.length(pred), F.lit(1_000_000))
    return F.when(F.size(sup) == 0, F.struct(F.lit(0).alias("overlap"), F.lit(0).alias("short"))).when(
        F.size(ids) == 0, F.struct(F.lit(-1).alias("overlap"), short.alias("short"))
    ).otherwise(F.struct(F.size(F.filter(ids, lambda i: F.array_contains(sup, i))).alias("overlap"), short.alias("short")))


def evidence_chain(pairs: DataFrame, threshold: float, budget: int, limit: int, max_cost: int = 64) -> DataFrame:
    """Q15/Q16: ``pairs(qid, question, doc_id, text)`` -> score, threshold, running budget, rank and limit.

    Costs are characters in hundreds, between 1 and ``max_cost``. The pool of a question comes from a top-k, so its window is small.
    """
    scored = pairs.select("qid", "doc_id", relevance(F.col("question"), F.col("text")).alias("score"), F.least(F.lit(max_cost), F.greatest(F.lit(1), F.expr("length(text) div 100"))).alias("cost"))
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "doc_id")
    used = F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = scored.where(F.col("score") >= threshold).withColumn("used", used).where(F.col("used") <= budget)
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")
