"""Counting, top-n, samples and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip


def top_values(df: DataFrame, key: str, value: str, order: list[str], k: int) -> DataFrame:
    """Values per key by count, ties by first appearance, the best k."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("_first"))
    w = Window.partitionBy(key).orderBy(F.col("n").desc(), "_first")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_first")


def hash_sample(df: DataFrame, id_col: str, k: int, seed: int = 0) -> DataFrame:
    """Reproducible sample of k rows, ordered by a seeded hash of the id."""
    h = F.xxhash64(F.col(id_col), F.lit(seed))
    return df.orderBy(h, id_col).limit(k)


def keyword_counts(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Rows matching each pattern, and rows matching any."""
    hits = {name: F.col(text).rlike("(?i)" + rx) for name, rx in patterns.items()}
    any_hit = F.lit(False)
    for h in hits.values():
        any_hit = any_hit | h
    named = F.array(*[F.when(h, F.lit(n)) for n, h in hits.items()], F.when(any_hit, F.lit("*any*")))
    return df.select(F.explode(F.array_compact(named)).alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


def contract_candidates(slots: DataFrame, col: str, min_count: int, order: list[str], k: int, prefix: str) -> DataFrame:
    """Values counted, at least ``min_count`` times, best k by count then first appearance."""
    c = slots.groupBy(col).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("_first")).where(F.col("n") >= min_count)
    top = c.orderBy(F.col("n").desc(), "_first").limit(k)
    return top.select(F.concat(F.lit(prefix), F.col(col)).alias("pattern_id"), "n")


def text_flags(c: Column) -> dict[str, Column]:
    """A23 flags."""
    return {
        "has_url": c.rlike("(?i)https?://"),
        "has_image_md": c.rlike(r"!\[[^\]]*\]\([^)]*\)"),
        "has_many_exclaim": F.length(c) - F.length(F.translate(c, "!", "")) >= 3,
        "is_too_short": F.length(strip(c)) < 16,
        "has_hedging": c.rlike(r"(?i)(?<![\p{L}\p{N}_])(?:generally|typically|usually|it is recommended|likely|possibly|in general)(?![\p{L}\p{N}_])"),
    }


def failure_class(available: Column, retrieved: Column, relevant: Column, prompted: Column) -> Column:
    """A22."""
    return (
        F.when(~available, "NO_ORACLE").when(~retrieved, "MISS_RETRIEVAL").when(~relevant, "MISS_DRM")
        .when(~prompted, "MISS_PROMPT").otherwise("HIT_PROMPT")
    )


def tertiles(df: DataFrame, value: str) -> DataFrame:
    """One row (n, q1, q2) with the values at sorted positions n//3 and 2n//3."""
    from .evalmetrics import order_statistic

    n = F.col("n")
    idx = {"q1": F.floor(n / 3), "q2": F.floor(n * 2 / 3)}
    return order_statistic(df, [], value, idx)


def protocol_score(key_points: Column, claims: Column) -> Column:
    """Duplicates among key points count, claims are a set."""
    kp = F.filter(F.transform(key_points, strip), lambda x: x != "")
    covered = F.size(F.filter(kp, lambda x: F.array_contains(claims, x)))
    return F.struct(
        F.size(kp).alias("key_points"), F.size(claims).alias("evidence_quotes"), covered.alias("covered"), (F.size(kp) - covered).alias("overclaim")
    )


def claim_set_stats(df: DataFrame, group: str, claim: str, source_id: str) -> DataFrame:
    """Claims of each set in all, distinct ones, and distinct (claim, source) links.

    Aggregated by (set, claim, source) and then (set, claim), so a set that owns most rows spreads over its claims.
    """
    links = df.groupBy(group, claim, source_id).agg(F.count(F.lit(1)).alias("_n"))
    claims = links.groupBy(group, claim).agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_links"))
    return claims.groupBy(group).agg(F.sum("_n").alias("claims"), F.count(F.lit(1)).alias("distinct_claims"), F.sum("_links").alias("links"))


def alignment_report(blocks: DataFrame, features: str) -> DataFrame:
    """Enriched blocks in one row; list-like items stand in where there are no list items."""
    f = F.col(features)
    items = F.when(F.size(f["list_items"]) > 0, f["list_items"]).otherwise(f["list_like_items"])
    n = F.when(f.isNotNull() & (F.size(items) > 0), F.size(items))
    return blocks.agg(
        F.count(F.lit(1)).alias("total_blocks"), F.count(n).alias("list_like_blocks"), F.round(F.coalesce(F.avg(n), F.lit(0.0)), 6).alias("avg_list_feature_count"),
        F.count(F.when(f.isNull(), 1)).alias("blocks_missing_enriched"),
    )


def verdict_stats(df: DataFrame, group: str, verdict: str, strict: bool = False) -> DataFrame:
    """KEEP, DROP and UNCERTAIN rows of each group; strict mode counts the uncertain as dropped as well."""
    of = lambda *names: F.count(F.when(F.col(verdict).isin(*names), 1))
    dropped = of("DROP", "UNCERTAIN") if strict else of("DROP")
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("total"), of("KEEP").alias("kept"), dropped.alias("dropped"), of("UNCERTAIN").alias("uncertain"))
