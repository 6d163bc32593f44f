"""Vector scoring, ranking and merging."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import metadata_match
from .topk import InnerProduct, top_k


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    """The norm is floored at ``eps``."""
    n = F.greatest(norm(v), F.lit(eps))
    return F.transform(v, lambda x: x.cast("double") / n)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double; unequal dimensions raise."""
    prod = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    total = F.aggregate(prod, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.raise_error(F.lit("dimension mismatch")).cast("double"))


def cosine_distance(a: Column, b: Column, eps: float = 1e-12) -> Column:
    """``eps`` is added to each norm, not used as a floor."""
    return F.lit(1.0) - dot(a, b) / ((norm(a) + eps) * (norm(b) + eps))


def group_centroids(df: DataFrame, key: str, vec: str, digits: int = 6) -> DataFrame:
    """Mean vector per key, one partial sum per (key, dimension)."""
    parts = df.select(key, F.posexplode(vec).alias("i", "x"))
    means = parts.groupBy(key, "i").agg(F.round(F.avg(F.col("x").cast("double")), digits).alias("m"))
    arr = F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"])
    return means.groupBy(key).agg(arr.alias("centroid"))


def masked_mean(rows: DataFrame, key: str, vec: str, mask: Column) -> DataFrame:
    """Mean over the rows whose mask is set."""
    return group_centroids(rows.where(mask), key, vec)


def search(queries: DataFrame, bank: DataFrame, k: int, **kw) -> DataFrame:
    """``queries(qid, item)`` against ``bank(rid, item)``."""
    return top_k(queries, bank, InnerProduct, k, **kw)


def rerank_ranks(df: DataFrame, key: str, *order: Column, k: int | None = None) -> DataFrame:
    """Rank within ``key``; with ``k`` Spark cuts each group before the shuffle."""
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return out if k is None else out.where(F.col("rank") <= k)


def search_postfilter(
    queries: DataFrame, bank: DataFrame, meta: DataFrame, filters: Mapping[str, object], k: int, oversample: int = 5, **kw
) -> DataFrame:
    """Search 5k, then filter, then keep k. May return fewer than k although more match."""
    pool = search(queries, bank, max(k, k * oversample), **kw).drop("rank")
    kept = pool.join(meta, "rid").where(metadata_match(filters))
    return rerank_ranks(kept, "qid", F.col("score").desc(), F.col("rid"), k=k)


def search_sharded(
    queries: DataFrame, bank: DataFrame, meta: DataFrame, shard: str, filters: Mapping[str, object], k: int,
    oversample: int = 5, **kw,
) -> DataFrame:
    """Every shard oversamples and filters on its own; the union is cut to k.

    One scan serves all shards: the kernel keeps its best rows per (query, shard).
    """
    if shard in bank.columns:  # the label stands in the vector's own row: no vector is shuffled for it
        rows = bank.select("rid", "item", F.col(shard).alias("grp"))
    else:
        rows = bank.select("rid", "item").join(meta.select("rid", F.col(shard).alias("grp")), "rid")
    pool = top_k(queries, rows, InnerProduct, max(k, k * oversample), **kw).drop("rank")
    kept = pool.join(meta, "rid").where(metadata_match(filters))
    w = Window.partitionBy("qid", "grp").orderBy(F.col("score").desc(), "rid")
    per_shard = kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")
    return rerank_ranks(per_shard, "qid", F.col("score").desc(), F.col("rid"), k=k)


def length_prior_score(score: Column, text: Column, alpha: float = 0.0) -> Column:
    """W04."""
    return score + F.lit(alpha) * F.length(F.coalesce(text, F.lit("")))


# Rerank weights and intent bonuses.
W_ANN, W_INTENT, W_QUALITY = 1.0, 0.6, 0.2
PRIMARY_BONUS, TAG_BONUS, OFF_INTENT = 0.3, 0.15, -0.2


def weighted_score(
    ann: Column, intent_sim: Column, quality: Column, intent: Column, primary: Column, tags: Column
) -> Column:
    """Weighted sum plus primary/tag bonus or off-intent penalty, six decimals."""
    bonus = (
        F.when(primary.eqNullSafe(intent), PRIMARY_BONUS)
        .when(F.coalesce(F.array_contains(tags, intent), F.lit(False)), TAG_BONUS)
        .otherwise(OFF_INTENT)
    )
    base = F.lit(W_ANN) * ann + F.lit(W_INTENT) * intent_sim + F.lit(W_QUALITY) * quality
    return F.round(F.when(intent.isNull() | (intent.cast("string") == ""), base).otherwise(base + bonus), 6)


def list_feature_score(
    score: Column, list_like: Column, n_features: Column, confidence: Column, signals: Column,
    schema_slot: bool, location_slot: bool,
) -> Column:
    """Clamp, then boost; non-lists score 0 when a schema slot asks for a list."""
    base = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    boost = F.when(list_like, 1.0 + F.least(n_features, F.lit(3)) * 0.15 + confidence * 0.20).otherwise(1.0)
    if location_slot:
        paren = F.arrays_overlap(signals, F.array(F.lit("paren_cases_capture"), F.lit("paren_cases")))
        trigger = F.exists(signals, lambda s: F.startswith(s, F.lit("trigger_phrase:")))
        marks = F.arrays_overlap(signals, F.array(F.lit("bullet"), F.lit("numbering")))
        shape = F.when(paren, 1.25).otherwise(1.0) * F.when(trigger, 1.10).otherwise(1.0) * F.when(marks, 0.80).otherwise(1.0)
        boost = boost * F.when(list_like, shape).otherwise(1.0)
    out = base * boost
    return F.when(~list_like, 0.0).otherwise(out) if schema_slot else out


def priority_merge(sources: Sequence[tuple[DataFrame, str, float]], k: int) -> DataFrame:
    """The first source holding an id wins whatever its score; blank ids never merge.

    Each input is already a top-k per query, so the groups are small.
    """
    out = None
    for prio, (df, name, scale) in enumerate(sources):
        part = df.select(
            "qid", "rid", (F.col("score") * scale).alias("score"), F.lit(name).alias("source"),
            F.lit(prio).alias("prio"), F.col("rank").alias("src_rank"),
        )
        out = part if out is None else out.unionByName(part)
    blank = F.coalesce(F.col("rid").cast("string"), F.lit("")) == ""
    w = Window.partitionBy("qid", "rid").orderBy("prio", "src_rank")
    kept = out.withColumn("n", F.row_number().over(w)).where(blank | (F.col("n") == 1)).drop("n")
    return rerank_ranks(kept, "qid", F.col("score").desc(), F.col("prio"), F.col("src_rank"), k=k)


def evidence_first_merge(evidence: DataFrame, raw: DataFrame, k: int, min_items: int = 8, raw_scale: float = 0.98) -> DataFrame:
    """Raw hits join only the queries whose evidence is short."""
    n_ev = evidence.groupBy("qid").agg(F.count(F.lit(1)).alias("n_ev"))
    short = raw.join(n_ev, "qid", "left").where(
        (F.coalesce("n_ev", F.lit(0)) < k) | (F.coalesce("n_ev", F.lit(0)) < min_items)
    )
    return priority_merge([(evidence, "evidence", 1.0), (short.drop("n_ev"), "raw", raw_scale)], k)


def type_scores(vec: Column, anchors: Sequence[Sequence[float]], digits: int = 6) -> Column:
    """Inner products with every type anchor (a fixed, configured list)."""
    mat = np.asarray(anchors, dtype=np.float64)
    if mat.shape[0] > 1024:
        raise ValueError("type anchors are a configured list of at most 1024 entries")

    @F.pandas_udf("array<double>")
    def score(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.round(np.stack(v.to_numpy()).astype(np.float64) @ mat.T, digits) + 0.0))

    return score(vec)


def tag_types(scores: Column, names: Sequence[str], thresholds: Sequence[float], prefer: Sequence[str], margin: float = 0.05):
    """(tags, primary) from scores aligned with ``names``."""
    cells = F.zip_with(
        scores, F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(t)).alias("thr")) for n, t in zip(names, thresholds)]),
        lambda s, m: F.struct((-s).alias("neg"), m["name"].alias("name"), m["thr"].alias("thr")),
    )
    # Stable order on the score alone: ties stay in configuration order.
    indexed = F.transform(cells, lambda c, i: F.struct(c["neg"].alias("neg"), i.alias("i"), c["name"].alias("name"), c["thr"].alias("thr")))
    order = F.array_sort(indexed)
    kept = F.transform(F.filter(order, lambda c: -c["neg"] >= c["thr"]), lambda c: c["name"])
    top = F.get(order, 0)
    tags = F.when(F.size(kept) > 0, kept).otherwise(F.array(top["name"]))
    best = -top["neg"]
    near = [
        F.when(best - F.get(scores, list(names).index(p)) <= margin, F.lit(p)) for p in prefer if p in names
    ]
    return tags, F.coalesce(*near, F.get(tags, 0))


def drift_gate(cos_dist: Column, delta: Column, mismatch: Column, tau: float = 0.35, min_delta: float = 0.05) -> Column:
    """Decisions accumulate, confidence is the maximum, the last rationale wins."""
    shift = F.coalesce(cos_dist > tau, F.lit(False))
    weak = F.coalesce(delta < min_delta, F.lit(False))
    bad = F.coalesce(mismatch, F.lit(False))
    return F.struct(
        (shift | weak | bad).alias("retrieve_more"),
        (weak | bad).alias("reject_current"),
        F.greatest(
            F.lit(0.5), F.when(shift, 0.7).otherwise(0.5), F.when(weak, 0.75).otherwise(0.5), F.when(bad, 0.65).otherwise(0.5)
        ).alias("confidence"),
        F.when(bad, "pattern-mismatch").when(weak, "low-impact").when(shift, "semantic-shift").otherwise("none").alias("rationale"),
    )


def constant_gate(gamma: float = 0.08) -> Column:
    """Constant gate value."""
    return F.lit(gamma)


def learned_gate(logit: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Clamped sigmoid of a model's logit column."""
    return F.greatest(F.lit(lo), F.least(F.lit(hi), F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))))


def masked_mse(a: Column, b: Column, mask: Column) -> Column:
    """Mean squared error over the unmasked positions of flattened arrays."""
    sq = F.zip_with(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), mask, lambda d, m: d * m.cast("double"))
    total = F.aggregate(sq, F.lit(0.0), lambda s, x: s + x)
    n = F.aggregate(mask, F.lit(0.0), lambda s, m: s + m.cast("double"))
    return total / F.greatest(n, F.lit(1.0))
