"""Step-wise selection with memory and stop rules (Q27, ST4): a bounded number of rounds over one state table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def select_in_steps(pool: DataFrame, k: int, max_steps: int, min_score: float) -> DataFrame:
    """``pool(qid, rid, score, rank)`` -> ``(qid, rid, step)``: each step takes a query's next ``k`` unused rows by rank.

    A query stops before the first step whose best score is below ``min_score``, when its pool is used up, and after
    ``max_steps``. A row is used once for a query, whatever brought it into the pool. Every round reads the state, anti-joins
    what is used and writes the new state; the rank filter cuts each query's rows before the shuffle.
    """
    ranked = cut_lineage(pool.groupBy("qid", "rid").agg(F.min(F.struct("rank", "score")).alias("b")).select("qid", "rid", "b.rank", "b.score"))
    active, state = ranked.select("qid").distinct(), None
    for step in range(max_steps):
        left = ranked.join(active, "qid", "left_semi")
        if state is not None:
            left = left.join(state.select("qid", "rid"), ["qid", "rid"], "left_anti")
        nxt = left.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "rid"))).where(F.col("_n") <= k)
        good = nxt.groupBy("qid").agg(F.max("score").alias("best")).where(F.col("best") >= min_score).select("qid")
        taken = nxt.join(good, "qid", "left_semi").select("qid", "rid", F.lit(step).alias("step"))
        grown = cut_lineage(taken if state is None else state.unionByName(taken))
        active = grown.where(F.col("step") == step).select("qid").distinct()
        state = grown
        if active.isEmpty():
            break
    return state
