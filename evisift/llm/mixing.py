"""Mixing sources to target weights by weighted fair queueing (operator 12).

Every source is a flow. Its documents are shuffled by a hash and served copy after copy; the virtual finish time of an entry is the
running number of its source's words, itself included, divided by the source's weight. All entries of all sources are then sorted on
that time by range and cut where their running words reach the budget. A source whose copies run out before the cut
simply ends, and the budget it leaves is shared by the others in proportion to their weights: the cut is the water level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running, stored, table
from .registry import query

WEIGHTS, REPEATS, SHARE, SEED = (3, 1, 2), 2, 1.5, "mix"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> tuple[DataFrame, float]:
    """(source, source_size, flow, weight, first, target) for ``sizes(source, source_size)``, and the budget.

    Sources by code point, null last, take ``weights`` in turn. A target is the source's weight times a common level, at most
    ``repeats`` times its size; the level makes targets add up to ``share`` of all sizes. With sources ordered by the level at
    which they are full, it is the first level found that does not fill its source. flow numbers the sources, first is the
    number of words of all copies of earlier ones. One row for each source is sorted by range; nothing is collected but totals.
    """
    flows = running(sizes.withColumn("cap", F.col("source_size") * repeats), [F.col("source").asc_nulls_last()], {"end": "cap"}, "flow", "flows")
    turn = F.element_at(F.array(*map(F.lit, weights)), F.pmod("flow", F.lit(len(weights))).cast("int") + 1).cast("double")
    flows = flows.withColumn("weight", turn).withColumn("full", F.col("cap") / F.col("weight"))
    totals = flows.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, all_weights = share * (totals[0] or 0), totals[1] or 0.0
    steps = running(flows, ["full", "flow"], {"caps": "cap", "weights": "weight"}, "at", "levels")
    level = (F.lit(budget) - (F.col("caps") - F.col("cap"))) / (F.lit(all_weights) - (F.col("weights") - F.col("weight")))
    top = steps.select("full", level.alias("level")).where("level < full").agg(F.max("level")).first()[0]
    target = F.col("cap").cast("double") if top is None else F.least(F.col("cap").cast("double"), F.lit(top) * F.col("weight"))
    return flows.select("source", "source_size", "flow", "weight", (F.col("end") - F.col("cap")).alias("first"), target.alias("target")), budget


def fair_queue(
    df: DataFrame, size: str = "size", source: str = "source", ids: tuple[str, ...] = ("doc_id",), weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: str = SEED
) -> DataFrame:
    """The columns of ``df`` with row, copy (1 .. ``repeats``), source_size, target, finish, position and admitted, for every copy of every row.

    The mix is the admitted entries by position: whole documents, running sizes at most the budget. A row is admitted at
    most ``repeats`` times, its second copy only after all first copies of its source. The shuffle is a hash of ``seed``, copy and ``ids``,
    so reruns agree whatever the partitions; rows alike in ids and size may swap. ``size`` is a non-negative long (null: 0). A null
    source is a source of its own, last in order; nulls of ids count as values. Repeated rows are entries of their own. An empty
    input gives an empty result, sizes of zero admit what comes before the budget is used up. Columns of these names are replaced.
    """
    new = ("row", "copy", "source_size", "target", "finish", "position", "admitted")
    kept = [c for c in df.columns if c not in new]
    names = [f"_c{i}" for i in range(len(kept))]
    of = dict(zip(kept, names, strict=True))
    whole = F.coalesce(F.col(of[size]), F.lit(0)).cast("long")
    rows = df.select(*kept).toDF(*names).withColumns({"_source": F.col(of[source]), "_size": whole}).withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, "rows")
    sizes = stored(rows.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size")), "sources")
    targets, budget = source_targets(sizes, weights, share, repeats)
    targets = stored(targets, "targets").withColumnRenamed("source", "_of")
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    named = [F.coalesce(F.col(of[c]).cast("string"), F.lit("\0")) for c in ids]
    shuffled = copies.withColumn("_key", F.unhex(F.md5(F.concat_ws("|", F.lit(seed), "copy", *named))))
    shuffled = shuffled.join(targets, F.col("_source").eqNullSafe(F.col("_of"))).drop("_source", "_of")
    served = running(shuffled, ["flow", "copy", "_key", *(of[c] for c in ids), "_size", "row"], {"_served": "_size"}, "_at", "served")
    served = served.withColumn("finish", (F.col("_served") - F.col("first")) / F.col("weight")).drop("_at", "_served", "first", "weight")
    queue = running(served, ["finish", "flow", "copy", "_key", *(of[c] for c in ids), "_size", "row"], {"_used": "_size"}, "position", "queue")
    queue = queue.withColumn("admitted", F.col("_used") <= budget)
    return queue.select(*(F.col(n).alias(c) for c, n in of.items()), *new)


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w
  FROM d GROUP BY source
),
l AS (
  SELECT *, 2 * source_size / w AS full_at, 1.5 * sum(source_size) OVER () AS budget,
         coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
         sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
  FROM s
),
t AS (
  SELECT source, source_size, w, CAST(budget AS DOUBLE) AS budget,
         least(CAST(2 * source_size AS DOUBLE), coalesce(w * (SELECT max((budget - caps) / rest) FROM l WHERE (budget - caps) / rest < full_at), 2 * source_size)) AS target
  FROM l
),
c AS (
  SELECT d.*, t.source_size, t.w, t.budget, t.target, copy, md5(concat_ws('|', 'mix', copy, coalesce(CAST(doc_id AS VARCHAR), chr(0)))) AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source, (SELECT unnest([1, 2]) AS copy) AS x
),
f AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY copy, k, doc_id NULLS FIRST, size, r ROWS UNBOUNDED PRECEDING) / w AS finish FROM c
),
q AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, copy, k, doc_id NULLS FIRST, size, r ROWS UNBOUNDED PRECEDING) <= budget AS admitted FROM f
)
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target, CAST(sum(CASE WHEN admitted THEN size ELSE 0 END) AS BIGINT) AS taken
FROM q GROUP BY r, doc_id
"""


@query("op12_fair_queue", OP12_SQL)
def op12_fair_queue(spark, sf_dir):
    """Words that the mix takes of every document."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", size.alias("size"))
    by_row = fair_queue(docs).groupBy("row").agg(*(F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")), F.sum(F.when(F.col("admitted"), F.col("size")).otherwise(0)).alias("taken"))
    return by_row.drop("row")
