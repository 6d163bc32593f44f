"""Global positions without a single-task window (W15, K-style ordinals)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def global_position(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """0-based position in the total order of ``order`` (which must be unique).

    The sort is range-partitioned; only the per-partition row counts (one number per
    partition) meet in one task to become offsets.
    """
    local = df.sort(*order).withColumn("_m", F.monotonically_increasing_id())
    local = cut_lineage(
        local.select("*", F.shiftright("_m", 33).alias("_p"), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)).alias("_i")).drop("_m")
    )
    sizes = local.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    return local.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_o") + F.col("_i")).drop("_p", "_i", "_o")


def running_total(df: DataFrame, keys: list[str], order: str, weight: str, name: str = "upto") -> DataFrame:
    """Sum of ``weight`` up to and including each row within ``keys``, by ``order``.

    (keys, order) must be unique. The rows are range-partitioned on the whole sort key,
    so one crowded key spreads over many tasks; per-partition sums become offsets.
    """
    local = cut_lineage(df.repartitionByRange(*keys, order).withColumn("_p", F.spark_partition_id()))
    inside = Window.partitionBy("_p").orderBy(*keys, order).rowsBetween(Window.unboundedPreceding, 0)
    sizes = local.groupBy("_p").agg(F.sum(weight).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    total = local.withColumn("_t", F.sum(weight).over(inside)).join(F.broadcast(offsets), "_p").withColumn("_t", F.col("_t") + F.col("_o"))
    if not keys:
        return total.withColumn(name, F.col("_t")).drop("_p", "_o", "_t")
    first = total.groupBy(*keys).agg(F.min(F.col("_t") - F.col(weight)).alias("_z"))
    return total.join(first, keys).withColumn(name, F.col("_t") - F.col("_z")).drop("_p", "_o", "_t", "_z")
