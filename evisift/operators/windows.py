"""Neighbour comparisons inside a series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import number_within


def step_deltas(df: DataFrame, key: str, order: str, value: str, run: int = 2) -> DataFrame:
    """Difference to the previous row, and whether the last ``run`` steps all fell.

    A series may hold most rows, so positions come from a range-partitioned sort and
    neighbours meet by an equi-join on (key, position) instead of a per-key window.
    """
    pos = number_within(df.select(key, order, value), key, order)
    out = pos
    for k in range(1, run + 1):
        prev = pos.select(key, (F.col("no") + k).alias("no"), F.col(value).alias(f"_p{k}"))
        out = out.join(prev, [key, "no"], "left")
    falling = F.lit(True)
    for k in range(1, run + 1):
        falling = falling & (F.col(value if k == 1 else f"_p{k - 1}") < F.col(f"_p{k}"))
    return out.select(order, key, value, (F.col(value) - F.col("_p1")).alias("delta"), F.coalesce(falling, F.lit(False)).alias("falling"))
