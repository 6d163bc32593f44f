"""Generators whose array expression is evaluated once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, keys: list, arr: Column, *names: str) -> DataFrame:
    """Rows of ``arr`` next to ``keys``; one name gives values, two give (position, value).

    A plain explode makes the optimizer infer ``size(arr) > 0`` and push it below, which
    computes a costly array two more times. The outer form followed by a null test on the
    generated column gives the same rows for arrays without null elements.
    """
    gen = F.posexplode_outer(arr) if len(names) == 2 else F.explode_outer(arr)
    return df.select(*keys, gen.alias(*names)).where(F.col(names[0]).isNotNull())
