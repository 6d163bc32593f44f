"""Row filters with the reference's null and empty-list rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import falsy_or


def filter_chunks(
    df: DataFrame,
    langs: Sequence[str] | None = None,
    min_quality: float | None = None,
    source_types: Sequence[str] | None = None,
    lang_col: str = "lang",
    quality_col: str = "quality",
    source_col: str = "source_type",
) -> DataFrame:
    """A null language or quality passes, an empty list means no filter."""
    if min_quality is not None:
        df = df.where(F.col(quality_col).isNull() | (F.col(quality_col) >= min_quality))
    if langs:
        df = df.where(F.col(lang_col).isNull() | F.col(lang_col).isin(list(langs)))
    if source_types:
        df = df.where(F.col(source_col).isin(list(source_types)))
    return df


def metadata_match(filters: Mapping[str, object]) -> Column:
    """Equality or membership; a missing value never equals a wanted one."""
    cond: Column = F.lit(True)
    for col, want in filters.items():
        if isinstance(want, (list, tuple, set)):
            cond = cond & F.coalesce(F.col(col).isin(list(want)), F.lit(False))
        else:
            cond = cond & F.col(col).eqNullSafe(F.lit(want))
    return cond


def allow_list(df: DataFrame, key: str, allowed: DataFrame) -> DataFrame:
    """Left semi join; an empty allow-list keeps everything."""
    if allowed.isEmpty():
        return df
    return df.join(allowed.select(F.col(allowed.columns[0]).alias(key)).distinct(), key, "left_semi")


def single_document(df: DataFrame, ids: list[str], doc: str) -> DataFrame:
    """Rows of one document, by the first of its id columns that is filled."""
    return df.where(falsy_or(*[F.col(c) for c in ids]) == doc)
