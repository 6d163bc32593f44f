"""Readers of the given parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import spread


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """Document texts, pruned to ``cols`` before they are spread over the cores."""
    df = table(spark, sf_dir, "documents")
    keep = list(dict.fromkeys(("doc_id", *(cols or ("text",)))))
    return spread(df.select(*keep), "doc_id")
