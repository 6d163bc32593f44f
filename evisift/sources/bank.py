"""Vector bank and graph on parquet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex[:12]}"


def save_bank(df: DataFrame, path: str, shard_size: int | None = None) -> None:
    """Prose and tables, and each dimension, in separate partitions; files of at most ``shard_size`` rows if given."""
    out = df.withColumn("dim", F.size("item")).write.mode("overwrite")
    out = out if shard_size is None else out.option("maxRecordsPerFile", shard_size)
    out.partitionBy("is_table", "dim").parquet(path)


def load_bank(spark: SparkSession, path: str, tables: bool | None = None) -> DataFrame:
    """Partition pruning picks prose or tables; all vectors must have one dimension, which the partitions tell without a scan."""
    df = spark.read.parquet(path)
    missing = {"rid", "item", "dim"} - set(df.columns)
    if missing:
        raise ValueError(f"not a bank: {path} lacks {sorted(missing)}; did you mean its parent folder?")
    df = df.withColumn("is_table", F.col("is_table").cast("boolean"))  # partition values are read as text
    if tables is not None:
        df = df.where(F.col("is_table") == tables)
    if len(df.select("dim").distinct().limit(2).collect()) > 1:
        raise ValueError(f"dimension mismatch in {path}")
    return df.drop("dim")


def manifest(df: DataFrame) -> DataFrame:
    """One row per part: items and dimension."""
    return df.groupBy("is_table").agg(F.count(F.lit(1)).alias("n_items"), F.max(F.size("item")).alias("dim"))


def save_graph(parts: dict[str, DataFrame], path: str) -> None:
    """Nodes, edges, triples and indices as tables of one folder."""
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_graph(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
