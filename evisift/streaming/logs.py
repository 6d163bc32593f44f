"""Append-only logs and idempotent imports as Structured Streaming jobs (ST1-ST4, S21)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.bank import scratch_path


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet") -> DataFrame:
    """A table path, one file or a folder of part files, as a stream; new part files arrive as new micro-batches.

    The last character is written as a pattern: streams take a single file only from a pattern, and this one matches
    the path alone.
    """
    path = path.rstrip("/")
    return spark.readStream.format(fmt).schema(schema).load(f"{path[:-1]}[{path[-1]}]")


def append_log(stream: DataFrame, path: str, checkpoint: str) -> None:
    """S21/ST1: exactly-once append; restarts go on from the checkpoint."""
    q = stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def import_once(stream: DataFrame, keys: list[str], path: str, checkpoint: str) -> None:
    """ST2/ST4: each key is stored once, ever.

    The key set is streaming state, partitioned by the full key: a query or user that
    owns most rows still spreads over all tasks. It grows with all keys ever seen, so it is kept in RocksDB, on
    disk, and not in the executors' heap. A replayed batch changes nothing.
    """
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        fresh = stream.dropDuplicates(keys)
        q = fresh.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        conf.set(name, before)


def merge_batch(target: str, keys: list[str]):
    """ST2 as a ``foreachBatch`` body: left anti join against the stored table, then append."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        try:
            stored = spark.read.parquet(target).select(*keys)
            fresh = fresh.join(stored, keys, "left_anti")
        except Exception as e:  # first batch: nothing stored yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        fresh.write.mode("append").parquet(target)

    return write


def resume(examples: DataFrame, stored: DataFrame, id_col: str = "id", ord_col: str = "ord") -> DataFrame:
    """ST3: examples still to run; the stored log must equal the first K examples.

    A stored id outside the first K positions means the log belongs to another run: raise.
    """
    k = stored.agg(F.count(F.lit(1)).alias("k"))
    joined = examples.join(stored.select(id_col).withColumn("done", F.lit(True)), id_col, "left")
    joined = joined.join(F.broadcast(k.withColumn("_j", F.lit(0))), F.lit(0) == F.col("_j")).drop("_j")
    done = F.coalesce("done", F.lit(False))
    wrong = done != (F.col(ord_col) < F.col("k"))
    checked = joined.withColumn(
        ord_col, F.when(wrong, F.raise_error(F.lit("stored log does not match the examples")).cast(examples.schema[ord_col].dataType)).otherwise(F.col(ord_col))
    )
    return checked.where(~done | (F.col(ord_col) < 0)).drop("done", "k")


def run_paths(spark: SparkSession, name: str) -> tuple[str, str]:
    """(output folder, checkpoint folder) for one run."""
    base = scratch_path(spark, name)
    return f"{base}/out", f"{base}/checkpoint"
