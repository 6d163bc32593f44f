"""Helpers shared by the corpus operators: tables, scratch tables, text batches, components of a link graph."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

#: Rows or texts of a batch that are worked on together stay below this many bytes (a single longer text is its own batch).
SLICE_BYTES = 2 << 20


#: Rows of an Arrow batch (JVM and Python each hold one for a task); Spark's own default is for narrow rows.
BATCH_ROWS, SPARK_BATCH_ROWS = 1000, 10_000


def modest_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for rows with whole texts, unless the session has a setting of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) == SPARK_BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the cluster's shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: cuts lineage, survives lost executors."""
    modest_batches(df.sparkSession)
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a table made by ``stored`` that nothing will read any more."""
    jvm = df.sparkSession._jvm
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def plus(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    """``schema`` with fields added; an input column that has the name of one of them is replaced by it."""
    new = [T.StructField(n, t) for n, t in fields]
    return T.StructType([*(f for f in schema.fields if f.name not in {n for n, _ in fields}), *new])


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of ``batch`` whose texts stay below ``limit`` bytes together, one row at least."""
    sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column).cast(pa.binary())]
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield batch.slice(start)


def raw_texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def appended(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """``batch`` with columns added, or replaced where the name is there already."""
    kept = [i for i, n in enumerate(batch.schema.names) if n not in columns]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *columns.values()], names=[*(batch.schema.names[i] for i in kept), *columns])


def map_rows(df: DataFrame, column: str, fields: list[tuple[str, T.DataType]], make: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """``df`` with the columns ``make(slice)`` returns, over slices of bounded text size."""

    modest_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            for piece in slices(batch, column):
                yield appended(piece, **make(piece))

    return df.mapInArrow(run, plus(df.schema, *fields))


def text_key(column: str) -> list:
    """Two 64-bit hashes that stand for a whole text (128 bits; null as empty)."""
    text = F.coalesce(F.col(column), F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text, F.length(text)).alias("k2")]


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over ``edges(a, b)``, for every node with an edge.

    Alternates the two star steps of Kiveris et al. (SoCC 2014): all larger neighbours, then all smaller ones,
    move to a node's smallest neighbour. Each round is joins and partial aggregates over the edges only; rounds grow
    with the logarithm of the longest chain. A hub's neighbours join on the hub, which Spark splits as a skewed join.
    """
    spark = edges.sparkSession
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        # What tells whether a round changed anything is counted while its table is written.
        seen = Observation()
        then = stored(small.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "links")
        new = seen.get
        discard(now)
        now = then
        if new == mark or not new.get("n"):
            break
        mark = new
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def offsets(local: DataFrame, part: str, *totals: str) -> DataFrame:
    """Exclusive prefix sums of per-partition totals: one row for each partition, so the single window is small."""
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return local.select(part, *(F.coalesce(F.sum(t).over(before), F.lit(0)).alias(f"{t}_before") for t in totals))


def running(df: DataFrame, order: list[str | Column], sums: dict[str, str], at: str = "at", name: str = "running") -> DataFrame:
    """``df`` with ``at`` (row number from 0 in ``order``) and, for each (out, column) of ``sums``, the sum of the column up to and including the row.

    Range-partitioned and sorted on ``order``, which must be unique or end in rows that may swap; each task keeps its own sums,
    and one total for each partition becomes an offset. A hot value is split by the keys after it. The columns must be long or double, without nulls.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    kinds = {out: df.schema[column].dataType for out, column in sums.items()}
    schema = T.StructType([*ranged.schema.fields, T.StructField(at, T.LongType()), *(T.StructField(o, k) for o, k in kinds.items())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = 0, dict.fromkeys(sums, 0)
        for b in batches:
            made = [pa.array(rows + np.arange(b.num_rows, dtype=np.int64))]
            rows += b.num_rows
            for out, column in sums.items():
                total = held[out] + np.cumsum(b.column(column).to_numpy(zero_copy_only=False))
                held[out] = total[-1] if len(total) else held[out]
                made.append(pa.array(total))
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=schema.names)

    own = stored(ranged.mapInArrow(local, schema), name)
    totals = own.groupBy("_part").agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_s{i}") for i, c in enumerate(sums.values())))
    # One row for each partition: bounded by the number of tasks.
    before = F.broadcast(offsets(totals, "_part", "_n", *(f"_s{i}" for i in range(len(sums)))))
    moved = {at: F.col(at) + F.col("_n_before")} | {o: F.col(o) + F.col(f"_s{i}_before") for i, o in enumerate(sums)}
    return own.join(before, "_part").withColumns(moved).select(*df.columns, at, *sums)
