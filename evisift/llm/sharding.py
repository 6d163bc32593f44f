"""Contiguous shards of near equal bytes (operator 4): global prefix sums from per-partition totals, cut at equal targets."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import offsets, stored, table
from .registry import query

SHARDS = 24
#: Bytes that every row weighs besides its text.
ROW_BYTES = 8


def byte_shards(df: DataFrame, size: str, order: list[str], shards: int = SHARDS) -> DataFrame:
    """``df`` with shard (0 .. shards-1) and slot (gapless from 0 in each shard), contiguous in ``order``.

    The rows are range-partitioned and sorted on ``order`` with a row number as last key, so that equal rows or a hot
    value of ``order`` are split over tasks. Each task keeps running bytes and rows; one total for each partition becomes an
    offset. A row goes to the shard in which the middle of its bytes falls, so every shard's bytes differ from the equal
    target by less than one row's size. ``size`` must be positive in every row. Nulls of ``order`` come first; among
    equal rows any order gives the same result. An empty input gives an empty result. Columns named shard or slot are replaced.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    df = df.drop("shard", "slot")
    tag = uuid.uuid4().hex[:8]
    tie, part, start, row = (f"_{n}_{tag}" for n in ("tie", "part", "from", "row"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn(tie, F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(parts, *order, tie).sortWithinPartitions(*order, tie).withColumn(part, F.spark_partition_id())
    schema = T.StructType([*ranged.schema.fields, T.StructField(start, T.LongType()), T.StructField(row, T.LongType())])

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = rows = 0
        for b in batches:
            n = b.column(size).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = held + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends - n), pa.array(rows + np.arange(len(n), dtype=np.int64))], names=schema.names)
            held, rows = int(ends[-1]) if len(n) else held, rows + len(n)

    local = stored(ranged.mapInArrow(running, schema), "sizes")
    totals = local.groupBy(part).agg(F.sum(size).alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    all_bytes = totals.agg(F.sum("_bytes")).first()[0] or 1
    # One row for each partition: bounded by the number of tasks.
    before = offsets(totals, part, "_bytes", "_rows").toDF(part, f"_bytes_{tag}", f"_rows_{tag}")
    placed = local.join(F.broadcast(before), part).withColumn(row, F.col(row) + F.col(f"_rows_{tag}")).withColumn(start, F.col(start) + F.col(f"_bytes_{tag}"))
    middle = (F.col(start) * 2 + F.col(size)).cast("decimal(38,0)") * shards
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle / F.lit(2 * all_bytes).cast("decimal(38,0)")).cast("int")))
    starts = placed.groupBy("shard").agg(F.min(row).alias(tie))
    out = placed.drop(tie).join(F.broadcast(starts), "shard").withColumn("slot", F.col(row) - F.col(tie))
    return out.select(*df.columns, "shard", "slot")


OP4_SQL = """
WITH t AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM (SELECT unnest(range(256)) AS i)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, hex(coalesce(text, '')) AS h FROM documents),
b AS (SELECT r, doc_id, strlen(text) + 8 AS size, list_transform(range(strlen(text)), lambda i: (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1) AS bytes FROM d),
c AS (SELECT r, doc_id, size, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, crc[xor(c & 255, x) + 1])), 4294967295) AS text_crc32 FROM b, t),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size, r ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM c),
s AS (SELECT *, CAST(least(23, ((2 * before + size) * 24) // (2 * total)) AS INTEGER) AS shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY before) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s
"""


@query("op4_byte_shards", OP4_SQL)
def op4_byte_shards(spark, sf_dir):
    """All documents in 24 shards of near equal bytes, contiguous by doc_id (then by checksum and size)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = byte_shards(docs, "size", ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
