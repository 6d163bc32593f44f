"""JSON-lines readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import falsy_or, strip


def read_strict(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Blank lines skipped, a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_tolerant(spark: SparkSession, path: str, schema: T.StructType, id_col: Column) -> tuple[DataFrame, DataFrame]:
    """(parsed rows, counters read / parsed / skipped / errors).

    Lines are parsed by ``from_json``; the status column makes the counters one small
    aggregate. Blank lines, non-objects and rows without id count as skipped.
    """
    raw = spark.read.text(path)
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    line = strip(F.col("value"))
    parsed = raw.select(
        line.alias("line"), F.from_json(line, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")
    )
    object_like = F.startswith("line", F.lit("{"))
    other_json = F.try_parse_json("line").isNotNull() & ~object_like
    rows = parsed.select("line", "r.*")
    status = (
        F.when((F.col("line") == "") | other_json, "skipped").when(F.col("_bad").isNotNull() | ~object_like, "errors")
        .when(F.coalesce(strip(id_col.cast("string")), F.lit("")) == "", "skipped").otherwise("parsed")
    )
    marked = rows.withColumn("_status", status)
    one = lambda s: F.sum((F.col("_status") == s).cast("int"))
    stats = marked.agg(F.count(F.lit(1)).alias("read"), *[F.coalesce(one(s), F.lit(0)).alias(s) for s in ("parsed", "skipped", "errors")])
    return marked.where("_status = 'parsed'").drop("_status", "_bad", "line"), stats


def first_rows(df: DataFrame, ord_col: str, n: int) -> DataFrame:
    """The first n rows in file order."""
    return df.orderBy(ord_col).limit(n)


# Core fields of a chunk record and those that must be filled.
CHUNK_FIELDS = [
    "doc_id", "chunk_id", "source_uri", "source_type", "page_range", "section_path", "text", "lang", "quality_score", "ocr_used",
    "ocr_confidence", "dedupe_hash", "created_at", "dataset_version",
]
REQUIRED = ["doc_id", "chunk_id", "source_uri", "source_type", "text", "dataset_version"]


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Known fields as columns, every other top-level key in ``extra``; a missing required field raises."""
    raw = spark.read.text(path).where(strip(F.col("value")) != "")
    m = F.from_json("value", "map<string,string>", {"mode": "FAILFAST"})
    rows = raw.select(m.alias("m"))
    known = [F.col("m")[c].alias(c) for c in CHUNK_FIELDS]
    nested = F.coalesce(F.from_json(F.col("m")["extra"], "map<string,string>"), F.create_map().cast("map<string,string>"))
    tail = F.map_filter("m", lambda k, v: ~k.isin([*CHUNK_FIELDS, "extra"]))
    # A declared field beats a nested key; a top-level tail key beats the nested one.
    keep = F.map_filter(nested, lambda k, v: ~k.isin(CHUNK_FIELDS) & ~F.map_contains_key(tail, k))
    out = rows.select(*known, F.map_concat(keep, tail).alias("extra"))
    return require(out, REQUIRED)


def require(df: DataFrame, cols: list[str]) -> DataFrame:
    """Raise on a null or blank required field while the rows stream through."""
    bad = F.lit(False)
    for c in cols:
        bad = bad | (F.coalesce(strip(F.col(c)), F.lit("")) == "")
    return df.withColumn(cols[0], F.when(bad, F.raise_error(F.lit("missing required field"))).otherwise(F.col(cols[0])))


def write_chunks(df: DataFrame, path: str) -> int:
    """Validates, writes, returns the number of rows written."""
    from pyspark.sql import Observation

    seen = Observation()
    require(df, REQUIRED).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return int(seen.get["n"])


TRIPLE = T.StructType(
    [
        T.StructField(n, T.StringType()) for n in ("triple_id", "subject", "subject_type", "predicate", "object", "object_type")
    ]
    + [
        T.StructField("confidence", T.DoubleType()),
        T.StructField("provenance", T.StructType([T.StructField(n, T.StringType()) for n in ("sentence_id", "sentence_text", "source_block_id", "source_doc_id")])),
    ]
)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """Bad lines are dropped; a confidence of zero becomes one."""
    rows, _ = read_tolerant(spark, path, TRIPLE, F.coalesce("triple_id", F.lit("?")))
    conf = F.coalesce(F.when(F.col("confidence") != 0, F.col("confidence")), F.lit(1.0))
    return rows.withColumn("confidence", conf).select("*", "provenance.*").drop("provenance")


def block_key(*cols: str) -> Column:
    """Aliased keys: the first that is neither null nor blank."""
    return falsy_or(*[F.col(c) for c in cols])


def replace_table(df: DataFrame, path: str) -> None:
    """Replaces the whole set."""
    df.write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """CSV report with a header; reports are small aggregates."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
