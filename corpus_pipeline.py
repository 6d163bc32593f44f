"""Document pipeline: quality, near-duplicates, benchmark leaks, personal data, tokens.

Every stage takes (spark, docs, sf_dir), works on all rows it is given and returns the columns of its input; the last adds
its own. Nulls, empty texts, repeated rows and empty tables are defined by the operators; columns besides those of the
documents table pass through all stages, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evisift.llm.common import stored, table, text_key
from evisift.llm.decontaminate import decontaminate
from evisift.llm.pieces import encode
from evisift.llm.pii import DEMO_KEY, feistel_pseudonyms
from evisift.llm.quality import fit, score
from evisift.llm.simhash import near_duplicate_groups
from evisift.llm.vocab import TOKENIZERS, model_pieces

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _plain(docs: DataFrame) -> DataFrame:
    """Columns besides COLUMNS under names no operator uses."""
    return docs.toDF(*(c if c in COLUMNS else f"_extra{i}" for i, c in enumerate(docs.columns)))


def _restored(out: DataFrame, docs: DataFrame, *more: str) -> DataFrame:
    names = [c if c in COLUMNS else f"_extra{i}" for i, c in enumerate(docs.columns)]
    kept = [m for m in more if m not in docs.columns]
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)), *kept)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    plain = _plain(docs)
    model = fit(plain, table(spark, sf_dir, "labels"))
    return _restored(score(plain, model).where("keep"), docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five words, 0.8): the smallest doc_id (a null id only if there is no other), one of equal rows."""
    k1, k2 = text_key("text")
    plain = _plain(docs).withColumns({"_key1": k1, "_key2": k2})
    groups = near_duplicate_groups(plain, carry=("_key1", "_key2"))
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "_key1", "_key2")).alias("r")).select("r.doc_id", "r._key1", "r._key2")
    same = groups.groupBy("doc_id", "_key1", "_key2").count()
    on = ["doc_id", "_key1", "_key2"]
    names = first.toDF("_id", "_k1", "_k2")
    match = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key1") == F.col("_k1")) & (F.col("_key2") == F.col("_k2"))
    marked = stored(same.join(names, match, "left_semi"), "kept").toDF("_id", "_k1", "_k2", "_n")
    kept = plain.join(marked, match)
    # Rows that share id and text (whatever else they hold) are one document: one whole row stays.
    one = kept.where("_n = 1").select(*plain.columns)
    row = [c for c in plain.columns if c not in on]
    several = kept.where("_n > 1").groupBy(*on).agg(F.first(F.struct(*row)).alias("_r")).select(*on, "_r.*")
    return _restored(one.unionByName(several), docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return _restored(decontaminate(_plain(docs), table(spark, sf_dir, "benchmark")).where(F.size("hits") == 0), docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms; n_chars follows where a text has changed."""
    out = feistel_pseudonyms(_plain(docs), DEMO_KEY, out="text", spans="_spans")
    changed = F.when(F.size("_spans") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return _restored(out.withColumn("n_chars", changed), docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their SentencePiece ids."""
    out = encode(_plain(docs), model_pieces(f"{TOKENIZERS}/piece_bpe_32k.model"), out="ids")
    return _restored(out.withColumn("n_pieces", F.size("ids").cast("long")), docs, "ids", "n_pieces")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("SentencePiece encoding and decoding", token_stage),
]

#: No stage but the third can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, "stage")
    return docs
