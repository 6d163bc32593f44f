"""Language identification by compression (operator 6).

Each language has a raw-content zstandard dictionary of sample text. A text is compressed with each of them and the
language with the fewest bytes wins; the answer is marked as rejected when the runner-up is within a margin.
Long texts are compressed in pieces of equal dictionary help, all of them, so that the end of a text counts like its start.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, table
from .registry import query

#: Documented bounds of the fit: so many rows of each language, so many characters from the middle of each, so many bytes of dictionary.
FIT_ROWS, FIT_CHARS, DICT_BYTES = 256, 1024, 120 << 10
#: Parts in which the rows of a language are ranked first.
BUCKETS = 64
#: Characters compressed together.
PIECE = 1024
LEVEL = 9
#: Relative gain over the runner-up below which an answer is rejected.
MARGIN = 0.01
UNKNOWN = "und"
OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower-case words of letters, blank-separated."""
    return OTHER.sub(" ", text.lower()).strip()


def fit(df: DataFrame, text: str = "text", lang: str = "lang", rows: int = FIT_ROWS) -> dict[str, bytes]:
    """Dictionary by language from at most ``rows`` distinct texts of each (least hash first), the middle FIT_CHARS characters of each, cut to DICT_BYTES in all.

    Rows with null text or language are left out. The driver gets at most rows x FIT_CHARS characters for each language.
    """
    known = df.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    # Copies collapse; the least hashes of each bucket of a language come first, then the least of those, so a common language is no hot key.
    few = known.select("lang", "h").distinct().withColumn("b", F.pmod("h", F.lit(BUCKETS)))
    for by in (["lang", "b"], ["lang"]):
        few = few.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("r") <= rows)
    chosen = few.select("lang", "h")
    start = F.greatest(F.lit(1), ((F.length("text") - FIT_CHARS) / 2).cast("int") + 1)
    got = known.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min(F.substring("text", start, F.lit(FIT_CHARS))).alias("part")).orderBy("lang", "h").collect()
    parts: dict[str, list[bytes]] = {}
    for r in got:
        parts.setdefault(r["lang"], []).append(letters(r["part"]).encode())
    return {k: b" ".join(v)[:DICT_BYTES] for k, v in sorted(parts.items())}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = sorted(dictionaries)
        self.compress = []
        for k in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[k] or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compress.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def classify(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, relative margin); ties go to the first language by name."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0
        clean = letters(text)
        pieces = [clean[i : i + PIECE].encode() for i in range(0, len(clean), PIECE)] or [b""]
        sizes = [sum([len(c(p)) for p in pieces]) for c in self.compress]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min((n for i, n in enumerate(sizes) if i != best), default=2 * sizes[best])
        margin = (second - sizes[best]) / second
        return self.langs[best], 1 / (1 + 2 ** -(20 * margin)), margin


_READY: dict[str, Classifier] = {}


def identify(df: DataFrame, dictionaries: dict[str, bytes], text: str = "text", margin: float = MARGIN) -> DataFrame:
    """``df`` with lang_pred, score (0 to 1) and rejected (the margin is narrow, or there is nothing to tell by).

    Null texts and texts without a letter are ``und`` with score 0, rejected. Whole texts count. Row-local; the
    dictionaries (DICT_BYTES for each language) are broadcast. No other column of ``df`` is looked at.
    """
    key, sent = uuid.uuid4().hex, df.sparkSession.sparkContext.broadcast(dictionaries)

    def make(batch: pa.RecordBatch) -> dict:
        if key not in _READY:
            _READY.clear()
            _READY[key] = Classifier(sent.value)
        rows = [_READY[key].classify(t) for t in batch.column(text).to_pylist()]
        return {"lang_pred": pa.array([r[0] for r in rows], pa.string()), "score": pa.array([r[1] for r in rows], pa.float64()), "rejected": pa.array([r[2] < margin for r in rows], pa.bool_())}

    return map_rows(df, text, [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("rejected", T.BooleanType())], make)


def held_out():
    """Remainder 1 of the checksum of doc_id as text; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


@query("op6_compression_language")
def op6_compression_language(spark, sf_dir):
    """Predicted language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = fit(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), learned).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
