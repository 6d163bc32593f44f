"""Windowing of token lists into chunks and blocks.

Every function works inside the row: one array of tokens in, one array of window
structs out, then a generator. No shuffle and no Python is involved, so the cost
is linear in the text whatever the number of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import explode_rows
from ..functions.text import bind, content_key, detect_lang_two_way, squash, strip


def words(c: Column) -> Column:
    """Whitespace words of a text; empty array for a blank text."""
    return F.filter(F.split(squash(c), " "), lambda w: w != "")


def _starts(n: Column, step: int) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))).otherwise(
        F.array().cast("array<int>")
    )


def windows(tokens: Column, size: int, overlap: int) -> Column:
    """Windows with stop rule; the first window reaching the end is the last."""
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than the window")
    return bind(
        tokens,
        lambda t: _cut(t, F.filter(_starts(F.size(t), step), lambda s: (s == 0) | (s - step + size < F.size(t))), size),
    )


def _cut(t: Column, starts: Column, size: int) -> Column:
    return F.transform(
        starts,
        lambda s: F.struct(
            s.alias("start"), F.least(F.size(t), s + size).alias("end"), F.slice(t, s + 1, F.lit(size)).alias("tokens")
        ),
    )


def strided_blocks(tokens: Column, size: int, stride: int, drop_last_incomplete: bool = True) -> Column:
    """No end stop, so tails inside the previous block are emitted unless dropped."""
    def starts(t: Column) -> Column:
        every = _starts(F.size(t), stride)
        return F.filter(every, lambda s: s + size <= F.size(t)) if drop_last_incomplete else every

    return bind(tokens, lambda t: _cut(t, starts(t), size))


def word_chunks(c: Column, target: int = 350, overlap_ratio: float = 0.15) -> Column:
    """Whitespace-word chunks; the step is max(1, int(target * (1 - ratio)))."""
    step = max(1, int(target * (1.0 - overlap_ratio)))
    return windows(words(c), target, target - step)


def explode_windows(df: DataFrame, wins: Column, keys: list[str], prefix: str) -> DataFrame:
    """One row per window with ``{prefix}_no``, ``start``, ``end`` and the joined text."""
    out = explode_rows(df, keys, wins, f"{prefix}_no", "w")
    return out.select(
        *keys,
        f"{prefix}_no",
        F.col("w.start").alias("start"),
        F.col("w.end").alias("end"),
        F.array_join("w.tokens", " ").alias("text"),
    )


def page_chunks(pages: DataFrame, min_chars: int = 50, target: int = 350, overlap_ratio: float = 0.15) -> DataFrame:
    """Chunks of ``pages(doc_id, page_no, text)``, never across pages; pages under ``min_chars`` stripped characters have none.

    ``chunk_id`` is ``{doc}_p{page}_c{chunk}`` with chunks numbered from 0 within the page. Null texts have no chunk.
    """
    rows = pages.select("doc_id", "page_no", strip(F.col("text")).alias("_t")).where(F.length("_t") >= min_chars)
    cut = explode_windows(rows, word_chunks(F.col("_t"), target, overlap_ratio), ["doc_id", "page_no"], "chunk")
    name = F.concat(F.col("doc_id").cast("string"), F.lit("_p"), F.col("page_no").cast("string"), F.lit("_c"), F.col("chunk_no").cast("string"))
    return cut.select(
        "doc_id", name.alias("chunk_id"), "page_no", "chunk_no", "text",
        detect_lang_two_way(F.col("text")).alias("lang"), content_key(F.col("text")).alias("dedupe_hash"),
    )


def two_level_blocks(df: DataFrame, tokens: Column, keys: list[str], chunk: int, block: int) -> DataFrame:
    """Non-overlapping chunks cut into non-overlapping blocks; ids carry offsets."""
    chunks = explode_rows(df, keys, windows(tokens, chunk, 0), "chunk_no", "c")
    heads = [*keys, "chunk_no", F.col("c.start").alias("chunk_start")]
    blocks = explode_rows(chunks, heads, windows(F.col("c.tokens"), block, 0), "block_no", "b")
    start = F.col("chunk_start") + F.col("b.start")
    return blocks.select(
        *keys, "chunk_no", "block_no", start.alias("start"),
        (F.col("chunk_start") + F.col("b.end")).alias("end"),
        F.concat_ws(":", *[F.col(k).cast("string") for k in keys], start.cast("string")).alias("block_id"),
        F.array_join("b.tokens", " ").alias("text"),
    )
