"""Operators of a training-data pipeline. Nothing outside this package and corpus_pipeline.py imports it."""

from . import decontaminate, embeddings, language, mixing, negatives, periods, pieces, pii, quality, repeats, sharding, simhash, token_counts  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
