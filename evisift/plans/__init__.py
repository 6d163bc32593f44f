"""Importing this package fills the query catalogue."""

from ..registry import CATALOGUE
from . import cleaning, evaluate, extract, gates, graph, reports, search, storage, vectors  # noqa: F401

__all__ = ["CATALOGUE"]
