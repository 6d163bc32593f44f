"""Catalogue of named queries and, where SQL can express them, oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    ops: str
    fn: QueryFn
    sql: str | None


CATALOGUE: dict[str, Entry] = {}


def query(name: str, ops: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register ``fn(spark, sf_dir)`` under ``name``; ``ops`` lists the operator ids it covers."""

    def add(fn: QueryFn) -> QueryFn:
        if name in CATALOGUE:
            raise ValueError(f"duplicate query {name}")
        CATALOGUE[name] = Entry(name, ops, fn, sql)
        return fn

    return add
