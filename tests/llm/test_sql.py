"""Queries against their SQL on the given tables."""

from collections import Counter

import duckdb
import pytest

from evisift.llm import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out = QUERIES[name](spark, SF)
    rows = con.execute(f"SELECT {', '.join(out.columns)} FROM ({SQL[name]})").fetchall()
    assert Counter(map(tuple, out.collect())) == Counter(rows) and rows
