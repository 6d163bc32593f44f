"""Every registered query runs at the smallest scale; those with oracle SQL must agree with it."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    status, n, _, _, note = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert status in ("ok", "rows"), note


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_partitioning_does_not_change_results(spark):
    from pyspark.sql import functions as F

    from evisift.operators import dedupe as D

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    few, many = (D.simhash(docs.repartition(n), "doc_id", "text").orderBy("doc_id").agg(F.md5(F.concat_ws(",", F.collect_list("fp")))).first()[0] for n in (1, 16))
    assert few == many
