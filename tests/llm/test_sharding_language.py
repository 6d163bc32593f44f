import zlib

from pyspark.sql import functions as F

from evisift.llm import language, sharding
from evisift.llm.sharding import byte_shards


def brute(rows, shards):
    total, at, out, slots = sum(n for _, n in rows), 0, [], {}
    for _, n in rows:
        s = min(shards - 1, (2 * at + n) * shards // (2 * total))
        out.append((s, slots.setdefault(s, 0)))
        slots[s] += 1
        at += n
    return out


def test_shards_equal_a_serial_cut(spark):
    rows = [(i, 1 + (i * 7919) % 97 + (5000 if i == 300 else 0)) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, size long").repartition(7)
    got = {r.k: (r.shard, r.slot) for r in byte_shards(df, "size", ["k"], 24).collect()}
    want = brute(rows, 24)
    assert [got[i] for i in range(1000)] == want


def test_shards_with_one_hot_key_nulls_and_few_rows(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2000, None).otherwise(F.col("id")).alias("k"), F.lit(10).cast("long").alias("size"), F.lit("x").alias("shard"))
    out = byte_shards(df, "size", ["k"], 6)
    assert out.columns == ["k", "size", "shard", "slot"]
    assert {(r.shard, r.n, r.top) for r in out.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("top")).collect()} == {(i, 500, 499) for i in range(6)}
    assert out.where("shard < 4 AND k IS NOT NULL").count() == 0, "nulls come first"
    assert byte_shards(df.limit(0), "size", ["k"]).count() == 0
    assert {r.shard for r in byte_shards(df.limit(1), "size", ["k"], 24).collect()} == {12}


def test_shard_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    out = sharding.op4_byte_shards(spark, "/root/testdata/sf0.01").collect()
    assert len(out) == len(docs)
    rows = [(i, len(docs[i].encode()) + 8) for i in sorted(docs)]
    want = dict(zip(sorted(docs), brute(rows, 24), strict=True))
    for r in out:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        assert (r.shard, r.slot) == want[r.doc_id]
    sums = [sum(r.size for r in out if r.shard == s) for s in range(24)]
    assert max(sums) - min(sums) < 2 * max(n for _, n in rows)


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang")
    out = language.op6_compression_language(spark, "/root/testdata/sf0.1").join(docs, "doc_id")
    r = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("all"), F.avg(F.when(~F.col("rejected"), (F.col("lang") == F.col("lang_pred")).cast("int"))).alias("sure"), F.avg(F.col("rejected").cast("int")).alias("share")).first()
    assert r["all"] > 0.98 and r["sure"] > 0.99 and r["share"] < 0.05
    checks = out.agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert checks["n"] == docs.count() and 0 <= checks["low"] and checks["high"] <= 1
    one = out.select("doc_id", "held_out").limit(50).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in one)


def test_language_edge_cases(spark):
    rows = [("en", "the house and the garden are in the town with all of the people"), ("de", "das haus und der garten sind in der stadt mit allen den leuten"), (None, "no language"), ("en", None), ("fr", "12 34")]
    learned = language.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert sorted(learned) == ["de", "en"], "texts without a letter teach nothing"
    texts = [(1, None), (2, ""), (3, "12 !? 34"), (4, "und der garten in der stadt"), (5, "the people in the town " * 9000), (6, "and the garden"), (6, "and the garden")]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'xx' AS lang", "'clash' AS score")
    out = language.identify(df, learned).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == 7
    assert [(got[i].lang_pred, got[i].score, got[i].rejected) for i in (1, 2, 3)] == [("und", 0.0, True)] * 3
    assert [got[i].lang_pred for i in (4, 5, 6)] == ["de", "en", "en"]
    assert {r.lang_pred for r in language.identify(df, {}).collect()} == {"und"}
    assert language.identify(df.limit(0), learned).count() == 0
    same = language.Classifier({"b": b"one", "a": b"one"})
    assert same.classify("zzz")[0] == "a" and same.classify("zzz")[2] == 0, "a tie goes to the first name and is narrow"
