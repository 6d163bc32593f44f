"""Readers, writers, banks and streaming jobs."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evisift.sources import bank as B, config, jsonl as J, pages as P
from evisift.streaming import logs as L

S = T.StructType([T.StructField("id", T.StringType()), T.StructField("x", T.IntegerType())])


def test_strict_and_tolerant(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "1", "x": 1}\n\n{"id": "", "x": 2}\nnot json\n[1, 2]\n{"id": "2"}\n')
    rows, stats = J.read_tolerant(spark, str(p), S, F.col("id"))
    assert {r["id"] for r in rows.collect()} == {"1", "2"}
    assert stats.first().asDict() == {"read": 6, "parsed": 2, "skipped": 3, "errors": 1}
    with pytest.raises(Exception):
        J.read_strict(spark, str(p), S).collect()


def test_chunk_store(spark, tmp_path):
    base = {k: "v" for k in J.REQUIRED}
    p = tmp_path / "c.jsonl"
    p.write_text(json.dumps({**base, "custom": "top", "extra": {"custom": "nested", "doc_id": "bad", "more": "m"}}))
    r = J.read_chunks(spark, str(p)).first()
    assert r["doc_id"] == "v" and r["extra"] == {"custom": "top", "more": "m"}
    p.write_text(json.dumps({**base, "text": "  "}))
    with pytest.raises(Exception, match="missing required"):
        J.read_chunks(spark, str(p)).collect()


def test_triples_confidence_zero_becomes_one(spark, tmp_path):
    p = tmp_path / "t.jsonl"
    p.write_text('{"triple_id": "t", "subject": "a", "predicate": "p", "object": "b", "confidence": 0, "provenance": {"sentence_id": "s"}}\nbroken\n')
    rows = J.read_triples(spark, str(p)).collect()
    assert len(rows) == 1 and rows[0]["confidence"] == 1.0 and rows[0]["sentence_id"] == "s"


def test_bank(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i), 1.0], i % 3 == 0) for i in range(50)], "rid int, item array<float>, is_table boolean")
    B.save_bank(df, str(tmp_path / "bank"), shard_size=10)
    assert B.load_bank(spark, str(tmp_path / "bank"), tables=True).count() == 17
    B.save_bank(df.unionByName(spark.createDataFrame([(99, [1.0], False)], df.schema)), str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="dimension"):
        B.load_bank(spark, str(tmp_path / "bad"))


def test_tables(one):
    html = "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td></tr><tr><td>2</td><td>3</td><td>4</td></tr></table><table><tr><td>x</td></tr></table>"
    r = one(P.tables_to_markdown(P.html_tables(F.col("c"))), c=html)
    assert r["markdown"].split("\n") == ["<!-- table:0 -->", "", "| A | B |", "| --- | --- |", "| 1 |  |", "| 2 | 3 |"]
    assert [(m["table_id"], m["rows"], m["cols"]) for m in r["metas"]] == [(0, 3, 2)]


def test_html_text(one):
    assert one(P.html_text(F.col("c")), c="<p>a &amp; b<script>x</script><!-- c --><br>d") == "a & b\nd"


def test_config_defaults(tmp_path):
    assert len(config.load_relations()) == 19
    assert config.load_rules(None, "location", "list")["signals"]["bullets"] == []
    p = tmp_path / "c.json"
    p.write_text('{"hard": ["abbr:X"], "soft": []}')
    assert config.load_contracts(str(p))[0]["level"] == "hard"
    assert config.load_json(tmp_path / "none.json", 1) == 1


def test_append_is_exactly_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    df = spark.range(20).select("id", (F.col("id") % 5).alias("k"))
    df.write.parquet(src)
    run = lambda: L.append_log(L.file_stream(spark, src, df.schema), out, ck)
    run()
    run()
    assert spark.read.schema(df.schema).json(out).count() == 20
    df.select(F.col("id") + 100, "k").toDF("id", "k").write.mode("append").parquet(src)
    run()
    assert spark.read.schema(df.schema).json(out).count() == 40


def test_import_once_across_batches(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    df = spark.range(20).select((F.col("id") % 5).alias("k"), F.lit("q").alias("q"))
    df.write.parquet(src)
    for _ in range(2):
        L.import_once(L.file_stream(spark, src, df.schema), ["q", "k"], out, ck)
        df.write.mode("append").parquet(src)
    assert spark.read.schema(df.schema).parquet(out).count() == 5


def test_stream_queries_agree_on_one_file_and_on_part_files(spark, tmp_path):
    from evisift.plans import CATALOGUE

    one = "/root/testdata/sf0.001"
    spark.read.parquet(f"{one}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("append_stream", "import_stream"):
        first, many = (sorted(map(tuple, CATALOGUE[name].fn(spark, d).collect())) for d in (one, str(tmp_path)))
        assert first and first == many, name


def test_merge_batch(spark, tmp_path):
    write = L.merge_batch(str(tmp_path / "t"), ["k"])
    for lo in (0, 3):
        write(spark.range(lo, lo + 5).select(F.col("id").alias("k")), lo)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 8


def test_resume(spark):
    ex = spark.createDataFrame([(f"q{i}", i) for i in range(5)], "id string, ord int")
    assert [r["id"] for r in L.resume(ex, ex.where("ord < 2").select("id")).orderBy("ord").collect()] == ["q2", "q3", "q4"]
    with pytest.raises(Exception, match="does not match"):
        L.resume(ex, ex.where("ord = 3").select("id")).collect()


def test_page_files_with_failures_as_rows(spark, tmp_path):
    """Stem ids, nested folders, pages by form feed, a file that is no text, one without a byte (not listed), no file at all."""
    from evisift.operators import chunking as K
    from evisift.sources import pages as P

    long = "word " * 400
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "one.v2.txt").write_bytes(f"{long}\ftoo short\f  {'x' * 49}  \f{'y' * 50}\f".encode())
    (tmp_path / "two.txt").write_bytes(b"\xff\xfe\x00bad")
    (tmp_path / "none.txt").write_bytes(b"")
    (tmp_path / "other.md").write_text(long)
    rows = P.read_page_files(spark, str(tmp_path))
    got = sorted((r["doc_id"], r["page_no"], r["error"]) for r in rows.collect() if r["error"])
    assert got == [("two", None, "not UTF-8")]
    assert [r["page_no"] for r in rows.where("doc_id = 'one.v2'").orderBy("page_no").collect()] == [1, 2, 3, 4]
    chunks = {r["chunk_id"]: r["text"] for r in K.page_chunks(rows).collect()}
    assert sorted(chunks) == ["one.v2_p1_c0", "one.v2_p1_c1", "one.v2_p4_c0"]
    assert len(chunks["one.v2_p1_c0"].split()) == 350 and len(chunks["one.v2_p1_c1"].split()) == 400 - 297
    with pytest.raises(FileNotFoundError):
        P.scan_files(spark, str(tmp_path), "*.pdf")


def test_page_files_keep_order_and_odd_pages(spark, tmp_path):
    from evisift.sources import pages as P

    rows = [("a", 3, "third"), ("a", 1, "first\nline\fsame page"), ("a", 2, None), ("b", 1, "only")]
    path = str(tmp_path / "out")
    P.write_page_files(spark.createDataFrame(rows, "doc string, no int, t string").repartition(3), "doc", "no", "t", path)
    back = P.read_page_files(spark, path, doc_id=F.regexp_extract("path", "/doc=([^/]+)/", 1))
    got = sorted((r["doc_id"], r["page_no"], r["text"]) for r in back.collect())
    assert got == [("a", 1, "first\nline same page"), ("a", 2, ""), ("a", 3, "third"), ("b", 1, "only")]


def test_page_bundles_round_trip(spark, tmp_path):
    rows = [("a b/c", 2, "two\n\nlines \f end\n"), ("a b/c", 1, None), ("", 7, "x"), (None, 3, "n"), ("?", 1, "q"), ("é+%20\f\n1", 5, " 中\r\n"), *((f"d{i}", 0, "p") for i in range(40))]
    path = f"{tmp_path}/out"
    P.write_page_bundles(spark.createDataFrame(rows, "doc string, no int, t string").repartition(3), "doc", "no", "t", path, per_file=20)
    with open(f"{path}/part-bad.txt", "wb") as f:
        f.write(b"1 z\n\xff\f")
    back = P.read_page_bundles(spark, path).collect()
    assert [(r.doc_id, r.page_no, r.text, r.error) for r in back if r.error] == [(None, None, None, "not UTF-8")]
    want = [("a b/c", 1, ""), ("a b/c", 2, "two\n\nlines   end\n"), ("", 1, "x"), (None, 1, "n"), ("?", 1, "q"), ("é+%20\f\n1", 1, " 中\r\n"), *((f"d{i}", 1, "p") for i in range(40))]
    key = lambda r: (r[0] or "", r[0] is None, r[1])
    assert sorted([(r.doc_id, r.page_no, r.text) for r in back if not r.error], key=key) == sorted(want, key=key)


def test_files_of_page_chunks_follow_the_text_not_the_documents(spark, tmp_path, monkeypatch):
    from pathlib import Path

    from evisift.plans import storage as S

    spark.createDataFrame([(64 * i, f"http://h{i}/x", "<p>" + "word " * 20) for i in range(200)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(S.B, "scratch_path", lambda *_: f"{tmp_path}/files")
    assert S.page_chunks(spark, str(tmp_path)).count() == 200
    assert len(list(Path(f"{tmp_path}/files").rglob("*.txt"))) < 50  # one for each of 200 documents before
