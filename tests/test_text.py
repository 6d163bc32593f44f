"""Scalar text functions against small hand-made rows and independent Python restatements."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from evisift.functions import noise, sentences as N, text as T, tokens
from evisift.operators import dedupe as D

C = F.col("c")


def test_normalize_strips_unicode_space_and_joins_hyphens(one):
    assert one(T.normalize_text(C), c=" Über-\nall ") == "Überall"
    assert one(T.normalize_text(C), c="\n  a\r\r\r\rb\t\tc ﬁn�­ ") == "a\n\nb c fin"


@pytest.mark.parametrize("text,want", [("x かな 中", "ja"), ("中文", "zh"), ("plain", "en"), ("ｱ", "ja")])
def test_languages(one, text, want):
    assert one(T.detect_lang(C), c=text) == want


def simhash_py(text):
    toks = [t.lower() for t in re.findall(r"[A-Za-z0-9]+|[一-鿿]", text)]
    if not toks:
        return hashlib.sha256(text.encode()).digest()[:8].hex()
    v = [0] * 64
    for t in toks:
        x = int.from_bytes(hashlib.md5(t.encode()).digest()[:8], "little")
        for i in range(64):
            v[i] += 1 if x >> i & 1 else -1
    return sum(1 << i for i in range(64) if v[i] > 0).to_bytes(8, "little").hex()


def test_simhash_fixture_rows(spark):
    texts = ["", "   ", "123 456", "中文字", "a a a b", "The quick brown fox", "ünï code", "x" * 50 + " y"] + [f"w{i} " * (i + 1) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    got = {r["id"]: r["fp"] for r in D.simhash(df, "id", "t").collect()}
    assert got == {i: simhash_py(t) for i, t in enumerate(texts)}


def test_content_key_is_reversed_sha(one):
    want = int.from_bytes(hashlib.sha256("abc".encode()).digest()[:8], "little").to_bytes(8, "big").hex()
    assert one(T.content_key(C), c="abc") == want


def test_quality_rules(one):
    assert one(T.quality_score(C), c="short") == 0.0
    assert one(T.quality_score(C), c="word " * 20 + "zzzzzzzzz") == 0.2
    assert one(T.quality_score(C), c="word " * 20) == 1.0


def test_sentence_splitters_differ(one):
    s = "pH 3.14 is e.g. low.一。二！"
    got = {k: one(f(C), c=s) for k, f in {
        "a": N.split_units, "b": N.split_ws_semicolon, "c": N.split_claims, "d": N.split_cjk_stops, "e": N.split_keep_stop, "f": N.split_ascii, "g": N.split_ws}.items()}
    assert got["a"] == ["pH 3.", "14 is e.", "g.", "low.", "一。", "二！"]
    assert got["b"] == ["pH 3.14 is e.g.", "low.一。二！"] == got["c"] == got["f"] == got["g"]
    assert got["d"] == ["pH 3.14 is e.g. low.一", "二"]
    assert got["e"] == ["pH 3.", "14 is e.", "g.", "low.", "一。", "二！"]


def test_offsets_point_at_the_sentence(one):
    s = "A b. A b. C\nA b."
    for p in one(N.with_offsets(C, N.split_units(C)), c=s):
        assert s[p["offset"] : p["offset"] + len(p["text"])] == p["text"]


def test_offsets_of_units_need_no_search(one):
    import inspect

    from evisift.operators import extract as X

    for s in ("A b. A b. C\nA b.", "", " .", "\u3000x.  \n\ny\x1ez!\u00a0 w\u3002\u3002v", "a\uffffb. c\uffff d.\n", "é. 🙂! " * 700, None):
        assert one(N.units_at(C), c=s) == one(N.with_offsets(C, N.split_units(C)), c=s)
    assert "with_offsets" not in inspect.getsource(X.sentence_table)  # a search from the start of the text for each sentence
    many = "A b. " * 100_000  # the time was quadratic in the text before
    last = one(F.element_at(N.units_at(C), -1), c=many)
    assert last["offset"] == 5 * 99_999 and last["text"] == "A b."


def test_simhash_of_bytes_is_simhash_of_tokens(spark, tmp_path, monkeypatch):
    texts = ["", "a", "Ab cD-9 中文x 中", " ,.", "ÉaK9\u212a \n一鿿鿿", "b " * 9 + "c", "龥㐀ab", None]

    def plain(t):
        toks = [x.lower() for x in re.findall("[A-Za-z0-9]+|[\u4e00-\u9fff]", t)]
        if not toks:
            return hashlib.sha256(t.encode()).hexdigest()[:16]
        bits = [bin(int.from_bytes(hashlib.md5(x.encode()).digest()[:8], "big"))[2:].zfill(64) for x in toks]
        return f"{int(''.join('1' if 2 * sum(b[i] == '1' for b in bits) > len(bits) else '0' for i in range(64)), 2):016x}"

    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r["id"]: r["fp"] for r in D.simhash(df, "id", "t").collect()}
    assert got == {i: None if t is None else plain(t) for i, t in enumerate(texts)}
    # near_dedupe asks for the fingerprints twice; before, it made them twice as well.
    ran = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            ran.add(b.num_rows)
            yield b

    few = df.where("t is not null")
    D.near_dedupe(D.simhash(few.mapInArrow(seen, few.schema), "id", "t").withColumnRenamed("id", "ord")).collect()
    assert ran.value == len(texts) - 1


def test_squash_leaves_single_blanks(one):
    ws = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000"
    for s in ("a b", "a  b", "a" + ws + "b", *(f"a{w}b c{w}{w}d" for w in ws), "\u200bx\u3001 y"):
        assert one(T.squash(C), c=s) == " ".join(re.split(f"[{ws}]+", s)).strip()
    assert "[^ ]" in __import__("evisift.functions.chars", fromlist=["LOOSE"]).LOOSE  # single blanks were rewritten one by one before


def test_seeds_cut_a_text_once(one, spark):
    plan = lambda c: spark.range(1).select(F.col("id").cast("string").alias("c")).select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    for s in (None, "", "Abstract " + "word " * 30 + ". Methods follow here, " + "more words than before in this one sentence; " * 4, "Short. " + "A sentence of more than eight words which is long enough to be taken. " * 3,
              "x" * 50 + ". " + "Mice were infected with the virus and samples were taken in the second week! " * 2 + "tail \n\n Introduction " + "z " * 90):
        got = one(noise.seeds(C), c=s)
        assert got["window"] == one(noise.abstract_window(C), c=s)
        assert got["seed"] == one(noise.seed_sentence_generic(C), c=s)
        assert got["abstract_seed"] == one(noise.seed_sentence_abstract(noise.truncate_abstract_tail(C)), c=s)
    assert plan(noise.seed_sentence_generic(C)).count("split(") == 2  # sentences, and the words of one; three before


def test_wrapped_lines_and_noise(one):
    raw = "This is a wrap-\nped line that\ngoes on.\nNext one\n\nTable 1. caption\nx = y + z * w ^ 2\nkept [1-3] text (Smith et al., 2020)\nReferences\nold stuff"
    assert one(T.clean_noise(C), c=raw) == "This is a wrapped line that goes on.\nNext one\n\nTable 1. caption x = y + z * w ^ 2 kept  text  References old stuff".replace(
        "Table 1. caption x = y + z * w ^ 2 kept  text  References old stuff", ""
    ).strip()
    marked = "before\n<!-- table: 1 -->\nafter it"
    assert one(T.clean_noise(C), c=marked).split("\n")[0] == "before"


def test_headings(one):
    for line, want in [("Abstract", "abstract"), ("3.1. Results", "results"), ("II. Materials and Methods:", "methods"), ("Discussion. We show", "discussion"),
                       ("This is text", ""), ("Summary of long " + "x" * 200, "")]:
        assert one(noise.heading_section(C), c=line) == want, line


def test_low_value_sentences(one):
    assert one(noise.is_low_value_sentence(C), c="References:")
    assert one(noise.is_low_value_sentence(C), c="see 10.1234/abc.def for it")
    assert one(noise.is_low_value_sentence(C), c="Smith et al. (2020) said so")
    assert not one(noise.is_low_value_sentence(C), c="Patients had fever and rash.")


def tokens_py(text):
    out = set()
    chars = re.findall(r"[一-鿿]", text)
    out |= {a + b for a, b in zip(chars, chars[1:])}
    low = text.lower()
    out |= set(re.findall(r"[a-zA-Z]{2,}", low)) | set(re.findall(r"\b[a-zA-Z]{1,6}\d{2,8}\b", low)) | set(re.findall(r"\bdb\d+\b", low))
    return out | set(re.findall(r"\b\d{2,8}\b", text))


@pytest.mark.parametrize("t", ["DB04844 and p13569, 2020 cases", "中文 and 字", "élan vital 12x 123456789", "", "a 1"])
def test_overlap_tokens(one, t):
    assert set(one(tokens.overlap_tokens(C), c=t)) == tokens_py(t)


def test_json_salvage(one):
    assert one(T.first_json_object(C), c='text ```json\n{"a": 1}\n``` more') == '{"a": 1}'
    assert one(T.first_json_object(C), c="none") is None
