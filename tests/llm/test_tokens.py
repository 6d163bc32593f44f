import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evisift.llm import pieces, token_counts
from evisift.llm.pieces import NONE, Chunk, Decoder, Model, Sent, advance, combine, decode, encode, normal
from evisift.llm.token_counts import WORD, Automaton, count_text
from evisift.llm.vocab import TOKENIZERS, model_pieces, ranked_pieces, word_pieces


def greedy(word, first, inner):
    n, at, known = 0, 0, first
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in known), None)
        if end is None:
            return 0
        n, at, known = n + 1, end, inner
    return n


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=5).map(str.encode), max_size=12), st.sets(st.text("abc", min_size=1, max_size=5).map(str.encode), max_size=12), st.lists(st.text("abc", min_size=1, max_size=14).map(str.encode), max_size=20))
def test_automaton_equals_greedy_matching(first, inner, words):
    a = Automaton(sorted(first), sorted(inner))
    b = Automaton.unpack(a.pack())
    for w in words:
        assert a.count(w) == b.count(w) == greedy(w, first, inner)


def test_automaton_equals_a_library_on_the_vocabulary(spark):
    """The word-piece model of an installed library, on bytes written as Latin-1 characters."""
    from tokenizers import Tokenizer
    from tokenizers.models import WordPiece

    first, inner = word_pieces(ranked_pieces(f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"))
    names = ["[UNK]", *dict.fromkeys([p.decode("latin-1") for p in first] + ["##" + p.decode("latin-1") for p in inner])]
    lib = Tokenizer(WordPiece({p: i for i, p in enumerate(names)}, unk_token="[UNK]", max_input_chars_per_word=10**6))
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    words = sorted({w.encode() for t in texts for w in WORD.findall(t)})
    a = Automaton(first, inner)
    assert [a.count(w) for w in words] == [len(e.ids) for e in lib.encode_batch([w.decode("latin-1") for w in words])]


def test_count_frame(spark):
    rows = [(1, None), (2, ""), (3, "ab abb, ab"), (3, "ab abb, ab"), (4, "a" * 200_000), (5, "zz ab")]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens string").withColumnRenamed("n_tokens", "text").selectExpr("*", "'x' AS n_words")
    out = token_counts.token_counts(df, [b"a", b"ab", b","], [b"a", b"b"]).collect()
    got = {r.doc_id: (r.n_tokens, r.n_words, r.n_unknown) for r in out}
    assert len(out) == 6
    assert got == {1: (0, 0, 0), 2: (0, 0, 0), 3: (5, 4, 0), 4: (200_000, 1, 0), 5: (2, 2, 1)}
    assert token_counts.token_counts(df.limit(0), [b"a"], []).count() == 0


def test_count_query(spark):
    first, inner = word_pieces(ranked_pieces(f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"))
    a, f, i = Automaton(first, inner), set(first), set(inner)
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in token_counts.op2_token_counts(spark, "/root/testdata/sf0.001").collect():
        words = WORD.findall(docs[r.doc_id])
        assert (r.n_tokens, r.n_words, r.n_unknown) == (sum(greedy(w.encode(), f, i) for w in words), len(words), 0)
    assert count_text("", a, {}) == (0, 0, 0)


@pytest.fixture(scope="module")
def vocabulary():
    return model_pieces(f"{TOKENIZERS}/piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model(vocabulary):
    return Model(vocabulary)


@pytest.fixture(scope="module")
def library(model):
    """The installed library's unigram encoder with the same vocabulary and scores."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(f"{TOKENIZERS}/piece_bpe_32k.model", "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        if p.type in (1, 4, 5):
            p.score = model.score[p.piece] / 256
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


def ids(raw):
    return np.frombuffer(raw, np.int32).tolist()


ODD = ["", " ", "a", " a  b ", "Hello  World\n\nab x é😀\t", "x" * 300, "漢字" * 40, "naïve   " + "   " * 20, "\x00\x01 ▁ z", "é"]


def test_encoding_equals_the_library(spark, model, library):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for t in ODD + [t[i : i + 500] for t in texts for i in range(0, min(len(t), 2000), 500)]:
        assert ids(model.encode(t)) == library.encode(t), t[:60]


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab the▁\n é漢 "), max_size=120), st.integers(16, 40))
def test_scan_over_chunks_equals_one_pass(vocabulary, text, size):
    m = Model(vocabulary)
    s, L = normal(text), m.longest
    chunks = [Chunk(m, s[max(0, a - L) : a + size], min(a, L)) for a in range(0, len(s), size)]
    v = np.full(L, NONE, np.int64)
    v[L - 1] = 0
    vectors = []
    for c in chunks:
        vectors.append(v)
        v = advance(v, c.matrix())
    x, out = L - 1, []
    for c, entry in zip(reversed(chunks), reversed(vectors), strict=True):
        part, x = c.back(entry.tolist(), x)
        out.append(part)
    assert b"".join(reversed(out)) == (m.encode(text) if text else ids and b"".join(reversed(out)))


def test_max_plus_product_is_associative():
    r = np.random.default_rng(5)
    a, b, c = (np.where(r.random((6, 6)) < 0.3, NONE, r.integers(-50, 0, (6, 6))) for _ in range(3))
    left, right = combine(combine(a, b), c), combine(a, combine(b, c))
    assert ((left == right) | ((left < NONE / 2) & (right < NONE / 2))).all()


def test_encode_frame_short_and_chunked_paths_agree(spark, vocabulary, model, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK", 3)  # several levels of the scan
    texts = [None, "", "short text", "word " * 100, "x" * 700, "the quick brown fox " * 60, "the quick brown fox " * 60, "漢" * 300, " " * 400]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'clash' AS ids")
    got = {r.doc_id: r.ids for r in encode(df, vocabulary, chunk=32).collect()}
    assert len(got) == len(texts) and got[0] is None
    for i, t in enumerate(texts[1:], 1):
        assert got[i] == ids(model.encode(t)), t[:40]
    back = {r.doc_id: r.decoded for r in decode(encode(df, vocabulary, chunk=32), vocabulary).collect()}
    assert [back[i] for i in range(len(texts))] == texts
    assert encode(df.limit(0), vocabulary).count() == 0
    with pytest.raises(ValueError):
        Sent(spark, vocabulary) and encode(df, vocabulary, chunk=2)


def test_encode_query(spark, model):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    out = pieces.op3_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert len(out) == len(docs)
    for r in out:
        assert r.round_trip and r.ids == ids(model.encode(docs[r.doc_id])) and r.n_pieces == len(r.ids)
