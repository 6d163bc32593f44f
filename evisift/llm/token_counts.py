"""Token counts by a linear longest-match automaton (operator 2), after Song et al., Fast WordPiece Tokenization (2021).

The vocabulary is a trie with two roots, for pieces that begin a word and pieces that continue one. Every node has a
failure link and the number of pieces that following it completes, so the greedy longest-match length of a word comes
from one pass over its bytes, without building a piece and without going back.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_rows, table
from .registry import query
from .vocab import TOKENIZERS, ranked_pieces, word_pieces

FIRST, INNER = 0, 1
#: Words up to this many bytes are remembered, at most CACHED of them for each Python worker (memory only, no effect on counts).
CACHED_BYTES, CACHED = 48, 300_000
WORD = re.compile(r"\w+|[^\w\s]")


class Automaton:
    """Transitions of a node by byte, failure links (-1: none) and pieces completed on following them."""

    def __init__(self, first: list[bytes], inner: list[bytes]):
        go: list[dict[int, int]] = [{}, {}]
        ends = [False, False]
        for root, pieces in ((FIRST, first), (INNER, inner)):
            for p in pieces:
                node = root
                for c in p:
                    if c not in go[node]:
                        go[node][c] = len(go)
                        go.append({})
                        ends.append(False)
                    node = go[node][c]
                ends[node] = node > INNER
        fail, pops = [-1] * len(go), [0] * len(go)
        level = [FIRST, INNER]
        while level:
            below = []
            for u in level:
                for c, v in go[u].items():
                    below.append(v)
                    if ends[v]:
                        fail[v], pops[v] = INNER, 1
                        continue
                    z, n = fail[u], pops[u]
                    while z >= 0 and c not in go[z]:
                        n += pops[z]
                        z = fail[z]
                    if z >= 0:
                        fail[v], pops[v] = go[z][c], n
            level = below
        self.go, self.fail, self.pops = go, fail, pops

    def count(self, word: bytes) -> int:
        """Greedy longest-match pieces of a word, 0 if some part has none (an unknown word)."""
        go, fail, pops = self.go, self.fail, self.pops
        node, n = FIRST, 0
        for c in word:
            while (to := go[node].get(c)) is None:
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return 0
            node = to
        while node != INNER:
            n += pops[node]
            node = fail[node]
            if node < 0:
                return 0
        return n

    def pack(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Arrays to send: (from node, byte, to node) rows, failure links, pops."""
        edges = np.array([(u, c, v) for u, t in enumerate(self.go) for c, v in t.items()], np.int32).reshape(-1, 3)
        return edges, np.array(self.fail, np.int32), np.array(self.pops, np.int32)

    @classmethod
    def unpack(cls, packed) -> Automaton:
        edges, fail, pops = packed
        self = cls.__new__(cls)
        self.fail, self.pops = fail.tolist(), pops.tolist()
        self.go = [{} for _ in self.fail]
        for u, c, v in edges.tolist():
            self.go[u][c] = v
        return self


_READY: dict[int, tuple[Automaton, dict[str, int]]] = {}


def _ready(packed) -> tuple[Automaton, dict[str, int]]:
    """The automaton of a broadcast variable and its word cache, kept by a Python worker between tasks."""
    if packed.id not in _READY:
        _READY.clear()
        _READY[packed.id] = Automaton.unpack(packed.value), {}
    return _READY[packed.id]


class _Sent:
    """A broadcast variable with an id that workers can tell apart."""

    def __init__(self, spark, value):
        import uuid

        self.id, self.broadcast = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    @property
    def value(self):
        return self.broadcast.value


def count_text(text: str, automaton: Automaton, cache: dict[str, int]) -> tuple[int, int, int]:
    """(pieces, words, unknown words) of a whole text; an unknown word counts as one piece."""
    pieces = unknown = 0
    words = WORD.findall(text)
    for w in words:
        n = cache.get(w)
        if n is None:
            raw = w.encode()
            n = automaton.count(raw)
            if len(raw) <= CACHED_BYTES:
                if len(cache) >= CACHED:
                    cache.clear()
                cache[w] = n
        pieces += n
        unknown += not n
    return pieces + unknown, len(words), unknown


def token_counts(df: DataFrame, first: list[bytes], inner: list[bytes], text: str = "text") -> DataFrame:
    """``df`` with n_tokens, n_words and n_unknown (longs) of the whole text.

    Words are runs of word characters or single other characters, no white space. Null and empty texts have zero of each.
    Row-local, so ties, repeated rows and hot sources need no care; a word of any length takes one pass. The two piece
    lists are vocabulary of a fixed size and are the only thing that is broadcast.
    """
    sent = _Sent(df.sparkSession, Automaton(first, inner).pack())

    def make(batch: pa.RecordBatch) -> dict:
        automaton, cache = _ready(sent)
        rows = [count_text(t or "", automaton, cache) for t in batch.column(text).to_pylist()]
        return {n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(("n_tokens", "n_words", "n_unknown"))}

    return map_rows(df, text, [(n, T.LongType()) for n in ("n_tokens", "n_words", "n_unknown")], make)


@query("op2_token_counts")
def op2_token_counts(spark, sf_dir, folder: str = TOKENIZERS):
    """Word-piece counts of every document with the multilingual byte vocabulary."""
    first, inner = word_pieces(ranked_pieces(f"{folder}/byte_bpe_multi_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, first, inner).drop("text")
