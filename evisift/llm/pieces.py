"""SentencePiece encoding and decoding by a max-plus scan (operator 3).

Encoding picks the segmentation with the largest sum of piece scores. Scores are integers, so sums are exact in any
order. The vocabulary file holds ranks, not log-probabilities; the score of a piece is Zipf's law over its rank
(``-ln(rank + 2)`` in units of 1/256). Blanks become U+2581, one is put in front, characters without a piece become
bytes, as in the library's unigram encoder. Among equal sums the longest last piece wins, again as in the library.

A giant text is cut into chunks anywhere. A path crosses a cut through one of the last L nodes before it (L: longest
piece), so a chunk is an L x L max-plus transfer matrix from the nodes before its start to those before its end.
Matrices are combined associatively, in blocks over several levels, into the exact scores at every cut; with them each
chunk gives its exit-to-entry map, the maps are composed from the end, and every chunk is backtraced by itself.

Within a chunk, no piece joins a blank to text in front of it and none has a line feed, so every path passes the node
before a run of blanks and those around a line feed. From such a node the best path to the next one depends on the run alone and is remembered.
"""

from __future__ import annotations

import math
import re
import uuid
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import appended, map_rows, plus, slices, stored, table, text_key
from .registry import query
from .vocab import TOKENIZERS, model_pieces

BLANK = "▁"
NONE = -(1 << 60)
#: Texts of more characters than this are cut into chunks of this many characters.
CHUNK = 65_536
#: Chunks whose matrices one task combines.
BLOCK = 64
#: Runs up to this many characters are remembered, at most CACHED of them for each Python worker.
CACHED_CHARS, CACHED = 48, 400_000
CUT = re.compile(f"(?<=\n)|(?=\n)|(?<!{BLANK})(?={BLANK})")
UNIT = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")


class Model:
    """Piece ids and scores by text, byte ids, and what has been encoded before."""

    def __init__(self, pieces: list[tuple[str, int]]):
        self.ids = {p: i for i, (p, kind) in enumerate(pieces) if kind in (1, 4, 5) and p}
        first = min(self.ids.values(), default=0)
        self.score = {p: -round(256 * math.log(i - first + 2)) for p, i in self.ids.items()}
        self.byte = {int(p[3:5], 16): i for i, (p, kind) in enumerate(pieces) if kind == 6}
        if len(self.byte) != 256:
            raise ValueError("the vocabulary has no piece for every byte")
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("a piece has a blank inside")
        #: A character without a piece: below every piece, as in the library.
        self.unknown = min(self.score.values(), default=0) - 2560
        self.longest = max(map(len, self.ids), default=1)
        #: Trie of dictionaries by character; the empty key holds (score, id) of a piece that ends there.
        self.trie: dict = {}
        for p, i in self.ids.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = self.score[p], i
        #: All pieces in a string, by end and then longest first.
        self.matcher = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.matcher.add_word(p, (len(p), self.score[p], i))
        self.matcher.make_automaton()
        self.single = frozenset(p for p in self.ids if len(p) == 1)
        self.newline = np.array([self.byte[10]], np.int32).tobytes()
        if any("\n" in p for p in self.ids):
            raise ValueError("a piece has a line feed")
        self.remembered: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.scores: dict[str, int] = {}

    def best(self, s: str, first: list[int], at: int, end: int):
        """Scores, predecessors and pieces of the nodes up to ``end``, given scores of the nodes up to ``at`` (negative nodes: none).

        ``first[i]`` is the score of node ``lo + i``; lo, the first returned value, is ``at - len(first) + 1``. A piece of
        None is a character without one.
        """
        lo = at - len(first) + 1
        size = end - lo + 1
        value, back, piece = first + [NONE] * (size - len(first)), [-1] * size, [None] * size
        trie, unknown = self.trie, self.unknown
        for u in range(max(lo, 0), end):
            v = value[u - lo]
            if v == NONE:
                continue
            node, one = trie, False
            for e in range(u, end):
                node = node.get(s[e])
                if node is None:
                    break
                leaf = node.get("")
                if leaf is not None:
                    k = e + 1 - lo
                    if e == u:
                        one = True
                    if e >= at and v + leaf[0] > value[k]:
                        value[k], back[k], piece[k] = v + leaf[0], u, leaf[1]
            if not one and u >= at:
                k = u + 1 - lo
                if v + unknown > value[k]:
                    value[k], back[k], piece[k] = v + unknown, u, None
        return lo, value, back, piece

    def walk(self, s: str, lo: int, back: list[int], piece: list, start: int, end: int) -> tuple[bytes, int]:
        """Ids (as int32 bytes) on the best path from the first node <= start to ``end``, and that node."""
        out: list[int] = []
        while end > start:
            at, i = back[end - lo], piece[end - lo]
            if i is None:
                out.extend(self.byte[b] for b in reversed(s[at:end].encode()))
            else:
                out.append(i)
            end = at
        out.reverse()
        return array("i", out).tobytes(), end

    def solve(self, u: str) -> tuple[bytes, int]:
        """Ids and score of the best path over a whole string."""
        if self.single.issuperset(u):  # every node can be reached by pieces
            n = len(u)
            value, back, piece = [0] + [NONE] * n, [0] * (n + 1), [0] * (n + 1)
            for e, (size, w, i) in self.matcher.iter(u):
                e += 1
                v = value[e - size] + w
                if v > value[e]:
                    value[e], back[e], piece[e] = v, e - size, i
            out, e = [], n
            while e:
                out.append(piece[e])
                e = back[e]
            out.reverse()
            return array("i", out).tobytes(), value[n]
        lo, value, back, piece = self.best(u, [0], 0, len(u))
        return self.walk(u, lo, back, piece, 0, len(u))[0], value[-1]

    def unit(self, u: str) -> bytes:
        """Ids of a run of blanks with the text up to the next blank."""
        got = self.remembered.get(u)
        if got is None:
            got = self.solve(u)[0]
            if len(u) <= CACHED_CHARS:
                if len(self.remembered) >= CACHED:
                    self.remembered.clear()
                self.remembered[u] = got
        return got

    def worth(self, u: str) -> int:
        """Score of the best path over a run."""
        got = self.scores.get(u)
        if got is None:
            got = self.solve(u)[1]
            if len(u) <= CACHED_CHARS:
                if len(self.scores) >= CACHED:
                    self.scores.clear()
                self.scores[u] = got
        return got

    def _word(self, w: str) -> bytes:
        got = self.solve(BLANK + w)[0]
        if len(w) <= CACHED_CHARS:
            if len(self.words) >= CACHED:
                self.words.clear()
            self.words[w] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids of a whole text in one go, as int32 bytes.

        Every path passes the nodes around a line feed (no piece has one) and before a run of blanks.
        """
        if not text:
            return b""
        get, word, out = self.words.get, self._word, []
        plain = BLANK not in text
        for i, line in enumerate(text.split("\n")):
            if i:
                out.append(self.newline)
            parts = line.split(" ")
            if plain and "" not in parts:
                out.append(self.unit(parts[0] if i else BLANK + parts[0]))
                out += [get(w) or word(w) for w in parts[1:]]
            else:
                out += [self.unit(u) for u in UNIT.findall(line.replace(" ", BLANK) if i else normal(line))]
        return b"".join(out)


class Decoder:
    def __init__(self, pieces: list[tuple[str, int]]):
        self.raw = [bytes([int(p[3:5], 16)]) if kind == 6 else p.encode() if kind in (1, 4, 5) else b"" for p, kind in pieces]

    def decode(self, ids) -> str:
        """Text of ids; one leading blank is dropped; ids out of range are an error."""
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode(errors="replace").replace(BLANK, " ")
        return text[1:] if text[:1] == " " else text


def normal(text: str) -> str:
    return BLANK + text.replace(" ", BLANK)


class Chunk:
    """One chunk of a text: ``s`` has up to L characters before the start node, ``at``, and ends at the end node."""

    def __init__(self, model: Model, s: str, at: int):
        self.m, self.s, self.at, self.end = model, s, at, len(s)
        self.width = model.longest
        #: Nodes that every path passes: where a run of blanks starts after other text, and around line feeds.
        self.cuts = [c for c in (x.start() for x in CUT.finditer(s)) if max(at, 1) <= c <= self.end]

    def matrix(self) -> np.ndarray:
        """Transfer matrix: [i, j] is the best score from entry node i to exit node j (window positions)."""
        L, out = self.width, np.full((self.width, self.width), NONE, np.int64)
        stop = self.cuts[0] if self.cuts else self.end
        tail = self.tail()
        for i in range(L):
            if self.at - L + 1 + i < 0:
                continue
            entry = [NONE] * L
            entry[i] = 0
            lo, value, _, _ = self.m.best(self.s, entry, self.at, stop)
            if self.cuts:
                to = value[stop - lo]
                if to > NONE:
                    for j, w in tail:
                        out[i, j] = to + w
                # An exit node before the first cut can be reached as well, when the chunk's end window reaches so far.
                for node in range(max(self.end - L + 1, 0), stop):
                    if value[node - lo] > NONE:
                        out[i, node - self.end + L - 1] = value[node - lo]
            else:
                for node in range(max(self.end - L + 1, 0), self.end + 1):
                    if node >= lo and value[node - lo] > NONE:
                        out[i, node - self.end + L - 1] = value[node - lo]
        return out

    def middle(self) -> list[str]:
        """Runs between the first and the last cut."""
        return [self.s[a:b] for a, b in zip(self.cuts, self.cuts[1:], strict=False)]

    def tail(self) -> list[tuple[int, int]]:
        """(exit position, score from the first cut) of the exit nodes from the first cut on."""
        if not self.cuts:
            return []
        L, total, scores = self.width, 0, {}
        for c, run in zip(self.cuts, [*self.middle(), None], strict=True):
            nxt = self.end if run is None else c + len(run)
            if nxt > self.end - L:
                lo, value, _, _ = self.m.best(self.s, [0], c, nxt)
                scores.update({n: total + value[n - lo] for n in range(max(c, self.end - L + 1), nxt + 1) if value[n - lo] > NONE})
            if run is not None:
                total += self.m.worth(run)
        return [(n - self.end + L - 1, w) for n, w in scores.items()]

    def back(self, entry: list[int], exit_at: int, ids: bool = True) -> tuple[bytes, int]:
        """Ids of the pieces after the entry node up to exit position ``exit_at``, and the entry position."""
        L = self.width
        end = self.end - L + 1 + exit_at
        cuts = [c for c in self.cuts if c <= end]
        out = []
        if cuts:
            if cuts[-1] < end:
                lo, _, back, piece = self.m.best(self.s, [0], cuts[-1], end)
                out.append(self.m.walk(self.s, lo, back, piece, cuts[-1], end)[0])
            if ids:
                out += [self.m.unit(self.s[a:b]) for a, b in reversed(list(zip(cuts, cuts[1:], strict=False)))]
            end = cuts[0]
        node = end
        if end > self.at:
            lo, _, back, piece = self.m.best(self.s, entry, self.at, end)
            found, node = self.m.walk(self.s, lo, back, piece, self.at, end)
            out.append(found)
        return b"".join(reversed(out)), node - self.at + L - 1


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(1), NONE)


def advance(vector: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.maximum((vector[:, None] + m).max(0), NONE)


_READY: dict[tuple[str, type], Model | Decoder] = {}


class Sent:
    """The vocabulary (fixed size) as a broadcast variable; workers keep the model between tasks."""

    def __init__(self, spark, pieces: list[tuple[str, int]]):
        self.id, self.broadcast = uuid.uuid4().hex, spark.sparkContext.broadcast(pieces)
        self.longest = Model(pieces).longest

    def get(self, kind: type):
        if (self.id, kind) not in _READY:
            for k in [k for k in _READY if k[0] != self.id]:
                del _READY[k]
            _READY[(self.id, kind)] = kind(self.broadcast.value)
        return _READY[(self.id, kind)]

    def model(self) -> Model:
        return self.get(Model)


def each(batch: pa.RecordBatch, *columns: str):
    """Rows one at a time, so that a batch of texts is not held twice."""
    for r in range(batch.num_rows):
        yield tuple(batch.column(c)[r].as_py() for c in columns)


def id_lists(rows: list[bytes | None]) -> pa.Array:
    """Arrow list<int32> of id bytes."""
    ends = np.cumsum([0, *(len(r or b"") // 4 for r in rows)]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(r or b"" for r in rows), np.int32))
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array([r is None for r in rows]))


IDS = T.ArrayType(T.IntegerType())


def encode(df: DataFrame, pieces: list[tuple[str, int]], text: str = "text", out: str = "ids", chunk: int = CHUNK, back: str | None = None) -> DataFrame:
    """``df`` with the piece ids of the whole text; ``back`` names a column for the text decoded from them again.

    Null stays null, an empty text has no ids. Texts of up to ``chunk`` characters are encoded where they are read. Longer
    ones go through the scan once for each distinct text and are joined back, with equal ids; repeated rows are repeated.
    """
    sent = Sent(df.sparkSession, pieces)

    def make(batch: pa.RecordBatch) -> dict:
        m = sent.model()
        made = [None if t is None else m.encode(t) for t in batch.column(text).to_pylist()]
        again = {} if back is None else {back: pa.array([None if r is None else sent.get(Decoder).decode(array("i", r)) for r in made], pa.string())}
        return {out: id_lists(made), **again}

    long_text = F.coalesce(F.length(text) > chunk, F.lit(False))
    fields = [(out, IDS)] if back is None else [(out, IDS), (back, T.StringType())]
    short = map_rows(df.where(~long_text), text, fields, make)
    k1, k2 = text_key(text)
    giant = df.where(long_text)
    wanted = [c for c in df.columns if c not in (out, back)]
    found = scan_encode(giant.select(k1, k2, F.col(text).alias("s")), sent, chunk)
    row, key1, key2, made = (f"_{uuid.uuid4().hex[:8]}" for _ in range(4))
    rows = giant.select(F.struct(*wanted).alias(row), k1.alias(key1), k2.alias(key2))
    keyed = rows.join(found.toDF(key1, key2, made), [key1, key2], "left").select(*(F.col(row)[c].alias(c) for c in wanted), F.col(made).alias(out))
    return short.unionByName(keyed if back is None else decode(keyed, pieces, out, back, sent))


def scan_encode(texts: DataFrame, sent: Sent, chunk: int) -> DataFrame:
    """(k1, k2, ids) of distinct texts (k1, k2, s) by the chunked scan."""
    L = sent.longest
    if chunk < L:
        raise ValueError("chunks must be at least as long as the longest piece")
    one = texts.groupBy("k1", "k2").agg(F.first("s").alias("s"))

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "s"):
                for k1, k2, s in each(part, "k1", "k2", "s"):
                    s = normal(s)
                    rows = [(k1, k2, c, len(s) <= a + chunk, min(a, L), s[max(0, a - L) : a + chunk]) for c, a in enumerate(range(0, len(s), chunk))]
                    for i in range(0, len(rows), 32):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[i : i + 32], strict=True)], names=["k1", "k2", "c", "last", "at", "s"])

    chunks = stored(one.mapInArrow(cut, "k1 long, k2 long, c long, last boolean, at long, s string"), "chunks")

    def matrices(batches):
        for batch in batches:
            m = sent.model()
            got = [Chunk(m, s, at).matrix().tobytes() for s, at in each(batch, "s", "at")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k1", "k2", "c")), pa.array(got, pa.binary())], names=["k1", "k2", "c", "m"])

    levels = [stored(chunks.select("k1", "k2", "c", "at", "s").mapInArrow(matrices, "k1 long, k2 long, c long, m binary"), "matrices")]
    shape = lambda raw: np.frombuffer(raw, np.int64).reshape(L, L)

    def product(key, group):
        rows = group.sort_values("c").m
        total = shape(rows.iloc[0])
        for r in rows.iloc[1:]:
            total = combine(total, shape(r))
        return group.iloc[:1][["k1", "k2"]].assign(c=key[2], m=[total.tobytes()])

    while (levels[-1].agg(F.max("c")).first()[0] or 0) >= BLOCK:
        up = levels[-1].withColumn("b", F.expr(f"c div {BLOCK}")).groupBy("k1", "k2", "b").applyInPandas(product, "k1 long, k2 long, c long, m binary")
        levels.append(stored(up, "matrices"))

    origin = np.full(L, NONE, np.int64)
    origin[L - 1] = 0

    def prefixes(key, group):
        rows = group.sort_values("c")
        v = np.frombuffer(rows.v.iloc[0], np.int64) if "v" in rows and rows.v.iloc[0] is not None else origin
        made = []
        for r in rows.m:
            made.append(v.tobytes())
            v = advance(v, shape(r))
        return rows[["k1", "k2", "c"]].assign(v=made)

    vectors = None
    for level in reversed(levels):
        grouped = level.withColumn("b", F.expr(f"c div {BLOCK}"))
        if vectors is not None:
            grouped = grouped.join(vectors.withColumnRenamed("c", "b"), ["k1", "k2", "b"])
        vectors = grouped.groupBy("k1", "k2", "b").applyInPandas(prefixes, "k1 long, k2 long, c long, v binary")
    ready = stored(chunks.join(vectors, ["k1", "k2", "c"]), "entries")

    def maps(batches):
        for batch in batches:
            m, made = sent.model(), []
            for s, at, v in each(batch, "s", "at", "v"):
                part, entry = Chunk(m, s, at), np.frombuffer(v, np.int64).tolist()
                # Every node from the first of the entry window on can be reached.
                first = max(0, at - L + 1)
                made.append([part.back(entry, j, ids=False)[1] if part.end - L + 1 + j >= first else -1 for j in range(L)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k1", "k2", "c")), pa.array(made, pa.list_(pa.int32()))], names=["k1", "k2", "c", "f"])

    # Exit positions: the maps composed from the end, by the same blocks as the matrices.
    downs = [stored(ready.select("k1", "k2", "c", "at", "s", "v").mapInArrow(maps, "k1 long, k2 long, c long, f array<int>"), "maps")]

    def composed(key, group):
        rows = group.sort_values("c", ascending=False).f
        f = list(range(L))
        for g in rows:
            f = [g[x] if x >= 0 else -1 for x in f]
        return group.iloc[:1][["k1", "k2"]].assign(c=key[2], f=[f])

    for _ in levels[1:]:
        up = downs[-1].withColumn("b", F.expr(f"c div {BLOCK}")).groupBy("k1", "k2", "b").applyInPandas(composed, "k1 long, k2 long, c long, f array<int>")
        downs.append(stored(up, "maps"))

    def exits(key, group):
        rows = group.sort_values("c", ascending=False)
        x, made = (int(rows.x.iloc[0]) if "x" in rows else L - 1), []
        for g in rows.f:
            made.append(x)
            x = int(g[x])
        return rows[["k1", "k2", "c"]].assign(x=made)

    leaving = None
    for level in reversed(downs):
        grouped = level.withColumn("b", F.expr(f"c div {BLOCK}"))
        if leaving is not None:
            grouped = grouped.join(leaving.withColumnRenamed("c", "b"), ["k1", "k2", "b"])
        leaving = grouped.groupBy("k1", "k2", "b").applyInPandas(exits, "k1 long, k2 long, c long, x int")

    def trace(batches):
        for batch in batches:
            m = sent.model()
            got = [Chunk(m, s, at).back(np.frombuffer(v, np.int64).tolist(), x)[0] for s, at, v, x in each(batch, "s", "at", "v", "x")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k1", "k2", "c")), id_lists(got)], names=["k1", "k2", "c", "ids"])

    traced = ready.join(leaving, ["k1", "k2", "c"]).select("k1", "k2", "c", "at", "s", "v", "x").mapInArrow(trace, "k1 long, k2 long, c long, ids array<int>")
    # The parts of one text meet in the row that has to hold them.
    return traced.groupBy("k1", "k2").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("c", "ids"))), lambda x: x["ids"])).alias("ids"))


def decode(df: DataFrame, pieces: list[tuple[str, int]], ids: str = "ids", out: str = "decoded", sent: Sent | None = None) -> DataFrame:
    """``df`` with the text of its ids (null stays null). U+2581 in a text comes back as a blank, all else as it was."""
    sent = sent or Sent(df.sparkSession, pieces)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                lists, m = part.column(ids), sent.get(Decoder)
                made = [m.decode(x.values.to_numpy().tolist()) if x.is_valid else None for x in lists]
                yield appended(part, **{out: pa.array(made, pa.string())})

    return df.mapInArrow(run, plus(df.schema, (out, T.StringType())))


@query("op3_sentencepiece")
def op3_sentencepiece(spark, sf_dir, folder: str = TOKENIZERS):
    """Piece ids of every document, their number, and whether decoding gives the text back."""
    pieces = model_pieces(f"{folder}/piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, pieces, back="decoded").select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), F.expr(f"decoded <=> replace(text, '{BLANK}', ' ')").alias("round_trip"))
