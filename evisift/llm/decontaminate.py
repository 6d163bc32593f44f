"""Benchmark decontamination by winnowing (operator 9), after Schleimer, Wilkerson and Aiken (2003).

A shared span of ``window`` words holds window - k + 1 k-grams. Keeping the least k-gram hash of every run of that many
k-grams picks the same k-gram on both sides, so test fingerprints joined with training fingerprints find every such span; a
hit is extended word by word to the exact windows around it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, raw_texts, stored, table
from .registry import query

WINDOW, GRAM = 10, 5
#: Words of benchmark items that are indexed and broadcast together; a larger benchmark is worked off in such blocks.
BLOCK_WORDS = 1_000_000
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
NEVER = np.uint64(2**64 - 1)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, letters a-z and bytes beyond ASCII."""
    return text.translate(_TABLE).split()


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k-gram of word numbers; grams with an unknown word (-1) get the largest value."""
    if len(ids) < k:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(ids) - k + 1, np.uint64)
    known = np.ones(len(h), bool)
    with np.errstate(over="ignore"):
        for i in range(k):
            part = ids[i : i + len(h)]
            known &= part >= 0
            h = (h ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    h[~known] = NEVER
    return h


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions of the leftmost least hash of every run of ``w`` hashes."""
    if len(hashes) < w:
        return np.zeros(0, np.int64)
    return np.unique(np.arange(len(hashes) - w + 1) + sliding_window_view(hashes, w).argmin(1))


class Index:
    """Fingerprints of a block of items, by window length: ``window``, or fewer words for shorter items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int, k: int):
        self.window = window
        self.numbers: dict[bytes, int] = {}
        self.items = [n for n, w in items if w]
        self.words = [np.array([self.numbers.setdefault(x, len(self.numbers)) for x in w], np.int64) for _, w in items if w]
        #: By window length: gram length, window of grams, and the (item, word) places by gram hash.
        self.lengths: dict[int, tuple[int, int, dict[int, list[tuple[int, int]]]]] = {}
        for i, ids in enumerate(self.words):
            n = min(window, len(ids))
            gram = min(k, n)
            _, run, places = self.lengths.setdefault(n, (gram, n - gram + 1, {}))
            h = gram_hashes(ids, gram)
            for p in winnow(h, run).tolist():
                places.setdefault(int(h[p]), []).append((i, p))

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words of a text lie in an occurrence of a window, and the items that have one."""
        get = self.numbers.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        hit, found = np.zeros(len(ids) + 1, np.int64), set()
        if len(ids) and ids.max() >= 0:
            for n, (gram, run, places) in self.lengths.items():
                if len(ids) >= n:
                    h = gram_hashes(ids, gram)
                    if len(h) >= run and h.min() != NEVER:
                        at = winnow(h, run)
                        for p in at[h[at] != NEVER].tolist():
                            for item, q in places.get(int(h[p]), ()):
                                self._extend(ids, p, item, q, n, hit, found)
        return np.cumsum(hit[:-1]) > 0, found

    def _extend(self, ids, p, item, q, n, hit, found) -> None:
        """Grow the hit at ids[p], item word q to both sides, and mark it if it holds a window of n words."""
        other = self.words[item]
        back, fore = min(p, q, n - 1), min(len(ids) - p, len(other) - q, n)
        left = ids[p - back : p][::-1] == other[q - back : q][::-1]
        right = ids[p : p + fore] == other[q : q + fore]
        l_ = back if left.all() else int(left.argmin())
        r = fore if right.all() else int(right.argmin())
        if l_ + r >= n:
            hit[p - l_] += 1
            hit[p + r] -= 1
            found.add(item)


def blocks(items: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items of at most ``limit`` words together (one item at least), in id order, a block at a time on the driver."""
    block, held = [], 0
    for row in items.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("binary").alias("t")).where("i is not null").orderBy("i", "t").toLocalIterator():
        words = words_of(bytes(row["t"] or b""))
        if block and held + len(words) > limit:
            yield block
            block, held = [], 0
        block.append((row["i"], words))
        held += len(words)
    if block:
        yield block


_READY: dict[str, Index] = {}


def decontaminate(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = GRAM, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """``docs`` with n_words, hits (word ranges [start, end) covered by item windows, merged) and items (ids, sorted).

    Null and empty texts have no words. Items without words match nothing, items without an id are left out, repeated items
    count by id. Documents are scanned in place, no shuffle: one pass for each block of ``block_words`` item words, each
    adding to the columns; the table between two blocks is written. A word of any frequency and a passage in any
    number of documents cost each document its own length only.
    """
    if not 1 <= k <= window:
        raise ValueError("grams must not be longer than windows")
    spark = docs.sparkSession
    ranges = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    fields = [("n_words", T.LongType()), ("hits", ranges), ("items", T.ArrayType(T.StringType()))]
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    out = None
    for block in blocks(items, item_id, item_text, block_words):
        key, sent = uuid.uuid4().hex, spark.sparkContext.broadcast(block)

        def make(batch: pa.RecordBatch, key=key, sent=sent, more=out is not None) -> dict:
            if key not in _READY:
                _READY.clear()
                _READY[key] = Index(sent.value, window, k)
            index, counts, hits, found = _READY[key], [], [], []
            before = zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True) if more else None
            for t in raw_texts(batch, text):
                words = words_of(t)
                hit, items_ = index.hits(words)
                names = {index.items[i] for i in items_}
                if before is not None:
                    spans, had = next(before)
                    names |= set(had)
                    for s in spans:
                        hit[s["start"] : s["end"]] = True
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                counts.append(len(words))
                hits.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
                found.append(sorted(names))
            return {"n_words": pa.array(counts, pa.int64()), "hits": pa.array(hits, arrow), "items": pa.array(found, pa.list_(pa.string()))}

        out = map_rows(docs if out is None else stored(out, "hits"), text, fields, make)
    if out is None:

        def none(batch: pa.RecordBatch) -> dict:
            n = [len(words_of(t)) for t in raw_texts(batch, text)]
            return {"n_words": pa.array(n, pa.int64()), "hits": pa.array([[] for _ in n], arrow), "items": pa.array([[] for _ in n], pa.list_(pa.string()))}

        out = map_rows(docs, text, fields, none)
    return out


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
h AS (SELECT r, i, n, item FROM dw JOIN bw USING (n, g)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""


@query("op9_winnowing", OP9_SQL)
def op9_winnowing(spark, sf_dir):
    """Hit words and benchmark items of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.expr("aggregate(hits, 0L, (n, x) -> n + x.end - x.start)")
    return got.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )
