"""Repeated byte strings by prefix doubling (operator 7).

A rank names the string of some length that starts at a position; equal ranks mean equal strings. Doubling: the rank of
2m bytes at p is the name of the pair (rank of m bytes at p, rank of m bytes at p + m). Ranks here are hashes of the pair
instead of places in a global sort, so they are the same in every task and no round has to sort all positions.

1. Ranks of 1, 2, 4 .. 64 bytes at every position, inside the task that reads the text.
2. Positions are grouped into zones: consecutive positions p whose ``length``-byte string has its least 64-byte rank at the
   same place, the anchor. Equal strings have equal anchors, so a repeated string always lies in zones of equal anchor rank.
   Spark counts anchor ranks; a zone whose rank is unique is settled: nothing in it repeats.
3. Zones that are left get the 128-bit rank of all bytes they cover. Equal zones repeat as a whole and are settled.
4. Where one anchor rank has different zones, one zone of each kind is cut into steps of STEP positions counted from the
   anchor. All strings of a step share a core of length - STEP + 1 bytes; a step with a unique core rank is settled, and so are
   equal steps (128-bit rank of all their bytes).
5. Where one core rank has different steps, one of each kind is reranked position by position at the full length (128 bits);
   strings that occur twice are repeats.

Every round works on what the one before could not settle. 64-bit ranks only select candidates; what is removed was equal
in 128-bit ranks of its bytes.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bits import Bits
from .common import discard, plus, raw_texts, slices, stored, table, text_key
from .registry import query

LENGTH = 200
#: Bytes of an anchor's rank, a power of two.
GRAM = 64
#: Positions of a step.
STEP = 16
#: Bytes ranked together (bounds a task's arrays); longer texts go piece by piece.
PIECE = 1 << 18
_ONE = np.array([xxhash.xxh64_intdigest(bytes([i]), 11) for i in range(256)], np.uint64)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def ranks(raw: np.ndarray, length: int) -> np.ndarray:
    """64-bit ranks of ``length`` (a power of two) bytes at every position, by doubling."""
    h, m = _ONE[raw], 1
    with np.errstate(over="ignore"):
        while m < length:
            if len(h) <= m:
                return np.zeros(0, np.uint64)
            h = h[:-m] * _A + (h[m:] ^ (h[m:] >> np.uint64(31))) * _B
            h ^= h >> np.uint64(29)
            m *= 2
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    m = 1
    while 2 * m <= width:
        x = np.minimum(x[:-m], x[m:])
        m *= 2
    return np.minimum(x[: len(x) - (width - m)], x[width - m :]) if width > m else x


def zones(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """Zones of the positions [starts, ends) (starts of whole strings): first position, number of positions, way to the anchor, its rank."""
    empty = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(raw) < length:
        return empty
    low = np.uint64((1 << 20) - 1)
    h = ranks(raw, gram)
    order = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    anchor = (sliding_min(order, length - gram + 1) & low).astype(np.int64)
    mark = np.zeros(len(raw) + 1, np.int8)
    np.add.at(mark, starts, 1)
    np.add.at(mark, ends, -1)
    valid = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
    if not len(valid):
        return empty
    a = anchor[valid]
    new = np.concatenate([[True], (np.diff(a) != 0) | (np.diff(valid) != 1)])
    first = np.flatnonzero(new)
    return valid[first], np.diff(np.append(first, len(valid))), a[first] - valid[first], h[a[first]]


def pieces(batch: pa.RecordBatch, length: int):
    """(rows, offsets of their bytes in the row, bytes, starts, ends): texts together up to PIECE, long ones in overlapping parts."""
    for part in slices(batch, "text", PIECE):
        texts = [x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()]
        keys = list(zip(part.column("k1").to_pylist(), part.column("k2").to_pylist(), strict=True))
        if len(texts) > 1 or len(texts[0]) <= 2 * PIECE:
            at = np.cumsum([0, *map(len, texts)])
            starts = at[:-1]
            yield keys, at[:-1], b"".join(texts), starts, np.maximum(at[1:] - length + 1, starts)
        else:
            for a in range(0, len(texts[0]) - length + 1, PIECE):
                raw = texts[0][a : a + PIECE + length - 1]
                yield keys, np.array([-a]), raw, np.array([0]), np.array([len(raw) - length + 1])


def longs(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    x = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return pa.array(np.ascontiguousarray(x[:, 0])), pa.array(np.ascontiguousarray(x[:, 1]))


def with_texts(places: DataFrame, columns: tuple[str, ...], texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(k1, k2, todo, text): the places of each distinct text (rows with k1, k2) beside its bytes; other texts do not travel.

    Second: the written table behind it, to discard when the first has been read.
    """
    todo = stored(places.groupBy("k1", "k2").agg(F.collect_list(F.struct(*columns)).alias("todo")), "todo")
    wanted = Bits(todo, "k1")

    def needed(batches):
        for b in batches:
            yield b.filter(pa.array(wanted.has(b.column("k1").to_numpy().view(np.uint64))))

    # Copies of a text collapse in the tasks that read them.
    return todo.join(texts.mapInArrow(needed, texts.schema).groupBy("k1", "k2").agg(F.first("text").alias("text")), ["k1", "k2"]), todo


def rows_of(batches):
    for batch in batches:
        for r in range(batch.num_rows):
            row = batch.slice(r, 1)
            yield row.column("text").cast(pa.binary())[0].as_py() or b"", row.column("k1")[0].as_py(), row.column("k2")[0].as_py(), row.column("todo").to_pylist()[0]


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(k1, k2, spans) of the distinct texts with repeats: byte ranges [start, end) covered by repeated strings, merged.

    ``texts`` has k1, k2 (the text's key) and text, one row for every document; copies count as occurrences.
    """
    if gram & (gram - 1) or gram > length:
        raise ValueError("gram must be a power of two and at most the length")

    def anchors(batches):
        for b in batches:
            for _, _, raw, starts, ends in pieces(b, length):
                x = zones(np.frombuffer(raw, np.uint8), starts, ends, length, gram)[3]
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64))], names=["a"])

    counted = texts.mapInArrow(anchors, "a long").groupBy("a").count().where("count > 1").select("a")
    again = stored(counted, "anchors")
    bits = Bits(again, "a")
    discard(again)

    def candidates(batches):
        for b in batches:
            for keys, at, raw, starts, ends in pieces(b, length):
                p, n, d, a = zones(np.frombuffer(raw, np.uint8), starts, ends, length, gram)
                on = bits.has(a)
                p, n, d, a = p[on], n[on], d[on], a[on]
                if not len(p):
                    continue
                row = np.searchsorted(at, p, "right") - 1 if len(at) > 1 else np.zeros(len(p), int)
                c1, c2 = longs([xxhash.xxh3_128_digest(raw[x : x + m + length - 1]) for x, m in zip(p.tolist(), n.tolist(), strict=True)])
                k = np.array(keys, np.int64)[row]
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), c1, c2, pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(p - at[row]), pa.array(n.astype(np.int32)), pa.array(d.astype(np.int32))], names=["a", "c1", "c2", "k1", "k2", "p", "n", "d"])

    found = texts.mapInArrow(candidates, "a long, c1 long, c2 long, k1 long, k2 long, p long, n int, d int")
    # Copies of a text collapse before anything is joined.
    zone = stored(found.groupBy("a", "c1", "c2", "k1", "k2", "p", "n", "d").agg(F.count("*").alias("w")), "zones")
    kinds = stored(zone.groupBy("a", "c1", "c2").agg(F.sum("w").alias("w"), F.min(F.struct("k1", "k2", "p", "n", "d")).alias("z")), "kinds")
    whole = zone.join(kinds.where("w > 1").select("a", "c1", "c2"), ["a", "c1", "c2"]).select("k1", "k2", F.col("p").alias("s"), (F.col("p") + F.col("n") + length - 1).alias("e"))

    mixed = kinds.groupBy("a").agg(F.count("*").alias("kinds")).where("kinds > 1").select("a")
    open_, behind = with_texts(kinds.join(mixed, "a").select("z.*", "w"), ("p", "n", "d", "w"), texts)

    def cores(batches):
        for raw, k1, k2, todo in rows_of(batches):
            made, whole_ranks = [], []
            for z in todo:
                anchor = z["p"] + z["d"]
                for j in range((z["d"] - z["n"] + 1) // STEP, z["d"] // STEP + 1):
                    end = anchor - j * STEP
                    low, high = max(z["p"], end - STEP + 1), min(z["p"] + z["n"] - 1, end)
                    made.append((xxhash.xxh3_64_intdigest(raw[end : end + length - STEP + 1], j), low, high - low + 1, min(z["w"], 2)))
                    whole_ranks.append(xxhash.xxh3_128_digest(raw[low : high + length], end - low))
            r, p, n, w = (np.array(x, t) for x, t in zip(zip(*made, strict=True), (np.uint64, np.int64, np.int32, np.int32), strict=True))
            k = (pa.array(np.full(len(p), x, np.int64)) for x in (k1, k2))
            yield pa.RecordBatch.from_arrays([pa.array(r.view(np.int64)), *longs(whole_ranks), *k, pa.array(p), pa.array(n), pa.array(w)], names=["r", "c1", "c2", "k1", "k2", "p", "n", "w"])

    if length > STEP:
        steps = stored(open_.mapInArrow(cores, "r long, c1 long, c2 long, k1 long, k2 long, p long, n int, w int"), "steps")
        discard(behind)
        kinds = stored(steps.groupBy("r", "c1", "c2").agg(F.sum("w").alias("w"), F.min(F.struct("k1", "k2", "p", "n")).alias("z")), "kinds")
        # Zones with w > 1 are settled; they are here to be met by others.
        again = steps.where("w = 1").join(kinds.where("w > 1").select("r", "c1", "c2"), ["r", "c1", "c2"])
        whole = whole.unionByName(again.select("k1", "k2", F.col("p").alias("s"), (F.col("p") + F.col("n") + length - 1).alias("e")))
        mixed = kinds.groupBy("r").agg(F.count("*").alias("kinds")).where("kinds > 1").select("r")
        open_, behind = with_texts(kinds.join(mixed, "r").select("z.*", "w"), ("p", "n", "w"), texts)

    def positions(batches):
        for raw, k1, k2, todo in rows_of(batches):
            for i in range(0, len(todo), 4096):
                z = todo[i : i + 4096]
                at = np.concatenate([np.arange(x["p"], x["p"] + x["n"]) for x in z])
                w = np.repeat([min(x["w"], 2) for x in z], [x["n"] for x in z])
                s1, s2 = longs([xxhash.xxh3_128_digest(raw[p : p + length]) for p in at.tolist()])
                k = (pa.array(np.full(len(at), x, np.int64)) for x in (k1, k2))
                yield pa.RecordBatch.from_arrays([s1, s2, *k, pa.array(at), pa.array(w.astype(np.int32))], names=["s1", "s2", "k1", "k2", "p", "w"])

    single = stored(open_.mapInArrow(positions, "s1 long, s2 long, k1 long, k2 long, p long, w int"), "positions")
    discard(behind)
    twice = single.groupBy("s1", "s2").agg(F.sum("w").alias("n")).where("n > 1").select("s1", "s2")
    # What occurs as a whole more than once (w > 1) is settled above; it was here to be met by others.
    parts = single.where("w = 1").join(twice, ["s1", "s2"]).select("k1", "k2", F.col("p").alias("s"), (F.col("p") + length).alias("e"))
    return whole.unionByName(parts).groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def remove_repeats(df: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``df`` with n_bytes, spans (removed byte ranges, merged, as arrays of start and end), kept (remaining bytes).

    A byte goes when some ``length``-byte string over it also starts anywhere else, in the same or another row. Null text
    counts as empty; texts shorter than ``length`` keep all. Equal texts of at least ``length`` bytes lose everything. Repeated
    rows stay rows. An empty input gives an empty result. Columns with the names of outputs are replaced.
    """
    k1, k2 = (f"_{uuid.uuid4().hex[:8]}" for _ in range(2))
    keys = dict(zip((k1, k2), text_key(text), strict=True))
    found = stored(repeated_spans(df.select(keys[k1], keys[k2], F.col(text).alias("text")), length, gram), "spans")
    bits = Bits(found, "k1")
    keyed = df.withColumns(keys)
    spans_name = f"{k1}_spans"
    fields = (("n_bytes", T.LongType()), ("spans", T.ArrayType(T.ArrayType(T.LongType()))), ("kept", T.BinaryType()))

    def cut(batches):
        for batch in batches:
            joined = spans_name in batch.schema.names
            for b in slices(batch if joined else sided(batch, False), text):
                raws = raw_texts(b, text)
                lists = b.column(spans_name) if joined else None
                runs = [merged([(x["s"], x["e"]) for x in lists[i].as_py() or ()]) if joined else [] for i in range(len(raws))]
                kept = [b"".join([raw[a:z] for a, z in zip([0, *(e for _, e in r)], [*(s for s, _ in r), len(raw)], strict=True)]) for raw, r in zip(raws, runs, strict=True)]
                made = {"n_bytes": pa.array([len(r) for r in raws], pa.int64()), "spans": pa.array([[list(x) for x in r] for r in runs], pa.list_(pa.list_(pa.int64()))), "kept": pa.array(kept, pa.binary())}
                own = [n for n in b.schema.names if n not in made and n not in (k1, k2, spans_name)]
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in own), *made.values()], names=[*own, *made])

    def sided(b: pa.RecordBatch, touched: bool) -> pa.RecordBatch:
        return b.filter(pa.array(bits.has(b.column(k1).to_numpy().view(np.uint64)) == touched))

    def pick(batches):
        for b in batches:
            yield sided(b, True)

    out = plus(df.schema, *fields)
    clean = keyed.mapInArrow(cut, out)
    named = found.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("spans").alias(spans_name))
    touched = keyed.mapInArrow(pick, keyed.schema).join(named, [k1, k2], "left").mapInArrow(cut, out)
    return clean.unionByName(touched)


def sha256(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


OP7_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents),
p AS (SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS g FROM (SELECT r, h, unnest(range(n - 199)) AS i FROM d WHERE n >= 200)),
f AS (SELECT r, i FROM p SEMI JOIN (SELECT g FROM p GROUP BY g HAVING count(*) > 1) USING (g)),
m AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM f)),
s AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM m GROUP BY r, run),
k AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS c FROM s),
x AS (SELECT d.r, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM k JOIN d USING (r) GROUP BY d.r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN x USING (r)
"""


@query("op7_prefix_doubling", OP7_SQL)
def op7_prefix_doubling(spark, sf_dir):
    """Removed bytes and the hash of what stays, of every document."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.expr("aggregate(spans, 0L, (n, x) -> n + x[1] - x[0])")
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
