"""SimHash near-duplicates by pivot distance tables (operator 10).

Fingerprints are points of Hamming space. Distances to fixed pivots bound the distance of two fingerprints from below
(triangle inequality), so a pair whose tables differ by more than the radius anywhere cannot be linked.

Candidates come from the table as well. A fingerprint x lives in the cell of its nearest pivot, at distance d(x). Let
x, y be linked and d(y) <= d(x): y's pivot q is at most d(y) + r <= d(x) + r away from x. So x probes the cells of all
pivots within d(x) + r, and every link is met at least once. The number of pivots follows the square root of the number
of fingerprints, so cells stay small; crowded cells are split into tiles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, discard, map_rows, raw_texts, stored, table, text_key
from .forest import Forest
from .registry import query

WIDTH, RADIUS, SEED = 3, 3, 42
#: Radius of the word fingerprints that propose near-duplicates by shingles.
VIEW_RADIUS = 5
#: Pivots of the table that pairs are held against, besides the cell's own.
TABLE = 12
#: Fingerprints of a tile of a cell, home and probing.
HOME, PROBE = 4096, 32_768
MOST_PIVOTS = 1 << 16
#: Counters of the sketch that puts common shingles last, and the members of a bucket, all of different roots, that may meet each other at once.
COUNTERS, BLOCK = 1 << 18, 256
#: Pairs that are verified together.
PAIRS = 20_000
#: Shingles of a block of texts, and of a part of the hash space, that are counted together; the nodes a block may span.
TOGETHER, PART, SPAN = 1 << 21, 1 << 20, 1 << 16
#: Rounds in which larger buckets offer their members to a head before all are offered to each other.
STARS = 3


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """64-bit SimHash of UTF-8 text: a bit is set if it is in over half the shingle hashes; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return digest(b" ".join(words), SEED)
    n, ones = len(words) - width + 1, np.zeros(64, np.int64)
    for a in range(0, n, 1 << 16):
        b = min(n, a + (1 << 16))
        h = np.array([digest(b" ".join(t), SEED) for t in zip(*(words[a + i : b + i] for i in range(width)), strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """``df`` with the fingerprint of the whole text as a (signed) long; null and empty texts have 0."""

    def make(batch: pa.RecordBatch) -> dict:
        return {out: pa.array(np.array([fingerprint(t) for t in raw_texts(batch, text)], np.uint64).view(np.int64))}

    return map_rows(df, text, [(out, T.LongType())], make)


def pivots(n: int) -> np.ndarray:
    """Fixed reference fingerprints: hashes of 0 .. n-1."""
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "little"), 7) for i in range(n)], np.uint64)


def _cells(fps: np.ndarray, refs: np.ndarray, radius: int):
    """(row, cell, is home) of all cells a fingerprint lives in or probes."""
    rows, cells, home = [], [], []
    step = max(1, (1 << 22) // len(refs))
    for a in range(0, len(fps), step):
        d = np.bitwise_count(fps[a : a + step, None] ^ refs[None, :])
        near = d.argmin(1)
        least = d[np.arange(len(d)), near]
        i, q = np.nonzero(d <= least[:, None].astype(np.int16) + radius)
        rows += [a + np.arange(len(d)), a + i]
        cells += [near, q]
        home += [np.ones(len(d), bool), np.zeros(len(i), bool)]
    return (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((rows, int), (cells, int), (home, bool)))


def _links(home: np.ndarray, probe: np.ndarray, th: np.ndarray, tp: np.ndarray, radius: int):
    """(home i, probes linked to it): pairs are discarded by one coordinate after another, survivors are verified."""
    order = np.argsort(tp[:, 0], kind="stable")
    first = tp[order, 0].astype(np.int16)
    low, high = np.searchsorted(first, th[:, 0].astype(np.int16) - radius), np.searchsorted(first, th[:, 0].astype(np.int16) + radius, "right")
    th, tp = th.astype(np.int16), tp.astype(np.int16)
    for i in range(len(home)):
        left = order[low[i] : high[i]]
        for k in range(1, th.shape[1]):
            if len(left) < 64:
                break
            left = left[np.abs(tp[left, k] - th[i, k]) <= radius]
        left = left[np.bitwise_count(probe[left] ^ home[i]) <= radius]
        if len(left):
            yield i, left


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) of distinct fingerprints ``fp`` at ``radius`` or fewer differing bits.

    The edges of one tile are a spanning forest of the links in it: no link is lost for connectivity, and a dense group
    does not become all its pairs.
    """
    spark = fps.sparkSession
    n = fps.count()
    count = min(MOST_PIVOTS, 1 << max(6, int(max(n, 1) ** 0.5).bit_length()))
    refs = pivots(count)
    sent = spark.sparkContext.broadcast(refs)  # MOST_PIVOTS x 8 bytes at most

    def assign(batches):
        for b in batches:
            x = b.column("fp").to_numpy().view(np.uint64)
            refs = sent.value
            rows, cells, home = _cells(x, refs, radius)
            coords = np.bitwise_count(x[:, None] ^ refs[None, :TABLE])
            tables = pa.array([r.tobytes() for r in coords], pa.binary(TABLE)).cast(pa.binary())
            for a in range(0, len(rows), 50_000):
                part = slice(a, a + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells[part].astype(np.int32)), pa.array(home[part]), pa.array(x[rows[part]].view(np.int64)), tables.take(pa.array(rows[part]))],
                    names=["cell", "home", "fp", "d"],
                )

    placed = stored(fps.select("fp").mapInArrow(assign, "cell int, home boolean, fp long, d binary"), "cells")
    sizes = placed.groupBy("cell").agg(F.ceil(F.sum(F.col("home").cast("int")) / HOME).alias("nh"), F.ceil(F.sum((~F.col("home")).cast("int")) / PROBE).alias("np")).where("nh > 0")
    # One row for each pivot: bounded by MOST_PIVOTS.
    tiled = placed.join(F.broadcast(sizes), "cell")
    mix = F.xxhash64("fp")
    home = tiled.where("home").withColumn("t", F.pmod(mix, "nh")).withColumn("p", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("np") - 1)))
    probe = tiled.where("not home").withColumn("p", F.pmod(mix, "np")).withColumn("t", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nh") - 1)))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        is_home = group.home.to_numpy()
        x = group.fp.to_numpy().astype(np.int64).view(np.uint64)
        d = np.frombuffer(b"".join(group.d), np.uint8).reshape(-1, TABLE)
        h, p = x[is_home], x[~is_home]
        nodes, of = np.unique(np.concatenate([h, p]), return_inverse=True)
        forest = Forest(len(nodes))
        for i, found in _links(h, p, d[is_home], d[~is_home], radius):
            if len(found) > 1 or p[found[0]] != h[i]:
                forest.link(of[i], of[len(h) + found])
        e = nodes[np.array(forest.edges, np.int64).reshape(-1, 2)].view(np.int64)
        return pd.DataFrame({"a": e[:, 0], "b": e[:, 1]})

    return home.unionByName(probe).select("cell", "t", "p", "home", "fp", "d").groupBy("cell", "t", "p").applyInPandas(compare, "a long, b long")


def simhash_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, root, component_id) and the ``carry`` columns for every row: linked over any chain of fingerprints at
    ``radius`` or fewer bits.

    component_id is the smallest doc_id of the component (null only if all its ids are null), root its least fingerprint.
    Null, empty and blank texts have fingerprint 0 and are linked like any other; equal texts meet as one fingerprint, so a
    group of copies of any size is one node. Repeated rows stay. An empty input gives an empty result.
    """
    narrow = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), *carry)
    docs = stored(fingerprints(narrow, "_text").drop("_text"), "fingerprints")
    distinct = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct, radius))
    placed = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "root").select("fp", "root", "component_id")
    return docs.join(named, "fp").select("doc_id", *carry, "fp", "root", "component_id")


def word_fingerprint(text: bytes) -> int:
    """SimHash of the set of words; 0 without words."""
    words = list(set(text.lower().split()))
    return majority(np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], np.uint64)) if words else 0


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 32-bit hashes of ``width``-word shingles (fewer words: all of them as one; none: empty)."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint32)
    digest = xxhash.xxh32_intdigest
    if len(words) < width:
        return np.array([digest(b" ".join(words))], np.uint32)
    return np.unique(np.array([digest(b" ".join(t)) for t in zip(*(words[i:] for i in range(width)), strict=False)], np.uint32))


def lone(sets: DataFrame) -> DataFrame:
    """(node, lone): how many shingles of half of the hash space (the even ones) a set of ``sets(node, s)`` has that no other set has; sets with none are left out.

    Blocks of texts send their shingles, sorted and packed, to the parts of the hash space, and get back the places of the lone
    ones: about six bytes for each, and a shingle of many texts of a block is sent twice at most.
    """
    even = sets.agg(F.sum(F.octet_length("s")) / 8).first()[0] or 0
    parts = max(1, -(-int(even) // PART))

    def packed(nodes: list[int], held: list[np.ndarray]) -> pa.RecordBatch:
        at = np.repeat(np.array(nodes) - nodes[0], [len(x) for x in held]).astype(np.uint16)
        sh = np.concatenate(held)
        order = np.argsort(sh, kind="stable")
        sh, at = sh[order], at[order]
        keep = np.ones(len(sh), bool)
        keep[2:] = sh[2:] != sh[:-2]
        sh, at = sh[keep], at[keep]
        of = (sh.astype(np.uint64) * np.uint64(parts)) >> np.uint64(32)  # rises with the shingle
        used, cuts = np.unique(of, return_index=True)
        cuts = [*cuts.tolist(), len(sh)]
        pieces = list(zip(cuts[:-1], cuts[1:], strict=True))
        columns = [used.astype(np.int32), np.full(len(used), nodes[0]), [sh[a:b].tobytes() for a, b in pieces], [at[a:b].tobytes() for a, b in pieces]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["part", "first", "sh", "at"])

    def send(batches):
        nodes, held, n = [], [], 0
        for b in batches:
            for node, s in zip(b.column("node").to_pylist(), b.column("s"), strict=True):
                x = np.frombuffer(s.as_py(), np.uint32)
                x = x[x % 2 == 0]
                if nodes and (n + len(x) > TOGETHER or not 0 <= node - nodes[0] < SPAN):
                    yield packed(nodes, held)
                    nodes, held, n = [], [], 0
                nodes.append(node)
                held.append(x)
                n += len(x)
        if nodes:
            yield packed(nodes, held)

    def tell(part: pd.DataFrame) -> pd.DataFrame:
        sh = np.concatenate([np.frombuffer(x, np.uint32) for x in part.sh])
        order = np.argsort(sh, kind="stable")
        same = sh[order][1:] == sh[order][:-1]
        only = np.empty(len(sh), bool)
        only[order] = ~(np.append(same, False) | np.insert(same, 0, False))
        cuts = np.cumsum([len(x) // 4 for x in part.sh])[:-1]
        places = [np.frombuffer(x, np.uint16)[o].tobytes() for x, o in zip(part["at"], np.split(only, cuts), strict=True)]
        return pd.DataFrame({"first": part["first"], "at": places})

    def count(block: pd.DataFrame) -> pd.DataFrame:
        n = np.bincount(np.frombuffer(b"".join(block["at"]), np.uint16))
        at = np.flatnonzero(n)
        return pd.DataFrame({"node": block["first"].iloc[0] + at, "lone": n[at]})

    told = sets.select("node", "s").mapInArrow(send, "part int, first long, sh binary, at binary").groupBy("part").applyInPandas(tell, "first long, at binary")
    return told.groupBy("first").applyInPandas(count, "node long, lone long")


def partnered(sets: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``sets(node, s, ...)`` that another set may reach at ``similarity``, stored.

    Such a set shares that part of its shingles with its partner, so one with more lone shingles than the rest has no partner. Half of
    the hash space tells it for most texts, which have a few shingles in common with others and no partner.
    """
    sizes = sets.select("node", (F.octet_length("s") / 4).alias("n"))
    rest = F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - F.lit(1e-9))
    some = stored(sizes.join(lone(sets), "node", "left").where(F.coalesce("lone", F.lit(0)) <= rest).select("node"), "some")
    out = stored(sets.join(some, "node").select(*sets.columns), "partnered")
    discard(some)
    return out


def heat(sets: DataFrame) -> np.ndarray:
    """How often shingles of the sets ``s`` fall on each of COUNTERS counters; 0 where no task found a counter far above its others.

    It only orders shingles, so that common passages come last; any order gives the same result.
    """

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.bincount(np.frombuffer(x.as_py(), np.uint32) % COUNTERS, minlength=COUNTERS)
        at = np.flatnonzero(total > 8 + 4 * total.mean())
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "n"])

    found = sets.select("s").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # COUNTERS rows at most
    out = np.zeros(COUNTERS, np.int64)
    out[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return out


def prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """(sh, node, n, at): the prefix of each set, common shingles last, in which two sets at ``similarity`` share one.

    n is the size of the set, at the place of the shingle. An empty set has the single shingle -1.
    """
    sent = sets.sparkSession.sparkContext.broadcast(heat(sets))

    def run(batches):
        for b in batches:
            nodes, columns = b.column("node").to_numpy(), []
            for node, s in zip(nodes.tolist(), b.column("s"), strict=True):
                x = np.frombuffer(s.as_py(), np.uint32)
                keep = len(x) - int(np.ceil(similarity * len(x) - 1e-9)) + 1
                first = x[np.lexsort((x, sent.value[x % COUNTERS]))][:keep].astype(np.int64) if len(x) else np.array([-1])
                k = len(first)
                columns.append((first, np.full(k, node), np.full(k, len(x), np.int32), np.arange(k, dtype=np.int32)))
            if columns:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*columns, strict=True)], names=["sh", "node", "n", "at"])

    return sets.select("node", "s").mapInArrow(run, "sh long, node long, n int, at int")


def shared(members: DataFrame) -> DataFrame:
    """The rows of ``members`` whose shingle another row has too: dealt and sorted by shingle, then told by their neighbours."""

    def run(batches):
        held, met = None, False  # the last row so far, and whether the row before has its shingle
        for b in batches:
            if not b.num_rows:
                continue
            whole = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            sh = whole.column("sh").to_numpy()
            same = sh[1:] == sh[:-1]
            before = np.concatenate([[met], same])
            yield whole.slice(0, len(sh) - 1).filter(pa.array((before[:-1] | same)))
            held, met = whole.slice(len(sh) - 1), bool(before[-1])
        if held is not None and met:
            yield held

    return members.repartition("sh").sortWithinPartitions("sh").mapInArrow(run, members.schema)


def _reach(x: str, y: str, similarity: float):
    """Whether two sets can reach ``similarity`` given their sizes and the places of their first common shingle."""
    most = F.expr(f"1 + least({x}n - 1 - {x}at, {y}n - 1 - {y}at)")
    return (most >= F.lit(similarity / (1 + similarity)) * F.expr(f"{x}n + {y}n") - 1e-9) | F.expr(f"{x}n = 0 and {y}n = 0")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of ``pairs(a, b, by)`` whose shingle sets ``sets(node, s)`` reach ``similarity``, stored.

    Pairs alike in ``by`` meet in one group, and a set travels once to each group that asks for it, not once for each pair. Groups
    hold about PAIRS pairs; a value of ``by`` with more is split.
    """
    groups = max(1, -(-pairs.count() // PAIRS))
    hot = pairs.groupBy("by").agg(F.ceil(F.count("*") / PAIRS).alias("parts")).where("parts > 1")
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("a", "b"), F.coalesce("parts", F.lit(1))))
    dealt = stored(pairs.join(hot, "by", "left").select("a", "b", F.pmod(F.xxhash64("by", part), F.lit(groups)).alias("g")), "pairs")
    # Stored, so that Spark knows its size and leaves the sets in place where it is small.
    asked = stored(dealt.select("g", F.explode(F.array("a", "b")).alias("node")).distinct(), "asked")
    need = asked.join(sets.select("node", "s"), "node").select("g", "node", "s")

    def verify(met: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        of = {n: np.frombuffer(s, np.uint32) for n, s in zip(held.node, held.s, strict=True)}
        keep = []
        for x, y in ((of[a], of[b]) for a, b in zip(met.a, met.b, strict=True)):
            common = len(np.intersect1d(x, y, assume_unique=True)) if len(x) and len(y) else 0
            total = len(x) + len(y) - common
            keep.append(total == 0 or common >= similarity * total)
        return met[["a", "b"]][np.array(keep, bool)]

    out = stored(dealt.groupBy("g").cogroup(need.groupBy("g")).applyInPandas(verify, "a long, b long"), "similar")
    discard(dealt)
    discard(asked)
    return out


def near_duplicate_groups(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, radius: int = VIEW_RADIUS, carry: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, carry, root, component_id) for every row: near-duplicates by Jaccard similarity of ``width``-word shingles.

    Texts with too many shingles of their own for any partner stand alone (see ``partnered``); among the others
    SimHash proposes, shingles decide. Texts whose word fingerprints are at most ``radius`` bits apart (found by the pivot
    tables) are linked when the similarity of their whole shingle sets reaches ``similarity``: most groups become one root.
    Fingerprints of words, not of shingles, because a changed word moves few of them; nine in ten pairs at 0.8 meet this way. The
    others, whatever their fingerprints, meet by a shared shingle of their prefixes (see ``prefixes``): members of a bucket that have
    different roots are compared, so every pair at ``similarity`` is looked at or joined already. In a bucket with many
    such pairs all members first meet its head, which makes one root of a group of near copies in few pairs.

    Equal texts are one node, whatever their number; a dense tile proposes a spanning forest, not all its pairs. Texts without words
    are alike. Null counts as empty; repeated rows stay; an empty input gives an empty result.
    """
    k1, k2 = text_key("_text")
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), *carry).withColumns({"k1": k1, "k2": k2})

    def look(batch: pa.RecordBatch) -> dict:
        texts = raw_texts(batch, "_text")
        fps = np.array([word_fingerprint(t) for t in texts], np.uint64).view(np.int64)
        return {"fp": pa.array(fps), "s": pa.array([shingle_set(t, width).tobytes() for t in texts], pa.binary())}

    # Copies collapse before anything is computed from a text; texts shrink more in a shuffle than the hashes of their shingles.
    texts = rows.groupBy("k1", "k2").agg(F.first("_text").alias("_text"))
    looked = map_rows(texts, "_text", [("fp", T.LongType()), ("s", T.BinaryType())], look).drop("_text")
    nodes = stored(looked.withColumn("node", F.monotonically_increasing_id()), "texts")
    sets = partnered(nodes.select("node", "fp", "s"), similarity)
    keys = stored(nodes.select("k1", "k2", "node"), "keys")
    discard(nodes)
    least = stored(sets.groupBy("fp").agg(F.min("node").alias("rep")), "distinct")
    same = sets.select("node", "fp").join(least, "fp").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    near = links(least, radius).join(least.toDF("a", "ra"), "a").join(least.toDF("b", "rb"), "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
    seen = stored(same.unionByName(near).distinct().withColumn("by", F.col("a")), "candidates")
    sure = similar(seen, sets, similarity)
    members = stored(shared(prefixes(sets, similarity)), "members")
    roots = stored(components(sure), "roots")
    star = True
    for step in range(STARS + 1):
        now = stored(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "now")
        kinds = now.groupBy("sh", "root").agg(F.count("*").alias("c"), F.min(F.struct("node", "n", "at")).alias("h"))
        open_ = kinds.groupBy("sh").agg(((F.pow(F.sum("c"), 2) - F.sum(F.col("c") * F.col("c"))) / 2).alias("cross"), F.min(F.struct("root", "h")).alias("first")).where("cross > 0")
        open_ = stored(open_.select("sh", "cross", "first.root", "first.h"), "open")
        most = open_.agg(F.max("cross")).first()[0]
        if most is None:
            break
        # Roots only merge: a bucket of one root stays one.
        few = stored(now.join(open_.select("sh"), "sh", "left_semi"), "few")
        discard(now)
        members = few.drop("root")
        star = star and step < STARS and most > BLOCK * BLOCK / 2
        if star:
            head = open_.select("sh", F.col("root").alias("head"), "h")
            met = few.join(head, "sh").where("root <> head").where(_reach("", "h.", similarity)).select(F.least("node", "h.node").alias("a"), F.greatest("node", "h.node").alias("b"), F.col("h.node").alias("by"))
        else:
            # Pairs of roots first, so that members of one root do not meet.
            kinds = few.select("sh", "root").distinct()
            two = kinds.toDF("sh", "x").join(kinds.toDF("sh", "y"), "sh").where("x < y")
            x, y = (few.select("sh", F.col("root").alias(c), F.struct("node", "n", "at").alias(f"m{c}")) for c in ("x", "y"))
            met = two.join(x, ["sh", "x"]).join(y, ["sh", "y"]).where(_reach("mx.", "my.", similarity)).select(F.least("mx.node", "my.node").alias("a"), F.greatest("mx.node", "my.node").alias("b"), F.col("sh").alias("by"))
        # A pair belongs to the least of its shared shingles: copies of one text have that in common.
        new = stored(met.groupBy("a", "b").agg(F.min("by").alias("by")).join(seen.select("a", "b"), ["a", "b"], "left_anti"), "candidates")
        found = similar(new, sets, similarity)
        sure = sure.unionByName(found)
        named = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = stored(components(named.unionByName(sure)), "roots")
        if not star:
            break
        seen = seen.unionByName(new)
        # Heads that meet few of their like join no more groups.
        star = 10 * found.count() >= new.count()
    discard(members)
    discard(sets)
    placed = keys.join(roots, "node", "left").select("k1", "k2", F.coalesce("root", "node").alias("root"))
    out = rows.drop("_text").join(placed, ["k1", "k2"])
    first = out.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return out.join(first, "root").select("doc_id", *carry, "root", "component_id")


@query("op10_simhash_groups")
def op10_simhash_groups(spark, sf_dir):
    """Fingerprint and component of every document."""
    out = simhash_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
