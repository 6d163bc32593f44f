"""Exact and near duplicate removal.

Scale notes. Hash groups may hold a third of the rows, so nothing here ranks or
collects a whole group: the survivor of a group is a partial aggregate, and the
survivors are matched back on the unique row id. Near duplicates are searched
among *distinct* fingerprints only; exact copies never meet each other.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import hex_to_bigint
from ..session import cut_lineage


def first_per_key(df: DataFrame, key: str, ord_col: str) -> DataFrame:
    """Rows whose ``ord_col`` is the smallest of their key. Rows stay where they are."""
    keep = df.groupBy(key).agg(F.min(ord_col).alias(ord_col)).select(ord_col)
    return df.join(keep, ord_col, "left_semi")


#: Tokens (C07) in lower-cased UTF-8: ASCII alphanumeric runs or single CJK characters.
TOKEN = re.compile(rb"[a-z0-9]+|\xe4[\xb8-\xbf][\x80-\xbf]|[\xe5-\xe9][\x80-\xbf]{2}")


def simhash(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, fp)`` with ``fp`` as 16 hex digits; a null text has none.

    Texts travel whole, not as lists of tokens; each Arrow batch hashes its distinct tokens once and adds
    up the bits of a text in one vectorized pass. Nothing is shuffled.
    """

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(simhash_batch(texts), pa.string())], [id_col, "fp"])

    return df.select(id_col, text_col).mapInArrow(fingerprint, f"{id_col} {df.schema[id_col].dataType.simpleString()}, fp string")


def simhash_batch(texts: list[bytes | None]) -> list[str | None]:
    """Fingerprints of a batch of UTF-8 texts; one without tokens has the head of its sha256.

    Bit b of byte j is set iff more than half of the tokens have it set in byte j of their md5.
    """
    known: dict[bytes, int] = {}
    lists = [np.array([known.setdefault(t, len(known)) for t in TOKEN.findall(x.lower())], np.int32) if x else np.zeros(0, np.int32) for x in texts]
    bits = np.unpackbits(np.frombuffer(b"".join(hashlib.md5(t).digest()[:8] for t in known), np.uint8).reshape(-1, 8), axis=1)
    out = []
    for x, codes in zip(texts, lists, strict=True):
        if x is None or not len(codes):
            out.append(None if x is None else hashlib.sha256(x).hexdigest()[:16])
            continue
        # Distinct tokens with their number: the working set follows the vocabulary of a text.
        seen, times = np.unique(codes, return_counts=True)
        ones = times @ bits[seen]
        out.append(np.packbits(2 * ones > len(codes)).tobytes().hex())
    return out


def _blocks(n_blocks: int) -> list[tuple[int, int]]:
    """Split 64 bits into ``n_blocks`` nearly equal (offset, width) pieces."""
    base, extra = divmod(64, n_blocks)
    out, at = [], 0
    for i in range(n_blocks):
        w = base + (1 if i < extra else 0)
        out.append((at, w))
        at += w
    return out


def near_pairs(
    fps: DataFrame, threshold: int = 3, n_blocks: int | None = None, hot_bucket: int = 4096
) -> DataFrame:
    """Exact pairs ``(a, b, dist)``, ``a < b``, of distinct fingerprints within ``threshold`` bits.

    ``fps`` has columns ``ord`` (unique) and ``fp`` (BIGINT, distinct). With B blocks and
    t differing bits at least B - t blocks agree, so every combination of B - t blocks is
    one search key: t + 3 blocks give keys of about 32 bits, narrow buckets even for
    billions of rows. A bucket that is still crowded is split again on the remaining
    bits by the same argument, which loses no pair.
    """
    fps = cut_lineage(fps)  # read once per key family below
    blocks = _blocks(n_blocks or threshold + 3)
    need = len(blocks) - threshold

    def piece(off: int, width: int):
        return F.shiftrightunsigned("fp", off).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))

    keys = [
        F.struct(F.lit(no).alias("c"), F.xxhash64(*[piece(*blocks[i]) for i in combo]).alias("k"))
        for no, combo in enumerate(combinations(range(len(blocks)), need))
    ]
    keyed = fps.select("ord", "fp", F.explode(F.array(*keys)).alias("key")).select("ord", "fp", "key.c", "key.k")
    sizes = keyed.groupBy("c", "k").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1)
    hot = sizes.where(F.col("m") > hot_bucket).select("c", "k")
    cold = sizes.where(F.col("m") <= hot_bucket).select("c", "k")

    def meet(rows: DataFrame, on: list[str]) -> DataFrame:
        a = rows.select(*on, F.col("ord").alias("a"), F.col("fp").alias("fa"))
        b = rows.select(*on, F.col("ord").alias("b"), F.col("fp").alias("fb"))
        dist = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb")))
        return a.join(b, on).where("a < b").select("a", "b", dist.alias("dist")).where(F.col("dist") <= threshold)

    # A crowded bucket: eight-bit slices of the whole word. At most `threshold` of the
    # eight slices differ, so some combination of 8 - threshold slices agrees.
    slices = _blocks(8)
    fine = [
        F.struct(F.lit(no).alias("c2"), F.xxhash64(*[piece(*slices[i]) for i in combo]).alias("k2"))
        for no, combo in enumerate(combinations(range(8), 8 - threshold))
    ]
    crowded = (
        keyed.join(hot, ["c", "k"], "left_semi")
        .select("ord", "fp").distinct()
        .select("ord", "fp", F.explode(F.array(*fine)).alias("f"))
        .select("ord", "fp", "f.c2", "f.k2")
    )
    found = meet(keyed.join(cold, ["c", "k"], "left_semi"), ["c", "k"]).unionByName(meet(crowded, ["c2", "k2"]))
    return found.distinct()


def _star_labels(edges: DataFrame) -> DataFrame:
    """``(id, comp)``: smallest id of the connected component, for every id of ``edges(a, b)``.

    Large-star and small-star steps in turn: every id moves its neighbours to its smallest one, so the depth of a
    component halves about every step. A hub is a partial minimum matched back, never a collected group.
    """
    def step(links: DataFrame, large: bool) -> DataFrame:
        # links(v, u) with u < v
        if large:
            both = links.select("v", "u").unionByName(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
            least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
            moved = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        else:
            least = links.groupBy("v").agg(F.min("u").alias("m"))
            moved = links.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(least.select("v", F.col("m").alias("u")))
        return moved.where("u < v").distinct()

    links, seen = edges.select(F.col("b").alias("v"), F.col("a").alias("u")), None
    while True:
        links = cut_lineage(step(step(links, True), False))
        mark = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u"))).first()
        if mark == seen:
            break
        seen = mark
    return links.select(F.col("v").alias("id"), F.col("u").alias("comp")).unionByName(links.select(F.col("u").alias("id"), F.col("u").alias("comp")).distinct())


def _settle(edges: DataFrame, bins: int) -> DataFrame:
    """Dropped ids of whole components ``edges(a, b, comp)``, several of them in a task, in order of the ids."""

    def walk(pdf):
        import pandas as pd

        gone: set = set()
        pdf = pdf.sort_values("b", kind="stable")
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            if a not in gone:  # every verdict below b has fallen, as a < b
                gone.add(b)
        return pd.DataFrame({"id": sorted(gone)}, dtype="int64" if not gone else None)

    binned = edges.withColumn("bin", F.pmod(F.xxhash64("comp"), F.lit(bins)))
    return binned.groupBy("bin").applyInPandas(walk, f"id {edges.schema['b'].dataType.simpleString()}")


def greedy_keep(pairs: DataFrame, task_edges: int = 200_000, rounds: int = 2) -> DataFrame:
    """Ids dropped by "drop if near any earlier kept id", from ``(a, b)`` with ``a < b``.

    A round keeps every id without an open earlier neighbour, drops the neighbours of these and takes both out; most
    groups end there. What is left (long chains) is split into connected components: those of up to ``task_edges`` pairs
    are settled whole, many in one task; larger ones go on in rounds. There is no limit on rounds and every round settles at
    least the smallest open id of each component. All state is in written tables.
    """
    edges = cut_lineage(pairs.select("a", "b"))
    parts = [edges.select(F.col("b").alias("id")).limit(0)]

    def drop(ids: DataFrame) -> DataFrame:
        parts.append(cut_lineage(ids))
        if len(parts) > 16:
            parts[:] = [cut_lineage(reduce(DataFrame.unionByName, parts[:-1])), parts[-1]]
        return parts[-1]

    while not edges.isEmpty():
        for _ in range(rounds):
            heads = edges.select("a").distinct().join(edges.select(F.col("b").alias("a")), "a", "left_anti")
            gone = drop(edges.join(heads, "a", "left_semi").select(F.col("b").alias("id")).distinct())
            edges = cut_lineage(
                edges.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b")
            )
            if edges.isEmpty():
                return reduce(DataFrame.unionByName, parts)
        labelled = cut_lineage(edges.join(_star_labels(edges).withColumnRenamed("id", "a"), "a"))
        sizes = cut_lineage(labelled.groupBy("comp").agg(F.count(F.lit(1)).alias("m")))
        small = sizes.where(F.col("m") <= task_edges)
        total = small.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
        if total:
            drop(_settle(labelled.join(small, "comp", "left_semi"), int(-(-total // task_edges))))
        edges = cut_lineage(labelled.join(sizes.where(F.col("m") > task_edges), "comp", "left_semi").select("a", "b"))
    return reduce(DataFrame.unionByName, parts)


def near_dedupe(fps: DataFrame, threshold: int = 3, **kw) -> DataFrame:
    """A01 then A02 over ``(ord, fp hex)``: every row with ``status`` kept / exact_dup / near_dup."""
    fps = cut_lineage(fps)  # asked for twice: the texts are fingerprinted once
    reps = fps.groupBy("fp").agg(F.min("ord").alias("ord"))
    reps = cut_lineage(reps.select("ord", hex_to_bigint(F.col("fp")).alias("fp")))
    dropped = greedy_keep(near_pairs(reps, threshold, **kw)).select(
        F.col("id").alias("ord"), F.lit("near_dup").alias("verdict")
    )
    judged = reps.join(dropped, "ord", "left").select(
        "ord", F.coalesce("verdict", F.lit("kept")).alias("verdict")
    )
    return fps.join(judged, "ord", "left").select(
        "ord", "fp", F.coalesce("verdict", F.lit("exact_dup")).alias("status")
    )
