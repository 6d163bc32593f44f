"""Hard-negative mining over an STR-packed R-tree of quantized vectors (operator 11).

Rows are put in sort-tile-recursive order: within a label by the coordinate of greatest variance, cut into slabs, each slab by the
next coordinate, and so on. Consecutive rows of that order are the leaves, consecutive leaves the inner nodes, so a task packs the
rows it reads into trees of bounded size without another shuffle. A node keeps the least and greatest value of each coordinate. With the
signs of an anchor's coordinates these give an interval of inner products, exact in integers.

Each anchor descends a tree best bound first. A node is dropped when its interval misses every score window of the anchor, or ends
strictly below the k-th best score found in that window (also in earlier trees of the task). Tasks return their k best, and those
of all tasks meet in a window by Spark. Anchors come in blocks of bounded size, each block against all rows in place.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import running, scratch, stored, table
from .registry import query

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: Negative scores lie between these hundredths of the positive score.
LOW, HIGH = 30, 90
#: Rows of a leaf, children of a node, coordinates that tile, numbers of a tree and of a block of anchors.
LEAF, FAN, AXES = 128, 16, 3
TREE_NUMBERS, BLOCK_NUMBERS = 1 << 20, 1 << 20
#: Squared norms up to this keep every inner product within a long.
MOST_NORM = float(1 << 62)
NONE = -(1 << 63)


class Tree:
    """Rows of one label and dimension in packed order, with boxes of their leaves and of the nodes above."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, void: np.ndarray, uids: np.ndarray, most: int):
        # Products stay exact in doubles below 2^53; beyond that Python's integers do the work.
        wide = x.shape[1] * most * int(np.abs(x).max(initial=0)) >= 1 << 53
        self.x = x.astype(object if wide else np.float64)
        self.ids, self.void, self.uids = ids, void, uids
        low = high = self.x
        self.levels = []
        step = LEAF
        while not self.levels or len(low) > 1:
            at = np.arange(0, len(low), step)
            low, high, step = np.minimum.reduceat(low, at, axis=0), np.maximum.reduceat(high, at, axis=0), FAN
            self.levels.append((low, high))

    def intervals(self, level: int, nodes: slice, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product in each box with an anchor of positive part ``up`` and negative part ``down``."""
        low, high = (m[nodes] for m in self.levels[level])
        return low @ up + high @ down, high @ up + low @ down


class Best:
    """The k best rows of each score window of one anchor: higher scores first, ties by smaller id, null ids last."""

    def __init__(self, k: int, low: np.ndarray, high: np.ndarray):
        self.k, self.low, self.high = k, low, high
        self.rows = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in low]
        #: Scores below this cannot enter.
        self.floor = low.copy()

    def may_enter(self, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Which intervals touch a window at or above its k-th score."""
        return ((least[:, None] <= self.high) & (np.minimum(most[:, None], self.high) >= self.floor)).any(1)

    def offer(self, scores: np.ndarray, ids: np.ndarray, void: np.ndarray) -> None:
        fit = (scores >= self.floor[:, None]) & (scores <= self.high[:, None])
        for w in np.flatnonzero(fit.any(1)):
            s, i, v = (np.concatenate([old, new[fit[w]]]) for old, new in zip(self.rows[w], (scores, ids, void), strict=True))
            first = np.lexsort((i, v, -s))[: self.k]
            self.rows[w] = s[first], i[first], v[first]
            if len(first) == self.k:
                self.floor[w] = max(self.low[w], s[first[-1]])


def search(tree: Tree, anchor: np.ndarray, own: int, best: Best) -> int:
    """Offers to ``best`` what ``tree`` holds for ``anchor`` (not the row ``own`` itself); the number of leaves that were read."""
    a = anchor.astype(tree.x.dtype)
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    top, read = len(tree.levels) - 1, 0
    ceiling = int(best.high.max(initial=NONE))
    queue: list = []

    def push(level: int, nodes: slice) -> None:
        least, most = tree.intervals(level, nodes, up, down)
        for i in np.flatnonzero(best.may_enter(least, most)).tolist():
            heapq.heappush(queue, (-min(int(most[i]), ceiling), level, nodes.start + i, int(least[i]), int(most[i])))

    push(top, slice(0, 1))
    while queue:
        _, level, node, least, most = heapq.heappop(queue)
        if not best.may_enter(np.array([least]), np.array([most]))[0]:
            continue
        if level:
            push(level - 1, slice(node * FAN, min((node + 1) * FAN, len(tree.levels[level - 1][0]))))
            continue
        rows = slice(node * LEAF, (node + 1) * LEAF)
        read += 1
        other = tree.uids[rows] != own
        scores = (tree.x[rows] @ a).astype(np.int64)
        best.offer(scores[other], tree.ids[rows][other], tree.void[rows][other])
    return read


def quantized(df: DataFrame, vec_id: str, vector: str, label: str, scale: int = SCALE) -> DataFrame:
    """(uid, vec_id, label, dim, v) of the rows that take part; v holds floor(scale * x) of every component."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), x.alias("x"))
    sound = F.coalesce(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(1 << 31) / scale)), F.lit(False))
    rows = rows.where(F.col("label").isNotNull() & F.col("x").isNotNull() & sound)
    rows = rows.select("vec_id", "label", F.size("x").alias("dim"), F.transform("x", lambda c: F.floor(c * scale).cast("int")).alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    return rows.where(norm < MOST_NORM).withColumn("uid", F.monotonically_increasing_id())


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), dim)


def tiling_axes(rows: DataFrame, axes: int = AXES) -> dict[int, list[int]]:
    """By dimension: the coordinates of greatest variance. Tasks send sums of each coordinate."""

    def moments(batches: Iterator[pa.RecordBatch]):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                x = _matrix(b.column("v").filter(pa.array(dims == dim)), dim).astype(np.float64)
                held[dim] = held.get(dim, 0) + np.stack([np.full(dim, float(len(x))), x.sum(0), (x * x).sum(0)])
        for dim, m in held.items():
            if dim:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, dim, np.int32)), pa.array(np.arange(dim, dtype=np.int32)), *map(pa.array, m)], names=["dim", "i", "n", "s", "q"])

    sums = rows.select("dim", "v").mapInArrow(moments, "dim int, i int, n double, s double, q double").groupBy("dim", "i")
    spread = sums.agg((F.sum("q") / F.sum("n") - F.pow(F.sum("s") / F.sum("n"), 2)).alias("var"))
    first = spread.withColumn("k", F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("var"), "i"))).where(F.col("k") <= axes)
    out: dict[int, list[int]] = {}
    for r in first.orderBy("dim", "k").collect():  # AXES numbers for each length of vectors
        out.setdefault(r["dim"], []).append(r["i"])
    return out


def packed(rows: DataFrame) -> DataFrame:
    """``rows`` stored in sort-tile-recursive order within each label and dimension.

    Ranks come from range sorts that end in the row's uid, so equal vectors and a label with most of the rows are split over tasks like any others.
    """
    axes = tiling_axes(rows)
    for k in range(AXES):
        pick = F.lit(0)
        for dim, cs in axes.items():
            pick = F.when(F.col("dim") == dim, F.col("v")[cs[min(k, len(cs) - 1)]]).otherwise(pick)
        rows = rows.withColumn(f"c{k}", pick)
    group = ["label", "dim"]
    rows = running(rows, [*group, "c0", "uid"], {}, "at", "packed")
    sizes = stored(rows.groupBy(*group).agg(F.min("at").alias("start"), F.count("*").alias("n")), "labels")
    cuts = F.ceil(F.pow(F.ceil(F.col("n") / LEAF), F.lit(1 / AXES)) - 1e-9).alias("cuts")
    rows = rows.join(sizes.select("*", cuts), group).withColumn("slab", F.expr("(at - start) * cuts div n")).drop("at")
    rows = running(rows, [*group, "slab", "c1", "uid"], {}, "at", "packed")
    # Slab s holds the ranks from ceil(s n / cuts) on.
    first = F.expr("(slab * n + cuts - 1) div cuts")
    size = F.expr("((slab + 1) * n + cuts - 1) div cuts") - first
    rows = rows.withColumn("tile", F.floor((F.col("at") - F.col("start") - first) * F.col("cuts") / size))
    order = [*group, "slab", "tile", "c2", "uid"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("uid", "vec_id", "label", "dim", "v"), "packed")


def trees(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[object, int, Tree]]:
    """(label, dim, tree) of the rows as they come, cut where label or dimension change and at TREE_NUMBERS numbers."""
    held: list[pa.RecordBatch] = []
    key, count = None, 0

    def made():
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        ids = whole.column("vec_id")
        return (*key, Tree(_matrix(whole.column("v"), key[1]), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), whole.column("uid").to_numpy(), most))

    for b in batches:
        labels, dims = b.column("label").to_pylist(), b.column("dim").to_pylist()
        at = 0
        while at < b.num_rows:
            now = labels[at], dims[at]
            room = max(LEAF, TREE_NUMBERS // max(1, now[1])) - (count if now == key else 0)
            if now != key or room <= 0:
                if held:
                    yield made()
                held, key, count = [], now, 0
                continue
            end = at + 1
            while end < b.num_rows and end - at < room and labels[end] == now[0] and dims[end] == now[1]:
                end += 1
            held.append(b.slice(at, end - at))
            count += end - at
            at = end
    if held:
        yield made()


def _top(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


FOUND = "uid long, anchor_id long, positive long, positive_id long, positive_score long, id long, score long"


def _searched(index: DataFrame, asked: list[dict], k: int, same: bool) -> DataFrame:
    """The ``k`` best rows of each task for every window of the anchors ``asked``, among rows of the same label or of the others."""
    most = max((int(np.abs(a["v"]).max(initial=0)) for a in asked), default=0)
    sent = index.sparkSession.sparkContext.broadcast((asked, most))  # a block of BLOCK_NUMBERS numbers

    def run(batches: Iterator[pa.RecordBatch]):
        asked, most = sent.value
        best: dict[int, Best] = {}
        for label, dim, tree in trees(batches, most):
            for i, a in enumerate(asked):
                if len(a["v"]) == dim and (a["label"] == label) == same and len(a["low"]):
                    if i not in best:
                        best[i] = Best(k, a["low"], a["high"])
                    search(tree, a["v"], a["uid"], best[i])
        out: list[list] = [[] for _ in range(7)]
        for i, b in best.items():
            a = asked[i]
            for w, (scores, ids, void) in enumerate(b.rows):
                for s, d, v in zip(scores.tolist(), ids.tolist(), void.tolist(), strict=True):
                    p = a["positives"][w] if a["positives"] else (None, None)
                    for column, x in zip(out, (a["uid"], a["vec_id"], w, p[0], p[1], None if v else d, s), strict=True):
                        column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=[f.split(" ")[0] for f in FOUND.split(", ")])

    return index.mapInArrow(run, FOUND)


def hard_negatives(
    df: DataFrame, anchors: str, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of ``df`` that meet ``anchors``, an SQL condition on vec_id and label.

    A score is the inner product of quantized vectors. An anchor's positives are its ``positives`` best other rows of the same
    label; for each, the ``negatives`` best rows of other labels whose score lies between ``low`` and ``high`` hundredths of the
    positive score. Ties go to the smaller vec_id, a null vec_id comes last. Rows with a null label or vector, with null or
    non-finite components, or with a quantized squared norm of 2^62 or more (scores would not fit a long) take no part; vectors of
    different length never meet, empty ones score 0. Repeated rows are rows: a copy of an anchor is an anchor, and a positive of
    the other. Anchors without a positive or a negative give no row. An empty input gives an empty result; columns besides
    the three named are not looked at.
    """
    spark = df.sparkSession
    index = packed(stored(quantized(df, vec_id, vector, label), "vectors"))
    queries = stored(index.where(anchors), "anchors")
    # Blocks by hash: every block holds about BLOCK_NUMBERS numbers.
    blocks = int(queries.agg(F.ceil(F.sum("dim") / BLOCK_NUMBERS)).first()[0] or 1)
    path = scratch(spark, "negatives")
    everything = np.array([NONE]), np.array([(1 << 63) - 1])
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == b).orderBy("uid").collect()
        asked = [{"uid": r["uid"], "vec_id": r["vec_id"], "label": r["label"], "v": np.array(r["v"], np.int64), "low": everything[0], "high": everything[1], "positives": None} for r in rows]
        near: dict[int, list] = {}
        for r in _top(_searched(index, asked, positives, True), ["uid"], positives).orderBy("uid", "rank").collect():  # ``positives`` for each anchor of the block
            near.setdefault(r["uid"], []).append((r["id"], r["score"]))
        for a in asked:
            a["positives"] = near.get(a["uid"], [])
            scores = [s for _, s in a["positives"]]
            a["low"] = np.array([-(-low * s // 100) for s in scores], np.int64)
            a["high"] = np.array([high * s // 100 for s in scores], np.int64)
        best = _top(_searched(index, asked, negatives, False), ["uid", "positive"], negatives)
        best.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    return spark.read.schema("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long").parquet(path)


OP11_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, CAST(embedding AS DOUBLE[]) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
),
q AS (
  SELECT r, vec_id, label, list_transform(e, lambda x: floor(256 * x)) AS e FROM v
  WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM q a JOIN q b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0
),
p AS (
  SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id NULLS LAST) AS k FROM s WHERE same QUALIFY k <= 5
),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.a, p.k ORDER BY s.score DESC, s.id NULLS LAST) AS rank,
         s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
  QUALIFY rank <= 10
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n
"""


@query("op11_str_hard_negatives", OP11_SQL)
def op11_str_hard_negatives(spark, sf_dir):
    """Hard negatives for the positives of every hundredth embedding; every seventh has the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label")), "vec_id % 100 = 0")
