"""Embedding near-dedup by PCA-ordered tiled comparison (operator 5).

Unit vectors are rotated onto their principal axes, largest variance first; a rotation keeps dot products. Two vectors'
product over the leading axes plus the product of their suffix norms bounds the cosine from above, so a pair is dropped as
soon as the bound is below the threshold; survivors are verified on the given numbers in double precision.

Vectors are ordered by (group, first axis) and cut into blocks. Blocks whose boxes over the leading axes are further apart
than the threshold allows never meet; the others meet as pairs of packed rows, each pair in one task of bounded memory.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, offsets, stored, table
from .forest import Forest
from .registry import query

THRESHOLD = 0.98
#: Vectors of a block, axes of a block's box, axes after which the bound is looked at again.
BLOCK, BOX, STEPS = 1024, 8, (8, 16, 32)
SLACK = 1e-9


def _vectors(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """By dimension: the principal axes (columns, largest variance first) of all unit vectors.

    Tasks sum outer products; sums of the same cell meet by partial aggregation, so the driver gets one square matrix
    for each dimension whatever the number of rows and tasks.
    """

    def outer(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            frame = b.to_pandas()
            for dim, group in frame.groupby("dim"):
                x = _vectors(group.v)
                x /= np.sqrt((x * x).sum(1))[:, None]
                sums[dim] = sums.get(dim, 0) + x.T @ x
        for dim, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, dim, np.int32)), pa.array(np.arange(dim, dtype=np.int32)), pa.array(list(m))], names=["dim", "i", "row"])

    rows = vectors.select("dim", "v").mapInArrow(outer, "dim int, i int, row array<double>")
    cells = rows.select("dim", "i", F.posexplode("row").alias("j", "x")).groupBy("dim", "i", "j").agg(F.sum("x").alias("x")).groupBy("dim", "i").agg(F.array_sort(F.collect_list(F.struct("j", "x"))).alias("row"))
    axes: dict[int, list] = {}
    for r in cells.orderBy("dim", "i").collect():
        axes.setdefault(r["dim"], []).append([c["x"] for c in r["row"]])
    out = {}
    for dim, m in axes.items():
        w, v = np.linalg.eigh((np.array(m) + np.array(m).T) / 2)
        out[dim] = v[:, np.argsort(-w, kind="stable")]
    return out


def tile_links(x: np.ndarray, y: np.ndarray, ux: np.ndarray, uy: np.ndarray, same: np.ndarray, threshold: float):
    """(i, j) of pairs of rows with cosine >= threshold where ``same`` allows; ux, uy are the rotated unit vectors."""
    done = 0
    part = np.zeros((len(ux), len(uy)))
    dims = ux.shape[1]
    i = j = None
    for step in [*(s for s in STEPS if s < dims), dims]:
        sx, sy = (np.sqrt(np.maximum((u[:, step:] ** 2).sum(1), 0)) for u in (ux, uy))
        if i is None:
            part += ux[:, done:step] @ uy[:, done:step].T
            alive = (part + sx[:, None] * sy[None, :] >= threshold - SLACK) & same
            # Once few pairs are left they go on as a list.
            if alive.sum() * 8 <= alive.size or step == dims:
                i, j = np.nonzero(alive)
                part = part[i, j]
        else:
            keep = []
            for a in range(0, len(i), 1 << 16):
                at = slice(a, a + (1 << 16))
                part[at] += np.einsum("ij,ij->i", ux[i[at], done:step], uy[j[at], done:step])
                keep.append(part[at] + sx[i[at]] * sy[j[at]] >= threshold - SLACK)
            keep = np.concatenate(keep) if keep else np.zeros(0, bool)
            i, j, part = i[keep], j[keep], part[keep]
        done = step
        if i is not None and not len(i):
            break
    nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    good = [np.zeros(0, bool)]
    for a in range(0, len(i), 1 << 16):
        p, q = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
        good.append(np.einsum("ij,ij->i", x[p], y[q]) / (nx[p] * ny[q]) >= threshold)
    good = np.concatenate(good)
    return i[good], j[good]


def embedding_groups(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", group: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id) for every row of ``df``.

    Rows of one group value link when their cosine is at least ``threshold``. Rows with a null group, a null, empty or zero
    vector, null or non-finite numbers link with nothing; vectors of different length neither. Equal vectors of a group are
    compared once and weigh with their number. component_id is the smallest vec_id over any chain of links (a row
    without links: its own). Repeated rows stay rows and are links of each other; an empty input gives an empty result.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    sound = F.col("g").isNotNull() & F.coalesce(F.size("v") > 0, F.lit(False))
    sound &= F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(group).cast("string").alias("g"), v.alias("v")).withColumn("ok", sound)
    keys = [F.xxhash64("g", "v").alias("k1"), F.xxhash64(F.lit("second"), "v", "g").alias("k2")]
    rows = rows.select("vec_id", "ok", "g", "v", F.size("v").alias("dim"), *keys)
    distinct = rows.where("ok").groupBy("g", "dim", "k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v"))
    distinct = stored(distinct, "vectors")
    axes = principal_axes(distinct)
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(axes)  # one square matrix for each dimension

    def lead(batches):
        for b in batches:
            dims, made = b.column("dim").to_pylist(), []
            for d, x in zip(dims, b.column("v").to_pylist(), strict=True):
                x = np.asarray(x)
                made.append((x / np.sqrt(x @ x) @ sent.value[d][:, :BOX]).tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.list_(pa.float64()))], names=[*b.schema.names, "c"])

    placed = distinct.mapInArrow(lead, "g string, dim int, k1 long, k2 long, least long, n long, v array<double>, c array<double>")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["g", "dim", "c1", "k1", "k2"]
    local = placed.withColumn("c1", F.col("c")[0]).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    low = F.monotonically_increasing_id()
    local = stored(local.select("*", F.shiftright(low, 33).alias("part"), low.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "ordered")
    before = offsets(local.groupBy("part").agg(F.count("*").alias("rows")), "part", "rows")
    local = local.join(F.broadcast(before), "part").withColumn("node", F.col("rows_before") + F.col("at"))
    nodes = local.select("g", "dim", "k1", "k2", "node", "least")

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        x, c = _vectors(frame.v), _vectors(frame.c)
        return pd.DataFrame({
            "g": frame.g.iloc[:1], "dim": [len(x[0])], "block": [int(frame.block.iloc[0])], "low": [c.min(0).tolist()], "high": [c.max(0).tolist()],
            "first": [int(frame.node.iloc[0])], "n": [frame.n.to_numpy(np.int64).tobytes()], "nodes": [frame.node.to_numpy(np.int64).tobytes()], "x": [x.tobytes()],
        })

    schema = "g string, dim int, block long, low array<double>, high array<double>, first long, n binary, nodes binary, x binary"
    blocks = stored(local.withColumn("block", F.expr(f"node div {BLOCK}")).select("g", "dim", "block", "node", "n", "v", "c").groupBy("g", "dim", "block").applyInPandas(pack, schema), "blocks")

    # Pairs of blocks of one group whose boxes are near: joined on bins of the first axis as wide as the largest distance.
    reach = (2 - 2 * threshold) ** 0.5 + SLACK
    box = blocks.select("g", "dim", "block", "low", "high").withColumn("a", F.floor(F.col("low")[0] / reach)).withColumn("b", F.floor(F.col("high")[0] / reach))
    left = box.withColumn("bin", F.explode(F.sequence(F.col("a"), F.col("b"))))
    right = box.select("g", "dim", *(F.col(c).alias(f"{c}2") for c in ("block", "low", "high")), F.explode(F.sequence(F.col("a") - 1, F.col("b") + 1)).alias("bin"))
    gap = F.expr("aggregate(zip_with(zip_with(low, high2, (l, h) -> greatest(l - h, 0D)), zip_with(low2, high, (l, h) -> greatest(l - h, 0D)), (p, q) -> greatest(p, q)), 0D, (s, x) -> s + x * x)")
    pairs = left.join(right, ["g", "dim", "bin"]).where("block <= block2").where(gap <= reach * reach).select("g", "dim", "block", "block2").distinct()
    one = blocks.select("g", "dim", "block", "n", "nodes", "x")
    two = blocks.select("g", "dim", F.col("block").alias("block2"), F.col("n").alias("n2"), F.col("nodes").alias("nodes2"), F.col("x").alias("x2"))
    met = pairs.join(one, ["g", "dim", "block"]).join(two, ["g", "dim", "block2"])
    # Every pair is about as much work, so pairs are dealt evenly.
    met = met.repartition(parts, F.xxhash64("g", "block", "block2"))

    def compare(batches):
        for b in batches:
            for r in (b.slice(k, 1).to_pylist()[0] for k in range(b.num_rows)):
                dim, own = r["dim"], r["block"] == r["block2"]
                x, y = (np.frombuffer(r[k]).reshape(-1, dim) for k in ("x", "x2"))
                n, n2, id1, id2 = (np.frombuffer(r[k], np.int64) for k in ("n", "n2", "nodes", "nodes2"))
                axes = sent.value[dim]
                ux, uy = (m / np.sqrt((m * m).sum(1))[:, None] @ axes for m in (x, y))
                same = np.triu(np.ones((len(x), len(y)), bool), 1) if own else np.ones((len(x), len(y)), bool)
                i, j = tile_links(x, y, ux, uy, same, threshold)
                if not len(i):
                    continue
                nodes = id1 if own else np.concatenate([id1, id2])
                forest, shift = Forest(len(nodes)), 0 if own else len(id1)
                starts = np.flatnonzero(np.diff(i, prepend=-1))
                for k, others in zip(i[starts].tolist(), np.split(j, starts[1:]), strict=True):
                    forest.link(k, others + shift)
                count = np.bincount(i, n2[j], len(nodes)) + np.bincount(j + shift, n[i], len(nodes))
                e = np.array(forest.edges, np.int64).reshape(-1, 2)
                linked = np.flatnonzero(count)
                a = np.concatenate([nodes[linked], nodes[e[:, 0]]])
                v = np.concatenate([count[linked].astype(np.int64), nodes[e[:, 1]]])
                kind = np.concatenate([np.zeros(len(linked), bool), np.ones(len(e), bool)])
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a), pa.array(v)], names=["edge", "a", "b"])

    found = stored(met.select("dim", "block", "block2", "n", "nodes", "x", "n2", "nodes2", "x2").mapInArrow(compare, "edge boolean, a long, b long"), "found")
    counts = found.where("not edge").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("others"))
    roots = components(found.where("edge").select("a", "b"))
    settled = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(counts, "node", "left")
    least = settled.groupBy("root").agg(F.min("least").alias("component_id"))
    settled = settled.join(least, "root").select("g", "k1", "k2", "component_id", F.coalesce("others", F.lit(0)).alias("others"))
    weight = distinct.select("g", "k1", "k2", "n")
    settled = settled.join(weight, ["g", "k1", "k2"]).select(*(F.col(c).alias(f"_{c}") for c in ("g", "k1", "k2")), "component_id", (F.col("others") + F.col("n") - 1).alias("n_links"))
    joined = rows.select("vec_id", "ok", "g", "k1", "k2").join(settled, F.expr("ok AND g = _g AND k1 = _k1 AND k2 = _k2"), "left")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))


OP5_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON v.vec_id = c.a LEFT JOIN n ON v.vec_id = n.a
"""


@query("op5_pca_tiles", OP5_SQL)
def op5_pca_tiles(spark, sf_dir):
    """Links and component of every embedding within its label."""
    out = embedding_groups(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return out.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
