"""Approximate vector search with exact rerank (V03): by k-means cells, and by product quantization of the residuals in them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage
from .topk import CELLS, InnerProduct, _grid_best, top_k
from .vectors import dot, rerank_ranks

#: Rows the cells are fitted on (least hash of the id first); every row is indexed.
FIT_ROWS = 20_000


def fit_cells(bank: DataFrame, cells: int = 32, rows: int = FIT_ROWS, seed: int = 7) -> np.ndarray:
    """Centres of the cells of ``bank(rid, item)``, from at most ``rows`` rows."""
    sample = bank.orderBy(F.xxhash64("rid"), "rid").limit(rows).select(array_to_vector(F.col("item").cast("array<double>")).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(sample)
    return np.array(model.clusterCenters())


def nearest_cells(vec: Column, centres: np.ndarray, n: int) -> Column:
    """The ``n`` cells whose centres are nearest, best first (ties: lower number)."""
    norms = (centres * centres).sum(1)

    @F.pandas_udf("array<int>")
    def cells(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        far = norms[None, :] - 2 * np.stack(v.to_numpy()).astype(np.float64) @ centres.T
        return pd.Series(list(np.argsort(far, axis=1, kind="stable")[:, :n].astype(np.int32)))

    return cells(vec)


def index_cells(bank: DataFrame, centres: np.ndarray) -> DataFrame:
    """``bank`` with the cell of every row; written by cell it is the index."""
    return bank.withColumn("cell", F.get(nearest_cells(F.col("item"), centres, 1), 0))


def search_cells(queries: DataFrame, indexed: DataFrame, centres: np.ndarray, k: int, probe: int) -> DataFrame:
    """Best ``k`` rows of the ``probe`` nearest cells of each query, by exact inner product.

    The query side is written first, so its size is known; it is broadcast only if small, else both meet on the cell.
    The rank filter lets each task keep its best rows before the shuffle.
    """
    q = cut_lineage(queries.select("qid", F.col("item").alias("q"), F.explode(nearest_cells(F.col("item"), centres, probe)).alias("cell")))
    met = indexed.select("rid", "item", "cell").join(broadcast_if_small(q), "cell")
    scored = met.select("qid", "rid", (F.round(dot(F.col("q"), F.col("item")), 6) + 0.0).alias("score"))
    return rerank_ranks(scored, "qid", F.col("score").desc(), F.col("rid"), k=k).select("qid", "rid", "score", "rank")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact rows that were found, by query."""
    hit = found.select("qid", "rid", F.lit(1).alias("hit"))
    both = exact.select("qid", "rid").join(hit, ["qid", "rid"], "left")
    return both.groupBy("qid").agg(F.count(F.lit(1)).alias("wanted"), F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("recall"))


#: Most cells of a quantizer; with ``FIT_ROWS`` a cell is fitted on five rows at least.
MOST_CELLS = 4096


@dataclass(frozen=True)
class Quantizer:
    """Cell centres, and one codebook for each slice of the residual (row minus its centre)."""

    centres: np.ndarray
    books: list[np.ndarray]

    def bounds(self) -> np.ndarray:
        return np.cumsum([0, *[b.shape[1] for b in self.books]])

    def encode(self, vecs: np.ndarray) -> np.ndarray:
        """Rows of (cell, code of slice 0, code of slice 1, ...)."""
        cell = _nearest(vecs, self.centres)
        rest, at = vecs - self.centres[cell], self.bounds()
        codes = [_nearest(rest[:, at[m] : at[m + 1]], b) for m, b in enumerate(self.books)]
        return np.stack([cell, *codes], axis=1).astype(np.int32)


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Nearest centre of each row (ties: lower number), in pieces of bounded size."""
    norms, step = (centres * centres).sum(1), max(1, CELLS // len(centres))
    parts = [np.argmin(norms[None, :] - 2 * rows[i : i + step] @ centres.T, axis=1) for i in range(0, len(rows), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _codebook(rows: np.ndarray, size: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's rounds over the slices of the fitted sample; an empty code keeps its place."""
    centres = rows[np.random.default_rng(seed).permutation(len(rows))[:size]]
    for _ in range(rounds):
        code = _nearest(rows, centres)
        count = np.bincount(code, minlength=len(centres))
        total = np.stack([np.bincount(code, weights=rows[:, j], minlength=len(centres)) for j in range(rows.shape[1])], axis=1)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def fit_quantizer(bank: DataFrame, n_rows: int, slices: int = 16, codes: int = 256, rows: int = FIT_ROWS, seed: int = 7) -> Quantizer:
    """Quantizer of ``bank(rid, item)`` with about sqrt(``n_rows``) cells, fitted on at most ``rows`` rows (least hash of the id first)."""
    cells = int(min(MOST_CELLS, max(1, round(n_rows**0.5))))
    centres = fit_cells(bank, cells, rows, seed)
    got = bank.orderBy(F.xxhash64("rid"), "rid").limit(rows).select("item").toPandas()["item"]
    vecs = np.stack(got.to_numpy()).astype(np.float64)
    rest = vecs - centres[_nearest(vecs, centres)]
    return Quantizer(centres, [_codebook(part, min(codes, len(part)), seed + m) for m, part in enumerate(np.array_split(rest, min(slices, rest.shape[1]), axis=1))])


def encode_bank(bank: DataFrame, model: Quantizer) -> DataFrame:
    """``(rid, item)`` with ``item`` the codes of every row: a few bytes in place of the vector, the index to be written."""

    @F.pandas_udf("array<int>")
    def codes(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        return pd.Series(list(model.encode(np.stack(v.to_numpy()).astype(np.float64))))

    return bank.select("rid", codes(F.col("item")).alias("item"))


class CodedInnerProduct(InnerProduct):
    """Inner products with coded rows: the cell's product plus one table entry for each slice; only the query's best cells."""

    def __init__(self, qids: list, items: list[list[float]], model: Quantizer, probe: int):
        super().__init__(qids, items)
        at = model.bounds()
        self.width = 1 + len(model.books)
        self.mat = self.mat if len(qids) else np.zeros((0, at[-1]))
        self.cell = self.mat @ model.centres.T
        self.tables = [self.mat[:, at[m] : at[m + 1]] @ b.T for m, b in enumerate(model.books)]
        best = np.argsort(-self.cell, axis=1, kind="stable")[:, :probe]
        self.probed = np.zeros(self.cell.shape, bool)
        np.put_along_axis(self.probed, best, True, axis=1)

    def parts(self, ids: np.ndarray, col: pa.Array, k: int, bars: np.ndarray):
        codes = np.asarray(pc.list_flatten(col)).reshape(-1, self.width)
        order = np.argsort(codes[:, 0], kind="stable")
        cells, begin = np.unique(codes[order, 0], return_index=True)
        for cell, rows in zip(cells, np.split(order, begin[1:])):
            q = np.nonzero(self.probed[:, cell])[0]
            step = max(1, CELLS // max(1, len(q)))
            for at in range(0, len(rows) if len(q) else 0, step):
                r = rows[at : at + step]
                grid = np.repeat(self.cell[q, cell][:, None], len(r), axis=1)
                for m, table in enumerate(self.tables):
                    grid += table[q][:, codes[r, m + 1]]
                i, row, score = _grid_best(np.round(grid, 6), ids[r], k, bars[q][:, None])
                yield q[i], row, score


def search_coded(queries: DataFrame, coded: DataFrame, bank: DataFrame, model: Quantizer, k: int, keep: int, probe: int) -> DataFrame:
    """Best ``k`` rows of each query by exact inner product among its ``keep`` best by codes, from its ``probe`` best cells.

    The codes are scanned once in place for a block of queries (more blocks meet them in co-groups); each task keeps ``keep``
    rows a query. Only these rows' vectors are then read. Null vectors have no place in ``bank`` or ``queries``.
    """
    near = cut_lineage(top_k(queries, coded, CodedInnerProduct, keep, options={"model": model, "probe": probe}).select("qid", "rid"))
    q = queries.select("qid", F.col("item").alias("q"))
    met = bank.select("rid", "item").join(broadcast_if_small(near), "rid").join(broadcast_if_small(q), "qid")
    scored = met.select("qid", "rid", (F.round(dot(F.col("q"), F.col("item")), 6) + 0.0).alias("score"))
    return rerank_ranks(scored, "qid", F.col("score").desc(), F.col("rid"), k=k).select("qid", "rid", "score", "rank")
