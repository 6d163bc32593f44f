"""Exact top-k of many queries against a large table without emitting all pairs.

The query side is cut into blocks of proven size. A single block travels to the
tasks as a broadcast variable and the large side is scanned once, in place: each
task keeps only its best k rows per query and the partial lists meet in one window.
With more than one block the pairing is done by Spark instead: queries are
replicated over hashed buckets of the large side and met in bounded co-groups,
so neither the driver nor a task ever holds a whole side.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

QUERY_BLOCK_ROWS = 20_000
QUERY_BLOCK_ITEMS = 2_000_000
BUCKET_ROWS = 50_000
BUCKET_ITEMS = 10_000_000
CELLS = 4_000_000
ROUNDING = 1e-6  # scores are rounded to six places, so bars are tested with this slack


def _keep_best(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int):
    """Best k per query of (query index, row id, score): score descending, id ascending."""
    q, i, s = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((i, -s, q))
    q, i, s = q[order], i[order], s[order]
    first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(q)), 0)) if len(q) else np.zeros(0, int)
    sel = np.arange(len(q)) - start < k
    return q[sel], i[sel], s[sel]


class TokenOverlap:
    """Counts shared tokens of each query with each row of a batch, without a grid of queries and rows.

    A row that reaches a query's bar (its threshold, or the k-th best score so far) shares ``need`` tokens with it, so it
    holds one of the query's ``n - need + 1`` first tokens in any order; here the order is rarest first within the piece
    at hand. Only the rows of these tokens become candidates, and only candidates are counted out over the rest. A query
    with fewer than ``need`` tokens in the whole piece is left out at once. Both are exact and need no statistics of the table.
    """

    score_type = "bigint"

    def __init__(self, qids: list, items: list[list[str]], min_pct: int = 0):
        self.qids = qids
        self.work = 0  # postings read and tokens looked up
        lists = [list(dict.fromkeys(t)) for t in items]
        vocab: dict[str, int] = {}
        self.tok = np.array([vocab.setdefault(t, len(vocab)) for ts in lists for t in ts], dtype=np.int64)
        self.vocab = list(vocab)
        self.n = np.array([len(ts) for ts in lists], dtype=np.int64)
        self.starts = np.cumsum(self.n) - self.n
        self.query = np.repeat(np.arange(len(lists)), self.n)
        self.posts = np.bincount(self.tok, minlength=len(vocab))
        self.least = -(-self.n * min_pct // 100)

    def bars(self, min_score: float) -> np.ndarray:
        """Least score of each query."""
        return np.maximum(self.least.astype(np.float64), min_score)

    def need(self, bars: np.ndarray, smallest_row: int) -> np.ndarray:
        """Shared tokens without which no row of this size or more reaches the bar."""
        return np.maximum(np.ceil(bars), 1).astype(np.int64)

    def score(self, shared: np.ndarray, query: np.ndarray, row_size: np.ndarray) -> np.ndarray:
        return shared

    def parts(self, ids: np.ndarray, col: pa.Array, k: int, bars: np.ndarray):
        """Best rows piece by piece; ``bars`` is raised by the caller between pieces."""
        size = np.asarray(pc.fill_null(pc.list_value_length(col), 0)).astype(np.int64)
        row = np.asarray(pc.list_parent_indices(col)).astype(np.int64)
        hit = pc.index_in(pc.list_flatten(col), value_set=pa.array(self.vocab, pa.string()))
        ok = np.asarray(hit.is_valid())
        row, tok = row[ok], np.asarray(hit.drop_null()).astype(np.int64)
        by_size = np.argsort(size, kind="stable")  # rows of like size share a tight bar
        place = np.empty(len(size), np.int64)
        place[by_size] = np.arange(len(size))
        key = np.unique(place[row] * max(1, len(self.vocab)) + tok)
        row, tok = key // max(1, len(self.vocab)), key % max(1, len(self.vocab))
        ends = np.cumsum(np.bincount(row, weights=self.posts[tok], minlength=len(size))) if len(row) else np.zeros(len(size))
        ids, size = ids[by_size], size[by_size]
        at, budget = 0, CELLS // 64  # small pieces first: they raise the bars
        while at < len(ids):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + budget, side="right")))
            lo, hi = np.searchsorted(row, [at, to])
            if hi > lo:
                yield from self._piece(ids[at:to], size[at:to], row[lo:hi] - at, tok[lo:hi], k, bars)
            at, budget = to, min(CELLS, budget * 2)

    def _piece(self, ids: np.ndarray, size: np.ndarray, row: np.ndarray, tok: np.ndarray, k: int, bars: np.ndarray):
        rows, width = len(ids), len(self.vocab)
        df = np.bincount(tok, minlength=width)
        need = self.need(bars, int(size[0]))
        there = np.bincount(self.query, weights=df[self.tok] > 0, minlength=len(self.n))
        order = np.lexsort((df[self.tok], self.query))  # each query's tokens, rarest first
        prefix = np.where(there >= need, np.maximum(self.n - need + 1, 0), 0)
        first = np.arange(len(order)) - self.starts[self.query[order]] < prefix[self.query[order]]
        lead = order[first & (df[self.tok[order]] > 0)]
        lead = lead[np.argsort(self.tok[lead], kind="stable")]
        count = np.bincount(self.tok[lead], minlength=width)
        begin = np.cumsum(count) - count
        held = count[tok] > 0
        r, t = row[held], tok[held]
        met, owner = _ranges(begin[t], count[t])
        pair, shared = np.unique(self.query[lead[met]] * rows + r[owner], return_counts=True)
        self.work += len(met)
        key = row * width + tok
        looked = np.cumsum((self.n - prefix)[pair // rows])
        at = 0
        while at < len(pair):
            to = max(at + 1, int(np.searchsorted(looked, (looked[at - 1] if at else 0) + CELLS, side="right")))
            q, r = pair[at:to] // rows, pair[at:to] % rows
            rest, owner = _ranges(self.starts[q] + prefix[q], self.n[q] - prefix[q])
            want = r[owner] * width + self.tok[order[rest]]
            found = key[np.minimum(np.searchsorted(key, want), len(key) - 1)] == want
            self.work += len(rest)
            both = shared[at:to] + np.bincount(owner, weights=found, minlength=len(q)).astype(np.int64)
            score = self.score(both, q, size[r])
            good = score >= bars[q]
            if good.any():
                yield _keep_best([(q[good], ids[r[good]], score[good])], k)
            at = to


class ShareOfRowTokens(TokenOverlap):
    """Shared tokens over the query's own token count, rounded (answer overlap)."""

    score_type = "double"

    def need(self, bars: np.ndarray, smallest_row: int) -> np.ndarray:
        return np.maximum(np.ceil((bars - ROUNDING) * self.n), 1).astype(np.int64)

    def score(self, shared: np.ndarray, query: np.ndarray, row_size: np.ndarray) -> np.ndarray:
        return np.round(shared / self.n[query], 6)


class ShingleOverlap(TokenOverlap):
    """Best of Jaccard and 0.6 x containment of the row; short queries use their own containment."""

    score_type = "double"
    short_below = 18  # shingles of a query under 20 characters

    def need(self, bars: np.ndarray, smallest_row: int) -> np.ndarray:
        s = np.maximum(bars - ROUNDING, 0)
        long = np.minimum(s * (self.n + smallest_row) / (1 + s), s * smallest_row / 0.6)
        return np.maximum(np.ceil(np.where(self.n < self.short_below, s * self.n, long) - ROUNDING), 1).astype(np.int64)

    def score(self, shared: np.ndarray, query: np.ndarray, row_size: np.ndarray) -> np.ndarray:
        n, m = self.n[query], np.maximum(row_size, 1)
        return np.round(np.where(n < self.short_below, shared / n, np.maximum(shared / (n + m - shared), shared / m * 0.6)), 6)


def _ranges(begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges ``begin .. begin + length``, and the range each belongs to."""
    owner = np.repeat(np.arange(len(length)), length)
    return np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(begin, length), owner


class InnerProduct:
    """Double-precision inner products, rounded so that ranking is reproducible."""

    score_type = "double"

    def __init__(self, qids: list, items: list[list[float]]):
        self.qids = qids
        self.mat = np.array(items, dtype=np.float64).reshape(len(qids), -1) if len(qids) else np.zeros((0, 0))

    def bars(self, min_score: float) -> np.ndarray:
        return np.full(len(self.qids), min_score, dtype=np.float64)

    def parts(self, ids: np.ndarray, col: pa.Array, k: int, bars: np.ndarray):
        step = max(1, CELLS // max(1, len(self.qids)))
        for at in range(0, len(ids), step):
            piece = col.slice(at, step)
            sub = ids[at : at + step]
            lens = np.asarray(pc.fill_null(pc.list_value_length(piece), -1))
            wrong = lens[lens != self.mat.shape[1]]
            if len(wrong):
                raise ValueError(f"dimension mismatch: {wrong[0]} vs {self.mat.shape[1]} (-1: null)")
            vecs = np.asarray(pc.list_flatten(piece)).astype(np.float64).reshape(len(sub), -1)
            grid = np.round(self.mat @ vecs.T, 6) + 0.0
            yield _grid_best(grid, sub, k, np.reshape(bars, (-1, 1)))


def _grid_best(grid: np.ndarray, ids: np.ndarray, k: int, min_score: np.ndarray):
    """Candidates of one batch: everything at or above each query's k-th best score."""
    if grid.shape[1] > k:
        kth = np.partition(grid, grid.shape[1] - k, axis=1)[:, grid.shape[1] - k][:, None]
        q, r = np.nonzero((grid >= kth) & (grid >= min_score))
    else:
        q, r = np.nonzero(grid >= min_score)
    return _keep_best([(q, ids[r], grid[q, r])], k)


def _scan(ids: np.ndarray, col: pa.Array, index: Any, k: int, min_score: float, best=None):
    """``best`` with the rows of one batch; the k-th best score so far is the bar of what follows."""
    bars = index.bars(min_score)

    def raise_bars() -> None:
        q, _, s = best
        full = np.nonzero(np.bincount(q, minlength=len(bars)) >= k)[0]
        kth = s[np.searchsorted(q, full, side="right") - 1]
        bars[full] = np.maximum(bars[full], kth)

    if best is not None:
        raise_bars()
    for part in index.parts(ids, col, k, bars):
        best = part if best is None else _keep_best([best, part], k)
        raise_bars()
    return best


def _scan_groups(batches: Iterator[pa.RecordBatch], index: Any, k: int, min_score: float) -> dict:
    """Best rows per value of the ``grp`` column (one entry under None without it)."""
    best: dict = {}
    for b in batches:
        if not b.num_rows:
            continue
        if "grp" in b.schema.names:
            col = b.column("grp")
            pieces = [(g, b.filter(pc.equal(col, g))) for g in pc.unique(col).drop_null()]
        else:
            pieces = [(None, b)]
        for g, piece in pieces:
            key = None if g is None else g.as_py()
            got = _scan(np.asarray(piece.column("rid")), piece.column("item"), index, k, min_score, best.get(key))
            if got is not None:
                best[key] = got
    return best


def top_k(
    queries: DataFrame,
    rows: DataFrame,
    kernel: type,
    k: int,
    min_score: float = -np.inf,
    query_block_rows: int = QUERY_BLOCK_ROWS,
    query_block_items: int = QUERY_BLOCK_ITEMS,
    bucket_rows: int = BUCKET_ROWS,
    bucket_items: int = BUCKET_ITEMS,
    options: dict | None = None,
) -> DataFrame:
    """``queries(qid, item)`` x ``rows(rid, item)`` -> ``(qid, rid, score, rank)``, rank <= k.

    With a ``grp`` column on ``rows`` the k best are kept per (query, grp), still in one scan. ``options`` go to the kernel.
    More than one block of queries meets the rows in co-groups bounded by rows and by what their lists hold.
    """
    grouped = "grp" in rows.columns
    carry = ["grp", "rid", "item"] if grouped else ["rid", "item"]
    dtypes = {"qid": queries.schema["qid"].dataType, **{c: rows.schema[c].dataType for c in carry if c != "item"}}
    names = ["qid", *(["grp"] if grouped else []), "rid", "score"]
    arrow = {n: to_arrow_type(t) for n, t in dtypes.items()}
    arrow["score"] = pa.int64() if kernel.score_type == "bigint" else pa.float64()
    out_schema = pa.schema([(n, arrow[n]) for n in names])
    schema = ", ".join(f"{n} {dtypes[n].simpleString() if n in dtypes else kernel.score_type}" for n in names)
    n, width = queries.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("item")), F.lit(0))).first()
    blocks = int(max(1, -(-n // query_block_rows), -(-width // query_block_items)))

    def emit(best: dict, index: Any) -> pa.Table:
        ids = pa.array(index.qids, arrow["qid"])
        tables = []
        for g, (q, i, s) in best.items():
            cols = {"qid": ids.take(pa.array(q)), "rid": pa.array(i), "score": pa.array(s)}
            if grouped:
                cols["grp"] = pa.array([g] * len(q), arrow["grp"])
            tables.append(pa.table([cols[c].cast(arrow[c]) for c in names], schema=out_schema))
        return pa.concat_tables(tables) if tables else out_schema.empty_table()

    if blocks == 1:
        got = queries.collect()  # at most one block, counted above
        index = kernel([r["qid"] for r in got], [r["item"] for r in got], **(options or {}))
        shared = rows.sparkSession.sparkContext.broadcast(index)

        def scan_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix = shared.value
            if ix.qids:
                yield from emit(_scan_groups(batches, ix, k, min_score), ix).to_batches()

        partial = rows.select(*carry).mapInArrow(scan_partition, schema)
    else:
        m, held = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("item")), F.lit(0))).first()
        buckets = int(max(1, -(-m // bucket_rows), -(-held // bucket_items)))
        left = rows.select(
            *carry, F.pmod(F.xxhash64("rid"), F.lit(buckets)).alias("rb"),
            F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")).alias("qb"),
        )
        right = queries.select(
            "qid", "item", F.pmod(F.xxhash64("qid"), F.lit(blocks)).alias("qb"),
            F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)).cast("array<bigint>")).alias("rb"),
        )

        def meet(lt: pa.Table, rt: pa.Table) -> pa.Table:
            if not lt.num_rows or not rt.num_rows:
                return out_schema.empty_table()
            ix = kernel(rt["qid"].to_pylist(), rt["item"].to_pylist(), **(options or {}))
            return emit(_scan_groups(iter(lt.to_batches()), ix, k, min_score), ix)

        partial = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(meet, schema)

    w = Window.partitionBy("qid", *(["grp"] if grouped else [])).orderBy(F.col("score").desc(), "rid")
    return partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
