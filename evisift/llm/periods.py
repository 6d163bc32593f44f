"""Periodic runs of words by seeds on diagonals (operator 13).

A run of period q has its words equal q apart over at least max(shortest - q, (times - 1) q) places, so two occurrences of a k-gram, k the
least of these numbers, lie q apart in it. Such pairs are the seeds; a seed is extended both ways along its diagonal (its lag q)
until words differ, and for each lag seeds before the furthest place covered are passed over.

To seed without all pairs of occurrences, lags are taken in classes that double: lags up to k with k-grams, lags from k to 2k with
2k-grams (guaranteed as (times - 1) q > 2k there), and so on. With grams at least as long as the lag, the next occurrence of a gram
inside a run is exactly one period away (otherwise the period would have a shorter one), so next occurrences suffice, and
conversely a next occurrence at lag q starts a stretch with smallest period q. Grams get exact numbers by doubling, and only
places whose gram occurs again in the same document stay for the next class; work is n log n at most, whatever the text repeats.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, raw_texts, table
from .registry import query

SHORTEST, TIMES = 24, 3
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def guaranteed(shortest: int, times: int) -> int:
    """The least overlap with itself, one period on, of any run."""
    return min(max(shortest - q, (times - 1) * q) for q in range(1, shortest + 1))


def _same(x: np.ndarray, i: int, lag: int, step: int) -> int:
    """How many places from ``i`` on (back for step -1) hold words equal to those ``lag`` on."""
    room = len(x) - lag - i if step > 0 else i + 1
    done, size = 0, 16
    while done < room:
        n = min(size, room - done)
        a = i + done if step > 0 else i - done - n + 1
        differ = np.flatnonzero(x[a : a + n] != x[a + lag : a + lag + n])
        if len(differ):
            return done + int(differ[0] if step > 0 else n - 1 - differ[-1])
        done, size = done + n, size * 4
    return done


def find_runs(docs: list[np.ndarray], shortest: int = SHORTEST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each document, given as word numbers, by start and period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    sizes = np.array([len(d) for d in docs])
    if not sizes.sum():
        return found
    first = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(docs)), sizes)
    words = np.concatenate(docs).astype(np.int64)
    # Numbers that differ between documents: no gram and no extension crosses a border.
    _, x = np.unique(of * (words.max() + 1) + words, return_inverse=True)
    ends = (first + sizes)[of]
    numbers, places, length = x.astype(np.int64), np.arange(len(x)), 1
    k, low = guaranteed(shortest, times), 0
    while True:
        while length < k:
            longer = min(2 * length, k)
            at = places[places + longer <= ends[places]]
            pair = numbers[at + longer - length]
            at, pair = at[pair >= 0], pair[pair >= 0]
            _, new, count = np.unique(numbers[at] * (len(x) + 1) + pair, return_inverse=True, return_counts=True)
            again = count[new] > 1
            places, new, length = at[again], new[again], longer
            numbers = np.full(len(x), -1, np.int64)
            numbers[places] = new
        if not len(places):
            break
        order = np.argsort(numbers[places], kind="stable")
        a, b = places[order][:-1], places[order][1:]
        lag = b - a
        seed = (numbers[a] == numbers[b]) & (lag > low) & (lag <= k)
        a, lag = a[seed], lag[seed]
        order = np.lexsort((a, lag))
        a, lag = a[order], lag[order]
        starts = np.flatnonzero(np.diff(lag, prepend=-1))
        for q, seeds in zip(lag[starts].tolist(), np.split(a, starts[1:]), strict=True) if len(lag) else ():
            covered = at = 0
            while at < len(seeds):
                i = int(seeds[at])
                start = i - _same(x, i - 1, q, -1)
                covered = i + k + _same(x, i + k, q, 1)
                if covered - start + q >= max(shortest, times * q):
                    d = int(of[i])
                    found[d].append((start - int(first[d]), covered - start + q, q))
                at = int(np.searchsorted(seeds, covered))
        k, low = 2 * k, k
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def periodic_runs(df: DataFrame, text: str = "text", shortest: int = SHORTEST, times: int = TIMES, edit: Callable[[list[bytes], object], list[bytes]] | None = None, key: str | None = None) -> DataFrame:
    """``df`` with runs (array of start, length, period by start and period) and collapsed (the kept words, joined by one space).

    Words are what ASCII white space separates. A run is a stretch of consecutive words with smallest period q and at least
    ``shortest`` words and ``times`` (3 or more) periods, which no neighbouring word extends. Kept are words that no run holds after its
    first period. ``edit(words, value of key)`` may change a text's words first. Row-local: whole texts, any length. Null,
    empty and blank texts have no run and collapse to an empty text; repeated rows stay; an empty input gives an empty result.
    Columns named runs or collapsed are replaced.
    """
    if times < 3 or shortest < 1:
        raise ValueError("runs of at least three periods and one word")

    def make(batch: pa.RecordBatch) -> dict:
        texts = [t.split() for t in raw_texts(batch, text)]
        if edit is not None:
            texts = [edit(w, v) for w, v in zip(texts, batch.column(key).to_pylist(), strict=True)]
        numbers: dict[bytes, int] = {}
        docs = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)) for words in texts]
        found = find_runs(docs, shortest, times)
        out = []
        for words, runs in zip(texts, found, strict=True):
            if runs:
                words = [words[i] for i in np.flatnonzero(kept_words(len(words), runs)).tolist()]
            out.append(b" ".join(words))
        rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs in found]
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
        return {"runs": pa.array(rows, kind), "collapsed": pa.array(out, pa.binary()).cast(pa.string())}

    return map_rows(df, text, [("runs", T.ArrayType(RUN)), ("collapsed", T.StringType())], make)


def echoed(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Every tenth document by checksum of its id repeats a stretch of itself to its end; null ids do not."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


@query("op13_periodic_runs")
def op13_periodic_runs(spark, sf_dir):
    """Runs of every document: their number, the one of greatest exponent, and digests of all runs and of the collapsed text."""
    out = periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), edit=echoed, key="doc_id")
    none = F.lit(None).cast(RUN)
    # Runs come by start and period, so only a greater exponent replaces the best so far; products keep the comparison exact.
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | (r.length * b.period > b.length * r.period), r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n"))), "")
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("(1000 * b.length) div b.period").alias("exponent_milli")
    return out.select("doc_id", "n_runs", "b.start", "b.length", "b.period", milli, "runs_sha256", "collapsed_sha256")
