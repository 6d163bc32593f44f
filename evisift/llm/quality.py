"""Quality classifier by co-training (operator 8), after Blum and Mitchell (1998).

Two views of a document: its text content (a hashed histogram of byte trigrams and its evenness) and its page metadata (source, language,
recorded length and layout figures such as lines, their length and repetition, shares of character classes). Each view has
a logistic model. Over some rounds each model labels the unlabelled documents it is surest of, for the other one to
learn from. Both are then calibrated on labelled documents that neither has seen, and their log-odds are added to score
all documents.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, map_rows, modest_batches, slices, stored, table
from .registry import query

#: Documented bounds of the fit: labelled documents used (least hash of doc_id first), documents that a view labels in a round (the surest of all).
FIT_LABELLED, GIVEN = 6000, 300
#: Rounds, and the margin from which on a view is sure.
ROUNDS, SURE = 3, 1.0
#: Share of labelled documents kept for calibration.
CALIBRATE = 0.2
TEXT_BITS, HASHED_META, SMOOTH = 9, 32, 150
THRESHOLD = 0.5
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_KIND = np.zeros(256, np.int64)
for _c in range(256):
    _KIND[_c] = 0 if chr(_c).islower() and _c < 128 else 1 if chr(_c).isupper() and _c < 128 else 2 if 48 <= _c <= 57 else 3 if _c in (32, 9) else 4 if _c in (10, 13) else 5 if _c >= 128 else 6


def text_view(raw: bytes) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams (letters lower-cased) of the whole text, how many differ and how evenly.

    Shares are taken of the trigrams and SMOOTH more, so that a text of a few words says little either way.
    """
    out = np.zeros((1 << TEXT_BITS) + 2, np.float32)
    if not raw:
        return out
    counts = np.zeros(1 << TEXT_BITS, np.int64)
    for a in range(0, max(1, len(raw) - 2), 1 << 20):
        x = np.frombuffer(raw[a : a + (1 << 20) + 2].translate(_LOWER), np.uint8).astype(np.uint32)
        x = np.pad(x, (0, max(0, 3 - len(x))))
        gram = (x[:-2] * 65536 + x[1:-1] * 256 + x[2:]) * np.uint32(2654435761)
        counts += np.bincount(gram >> np.uint32(32 - TEXT_BITS), minlength=1 << TEXT_BITS)
    n = counts.sum()
    out[:-2] = np.sqrt(counts / (n + SMOOTH))
    # Against what evenly drawn trigrams would give: low for repetition of any length.
    cells = 1 << TEXT_BITS
    sure = n / (n + SMOOTH)
    out[-2] = 1 - sure * (1 - np.count_nonzero(counts) / (cells * -np.expm1(-n / cells)))
    out[-1] = 1 - sure * (1 - np.log(n * n / (counts.astype(np.float64) ** 2).sum()) / np.log(min(n, cells) + 1.0))
    return out


def meta_view(raw: bytes, source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """Hashed source and language, recorded length, layout figures."""
    out = np.zeros(HASHED_META + 16, np.float32)
    for name, value in (("source", source), ("lang", lang)):
        out[zlib.crc32(f"{name}={value}".encode()) % HASHED_META] += 1
    n = max(1, len(raw))
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=7) / n if raw else np.zeros(7)
    lines, words = raw.split(b"\n"), raw.split()
    w = max(1, len(words))
    pipes, marks = raw.count(b"|"), sum(raw.count(c) for c in b"!#$%&*")
    out[HASHED_META:] = [
        *kinds, np.log1p(max(0, n_chars or 0)) / 10, np.log1p(len(raw)) / 10, np.log1p(len(lines)) / 5, np.log1p(len(raw) / len(lines)) / 8,
        len(set(lines)) / len(lines), len(set(words)) / w, min(1, pipes / w), min(1, marks / w), min(1, n / w / 20),
    ]
    return out


@dataclass
class Logistic:
    """Logistic regression on standardised features, fitted by accelerated full-batch gradient steps (deterministic)."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, decay: float = 1e-3, steps: int = 300) -> Logistic:
        self.mean, self.scale = x.mean(0), 1 / (x.std(0) + 1e-3)
        z = x - self.mean.astype(np.float32)
        z *= self.scale.astype(np.float32)
        # Both classes weigh the same.
        share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())).astype(np.float32)
        # The step follows the largest curvature, found by power iteration.
        v, top = np.ones(z.shape[1], np.float32), 1.0
        for _ in range(40):
            v = z.T @ (share * (z @ v))
            top = float(np.linalg.norm(v)) or 1.0
            v /= top
        rate = 1 / (0.25 * (1.2 * top + 1) + decay)
        w, b = np.zeros(z.shape[1]), 0.0
        pw, pb, t = w, b, 1.0
        for _ in range(steps):
            s = (1 + (1 + 4 * t * t) ** 0.5) / 2
            vw, vb = w + (t - 1) / s * (w - pw), b + (t - 1) / s * (b - pb)
            g = share * (1 / (1 + np.exp(-np.clip(z @ vw.astype(np.float32) + vb, -30, 30))) - y)
            pw, pb, t = w, b, s
            w, b = vw - rate * (z.T @ g.astype(np.float32) + decay * vw), vb - rate * g.sum()
        self.weights, self.bias = w, float(b)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        return x @ (self.scale * self.weights) + (self.bias - float(self.mean @ (self.scale * self.weights)))


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (margin, label), with Platt's smoothed targets, by Newton steps."""
    pos, neg = float((y > 0).sum()), float((y <= 0).sum())
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0

    def loss(a: float, b: float) -> float:
        z = a * margin + b
        return float((np.logaddexp(0, z) - target * z).sum() + 5e-4 * (a - 1) ** 2)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([(margin * (p - target)).sum() + 1e-3 * (a - 1), (p - target).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(margin * margin * v).sum() + 1e-3, (margin * v).sum()], [(margin * v).sum(), v.sum() + 1e-6]])
        step, now = np.linalg.solve(h, g), loss(a, b)
        while loss(a - step[0], b - step[1]) > now and np.abs(step).max() > 1e-9:
            step /= 2
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(float(a), 0.0), float(b)


@dataclass
class CoTrained:
    views: list[Logistic]
    curves: list[tuple[float, float]]
    prior: float

    def odds(self, view: int, x: np.ndarray) -> np.ndarray:
        if not len(self.views[view].weights):
            return np.zeros(len(x))
        a, b = self.curves[view]
        return np.clip(a * self.views[view].margin(x) + b, -20, 20)

    def score(self, xs: list[np.ndarray]) -> np.ndarray:
        """Probability by both views: calibrated log-odds are added, the prior counts once."""
        return 1 / (1 + np.exp(-(self.odds(0, xs[0]) + self.odds(1, xs[1]) - self.prior)))


#: ``choose(models, share of good)``: what each of the two models labels next, as both views of the documents and their labels.
Choose = Callable[[list[Logistic], float], list[tuple[list[np.ndarray], np.ndarray]]]


def co_train_with(labelled: list[np.ndarray], y: np.ndarray, choose: Choose, rounds: int = ROUNDS) -> CoTrained:
    """Models from two views (rows in the same order) of labelled documents, and of those that ``choose`` finds in each round.

    The last CALIBRATE of the labelled ones calibrate. Without labels there is nothing to reject by: every document scores 0.5.
    """
    if not len(y):
        return CoTrained([Logistic(), Logistic()], [(0.0, 0.0)] * 2, 0.0)
    held = int(len(y) * CALIBRATE)
    fit = len(y) - held
    sets = [(labelled[v][:fit], y[:fit]) for v in (0, 1)]
    views = [Logistic().fit(*sets[v]) for v in (0, 1)]
    for _ in range(rounds):
        given = choose(views, float(np.mean(sets[0][1] > 0)))
        for v in (0, 1):
            xs, labels = given[1 - v]
            sets[v] = np.concatenate([sets[v][0], xs[v]]), np.concatenate([sets[v][1], labels])
        views = [Logistic().fit(*sets[v]) for v in (0, 1)]
    own = slice(fit, None) if held else slice(None)
    curves = [calibrate(views[v].margin(labelled[v][own]), y[own]) for v in (0, 1)]
    share_good = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    return CoTrained(views, curves, float(np.log(share_good / (1 - share_good))))


def co_train(labelled: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], rounds: int = ROUNDS, share: float = 0.05) -> CoTrained:
    """Co-training with the unlabelled documents in memory: each view labels ``share`` of ``pool`` in a round."""
    free = np.ones(len(pool[0]), bool)

    def choose(views: list[Logistic], rate: float) -> list[tuple[list[np.ndarray], np.ndarray]]:
        out, used = [], []
        n = int(len(pool[0]) * share)
        up, down = round(n * rate), n - round(n * rate)
        for v in (0, 1):
            m = views[v].margin(pool[v])
            rank = [i for i in np.argsort(-m, kind="stable") if free[i]]
            top = [i for i in rank[:up] if m[i] > SURE]
            low = [i for i in rank[::-1][:down] if m[i] < -SURE]
            rows = np.array(top + low, int)
            out.append(([x[rows] for x in pool], np.array([1.0] * len(top) + [0.0] * len(low))))
            used.append(rows)
        free[np.concatenate(used)] = False
        return out

    return co_train_with(labelled, y, choose, rounds)


def _views(batch: pa.RecordBatch, text: str, source: str, lang: str, n_chars: str) -> list[np.ndarray]:
    raws = [x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()]
    meta = zip(raws, *(batch.column(c).to_pylist() for c in (source, lang, n_chars)), strict=True)
    return [np.stack([text_view(r) for r in raws]), np.stack([meta_view(*m) for m in meta])]


COLUMNS = ("text", "source", "lang", "n_chars")


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, a, b), stored: both views of the whole text of every row with a doc_id, about 1 KB each before compression."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                a, b = _views(piece, *COLUMNS)
                views = (pa.array([r.tobytes() for r in x], pa.binary()) for x in (a.astype(np.float16), b.astype(np.float32)))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *views], names=["doc_id", "a", "b"])

    rows = docs.where("doc_id is not null").select("doc_id", *COLUMNS)
    modest_batches(docs.sparkSession)
    return stored(rows.mapInArrow(run, T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("a binary, b binary")])), "features")


def _arrays(table: pa.Table | pa.RecordBatch) -> list[np.ndarray]:
    """The two views of the rows of ``table``."""
    out = []
    for c, kind, width in (("a", np.float16, (1 << TEXT_BITS) + 2), ("b", np.float32, HASHED_META + 16)):
        out.append(np.frombuffer(b"".join(x.as_py() for x in table.column(c)), kind).reshape(-1, width).astype(np.float32))
    return out


def surest(made: DataFrame, skipped: DataFrame, views: list[Logistic], rate: float, given: int) -> DataFrame:
    """(doc_id, view, y): what each view is surest of among all rows of ``made`` whose doc_id is not in ``skipped``.

    Every row is scored in place, and only ids and two rounded margins travel. Rows alike in both margins, such as copies of a
    text, count once (least hash of doc_id). A view labels at most ``given`` documents, good ones by their share ``rate``,
    with a margin beyond SURE; ties go to the least hash.
    """
    sent = made.sparkSession.sparkContext.broadcast(views)  # a few KB

    def margins(batches):
        for b in batches:
            ms = [np.round(m.margin(x).astype(np.float64), 4) for m, x in zip(sent.value, _arrays(b), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, ms)], names=["doc_id", "m0", "m1"])

    scored = made.mapInArrow(margins, T.StructType([made.schema["doc_id"], *T.StructType.fromDDL("m0 double, m1 double")]))
    sure = scored.where(f"abs(m0) > {SURE} or abs(m1) > {SURE}").join(skipped, "doc_id", "left_anti")
    one = stored(sure.groupBy("m0", "m1").agg(F.min(F.struct(F.xxhash64("doc_id").alias("h"), "doc_id")).alias("r")).select("m0", "m1", "r.h", "r.doc_id"), "margins")
    up = round(given * rate)
    out = None
    for v in (0, 1):
        for label, n, order in ((1, up, F.desc(f"m{v}")), (0, given - up, F.asc(f"m{v}"))):
            side = one.where(f"m{v} > {SURE}" if label else f"m{v} < -{SURE}").orderBy(order, "h").limit(n)
            side = side.select("doc_id", F.lit(v).alias("view"), F.lit(label).alias("y"))
            out = side if out is None else out.unionByName(side)
    return stored(out, "surest")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", labelled: int = FIT_LABELLED, unlabelled: int = GIVEN, rounds: int = ROUNDS) -> CoTrained:
    """Models from at most ``labelled`` labelled documents (least hash of doc_id) and, in each round, the ``unlabelled`` ones that each view is surest of.

    The unlabelled documents are all others: Spark scores every one of them in each round. Labels that are null, other than 0 or
    1, or contradict each other for one doc_id are left out. The driver gets the two views of the documents chosen (about 1 KB each).
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("_y")).where("y = _y").drop("_y")
    chosen = stored(known.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id")).limit(labelled), "sample")
    made = features(docs)

    def views_of(ids: DataFrame) -> pa.Table:
        """Rows (doc_id, a, b) and the columns of ``ids``, a bounded table; one for each id, so that a repeated doc_id does not pass the bound."""
        rest = [c for c in ids.columns if c != "doc_id"]
        rows = made.join(F.broadcast(ids), "doc_id").groupBy("doc_id", *rest).agg(F.min(F.struct("a", "b")).alias("r"))
        return rows.select("doc_id", *rest, "r.*").orderBy(F.xxhash64("doc_id"), "doc_id", *rest).toArrow()

    rows = views_of(chosen)
    y = rows.column("y").to_numpy().astype(float)
    skipped = [labels.select("doc_id")]

    def choose(views: list[Logistic], rate: float) -> list[tuple[list[np.ndarray], np.ndarray]]:
        ids = surest(made, skipped[-1], views, rate, unlabelled)
        skipped.append(skipped[-1].unionByName(ids.select("doc_id")))
        got, out = views_of(ids), []
        for v in (0, 1):
            own = got.filter(pc.equal(got.column("view"), v))
            out.append((_arrays(own), own.column("y").to_numpy().astype(float)))
        return out

    model = co_train_with(_arrays(rows), y, choose, rounds)
    discard(made)
    return model


_READY: dict[str, CoTrained] = {}


def score(docs: DataFrame, model: CoTrained, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with p_text, p_meta (calibrated views), quality_score and keep, for every row; other columns pass through.

    Whole texts are read. Null and empty texts get the score of an empty text. Row-local: the models are a few KB.
    """
    key, sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> dict:
        if key not in _READY:
            _READY.clear()
            _READY[key] = sent.value
        m, xs = _READY[key], _views(batch, *COLUMNS)
        both = m.score(xs)
        sides = [1 / (1 + np.exp(-m.odds(v, xs[v]))) for v in (0, 1)]
        return {"p_text": pa.array(sides[0], pa.float64()), "p_meta": pa.array(sides[1], pa.float64()), "quality_score": pa.array(both, pa.float64()), "keep": pa.array(both >= threshold, pa.bool_())}

    return map_rows(docs, "text", [("p_text", T.DoubleType()), ("p_meta", T.DoubleType()), ("quality_score", T.DoubleType()), ("keep", T.BooleanType())], make)


@query("op8_co_training")
def op8_co_training(spark, sf_dir):
    """Quality score of every document from models co-trained on the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", *COLUMNS)
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).drop(*COLUMNS)
