"""Evaluation metrics and statistical tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chars import WORD
from ..functions.text import bind, squash, strip
from .ranking import running_total


def rank_metrics(hits: DataFrame, key: str, rank: str, is_gold: Column) -> DataFrame:
    """Rank of the first gold hit, reciprocal rank, hit@5 and hit@10."""
    h = hits.groupBy(key).agg(F.min(F.when(is_gold, F.col(rank))).alias("first_hit"))
    f = F.col("first_hit")
    return h.select(
        key, "first_hit", F.coalesce(F.round(1.0 / f, 6), F.lit(0.0)).alias("rr"),
        F.coalesce(f <= 5, F.lit(False)).cast("int").alias("hit5"),
        F.coalesce(f <= 10, F.lit(False)).cast("int").alias("hit10"),
    )


def order_statistic(df: DataFrame, keys: list[str], value: str, points: dict[str, Column]) -> DataFrame:
    """Exact values at 0-based ``index`` of the sorted group, without gathering the group.

    Distinct values are counted first, so a group travels as its histogram, and the
    running count is computed over range partitions (a crowded group is split).
    ``points`` maps a name to an index expression over ``n`` (the group size).
    """
    hist = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("m"))
    run = running_total(hist, keys, value, "m")
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    # Without keys the totals are a single row.
    j = run.join(total, keys) if keys else run.join(F.broadcast(total.withColumn("_k", F.lit(0))), F.lit(0) == F.col("_k"))
    picks = [F.min(F.when(F.col("upto") > idx, F.col(value))).alias(name) for name, idx in points.items()]
    return j.groupBy(*keys).agg(F.first("n").alias("n"), *picks)


def nearest_rank(p: float) -> Column:
    """A09 index: round((n - 1) p), half to even."""
    return F.bround((F.col("n") - 1) * p).cast("bigint")


def floor_rank(p: float) -> Column:
    """A08 index: int(p (n - 1))."""
    return F.floor((F.col("n") - 1) * p).cast("bigint")


# Fixed value: ASCII punctuation removed by the answer normalizer.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def normalize_strict(c: Column) -> Column:
    """E01 strict: every non-word run becomes one space (Unicode word characters stay)."""
    return strip(F.regexp_replace(F.lower(strip(c)), f"[^{WORD}]+", " "))


def normalize_squad(c: Column) -> Column:
    """E01 squad-style: ASCII punctuation is removed; articles stay."""
    return squash(F.translate(F.lower(c), PUNCTUATION, ""))


def exact_match(pred: Column, golds: Column) -> Column:
    """E02 over an array of golds."""
    p = normalize_strict(pred)
    return F.exists(golds, lambda g: normalize_strict(g) == p).cast("int")


# Paraphrases accepted for yes / no golds.
YES_PARAPHRASES = [
    "同国籍", "国籍一致", "相同的国籍", "都是美国", "都是美国人", "答案是肯定的", "因此答案是肯定",
    "same nationality", "both american", "both americans",
]
NO_PARAPHRASES = [
    "not in the same", "not the same", "are not in the same", "is not in the same", "not located in the same",
    "不位于同一", "不在同一个", "不是同一", "distinct", "different districts",
]


def relaxed_match(pred: Column, gold: Column) -> Column:
    """Equal, or contained; yes/no need a whole word or a paraphrase."""
    p, g = normalize_squad(pred), normalize_squad(gold)

    def word(rx: str) -> Column:
        return p.rlike(f"(?<![{WORD}])({rx})(?![{WORD}])")

    def any_of(frags: list[str]) -> Column:
        out = F.lit(False)
        for f in frags:
            out = out | F.contains(p, F.lit(f))
        return out

    return (
        F.when(g == "", F.lit(False))
        .when(p == g, F.lit(True))
        .when(g == "yes", word("yes|yeah") | any_of(YES_PARAPHRASES))
        .when(g == "no", word("no") | any_of(NO_PARAPHRASES))
        .otherwise(F.contains(p, g))
        .cast("int")
    )


def squad_tokens(c: Column) -> Column:
    t = normalize_squad(c)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Sum over distinct shared tokens of the smaller multiplicity, inside the row.

    Both token lists are sorted and merged once by a fold, so the cost is linear in
    their lengths even for very long answers.
    """
    tagged = F.array_sort(
        F.concat(
            F.transform(a, lambda t: F.struct(t.alias("t"), F.lit(0).alias("s"))),
            F.transform(b, lambda t: F.struct(t.alias("t"), F.lit(1).alias("s"))),
        )
    )
    zero = F.struct(F.lit(None).cast("string").alias("t"), F.lit(0).alias("left"), F.lit(0).alias("hit"))

    def step(acc: Column, x: Column) -> Column:
        same = acc["t"].eqNullSafe(x["t"])
        left = F.when(same, acc["left"]).otherwise(F.lit(0))
        use = (x["s"] == 1) & (left > 0)
        return F.struct(
            x["t"].alias("t"),
            F.when(x["s"] == 0, left + 1).when(use, left - 1).otherwise(left).alias("left"),
            F.when(use, acc["hit"] + 1).otherwise(acc["hit"]).alias("hit"),
        )

    return F.aggregate(tagged, zero, step, lambda acc: acc["hit"])


def token_f1(pred: Column, gold: Column) -> Column:
    """E04."""
    pair = F.struct(squad_tokens(pred).alias("p"), squad_tokens(gold).alias("g"))

    def score(b: Column) -> Column:
        n, m = F.size(b["p"]), F.size(b["g"])
        # 2PR/(P+R) with P = o/n and R = o/m
        return bind(multiset_overlap(b["p"], b["g"]), lambda o: F.when((n == 0) | (m == 0) | (o == 0), 0.0).otherwise(2 * o / (n + m)))

    return bind(pair, score)


def veracity_label(c: Column) -> Column:
    """The label whose first occurrence comes earliest, null if none occurs."""
    u = F.upper(c)
    # Labels in tie-breaking order.
    labels = ["NOT ENOUGH INFO", "REFUTES", "SUPPORTS"]
    at = [
        F.when(F.instr(u, lab) > 0, F.struct(F.instr(u, lab).alias("p"), F.lit(i).alias("i"), F.lit(lab).alias("lab")))
        for i, lab in enumerate(labels)
    ]
    return F.least(*at)["lab"]


def mc_proxy(choices: Column, sims: Column, labels: Column) -> Column:
    """(accuracy of the best option, mass on true options); the first maximum wins."""
    best = F.array_position(sims, F.array_max(sims)).cast("int")
    total = F.aggregate(sims, F.lit(0.0), lambda s, x: s + x)
    true = F.aggregate(F.zip_with(sims, labels, lambda s, y: F.when(y > 0, s).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    ok = (
        (F.size(choices) > 0) & (F.size(choices) == F.size(labels))
        & ~F.exists(choices, lambda c: strip(c) == "") & F.exists(labels, lambda y: y > 0)
    )
    return F.struct(
        F.when(ok, (F.get(labels, best - 1) > 0).cast("double")).otherwise(0.0).alias("acc"),
        F.when(ok & (total > 0), true / (total + 1e-8)).otherwise(0.0).alias("mass"),
        ok.cast("double").alias("valid"),
    )


def softmax_mass(logprobs: Column, labels: Column) -> Column:
    """(argmax label, softmax mass on true options) from per-option scores."""
    top = F.array_max(logprobs)
    ex = F.transform(logprobs, lambda x: F.exp(x - top))
    total = F.aggregate(ex, F.lit(0.0), lambda s, x: s + x)
    true = F.aggregate(F.zip_with(ex, labels, lambda e, y: F.when(y > 0, e).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    return F.struct(
        (F.get(labels, F.array_position(logprobs, top).cast("int") - 1) > 0).cast("int").alias("acc"),
        (true / total).alias("mass"),
    )


def pick_prediction(method: Column, raw: Column, grounded: Column, base: Column, injected: Column) -> Column:
    """Which text of a run is scored: graph runs by their raw decode, grounded graph runs by the filtered text."""
    def first(*cs: Column) -> Column:
        return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))

    return (
        F.when(method == "base", first(base))
        .when(method == "graph", first(raw, grounded))
        .when(method == "graph_grounded", first(grounded, raw))
        .when(method == "text", first(grounded, base))
        .when(method == "prefix", first(injected))
        .otherwise("")
    )


def answer_quality(c: Column) -> Column:
    """Length band, markup penalties, reward for words."""
    return bind(strip(c), _quality)


def _quality(t: Column) -> Column:
    n = F.length(t)
    words = F.regexp_count(t, F.lit("[A-Za-z]{2,}"))
    cjk = F.regexp_count(t, F.lit(r"[\x{4e00}-\x{9fff}]"))
    score = (
        F.when(n.between(24, 180), 30).when(n.between(12, 240), 15).otherwise(-10)
        + F.when(t.rlike(r"!\[[^\]]*\]\([^)]*\)"), -60).otherwise(0)
        + F.when(t.rlike("(?i)https?://"), -40).otherwise(0)
        + F.when(t.rlike("!{2,}|`{2,}"), -20).otherwise(0)
        + F.least(F.lit(25), words * 2 + F.floor(cjk / 4).cast("int"))
    )
    return F.when(F.coalesce(t, F.lit("")) == "", -10000).otherwise(score)


def best_candidate(cands: Column) -> Column:
    """Highest quality, first wins ties; blanks do not compete."""
    # A blank has the quality -10000, which nothing else gets: each candidate is stripped once.
    scored = F.transform(cands, lambda c, i: F.struct((-answer_quality(c)).alias("neg"), i.alias("i"), c.alias("c")))
    return F.array_min(F.filter(scored, lambda x: x["neg"] < 10000))["c"]


def bootstrap_ci(df: DataFrame, key: str, value: str, n_boot: int = 1000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean of 0/1 outcomes, per ``key``.

    Resampling n outcomes with s successes only needs the number of successes drawn,
    a Binomial(n, s/n); each resample is therefore one draw per (key, round) from the
    group's two counts. No outcome row is replicated, whatever the group size.
    """
    stats = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"))

    def draw(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                rng = np.random.default_rng([seed, int(r.n), int(r.s)])
                vals = np.sort(100.0 * rng.binomial(int(r.n), r.s / r.n, size=n_boot) / r.n)
                lo = vals[max(0, int(alpha / 2 * n_boot) - 1)]
                hi = vals[min(n_boot - 1, int((1 - alpha / 2) * n_boot) - 1)]
                rows.append((r[0], int(r.n), 100.0 * r.s / r.n, float(lo), float(hi)))
            yield pd.DataFrame(rows, columns=[key, "n", "mean", "lo", "hi"])

    kt = df.schema[key].dataType.simpleString()
    return stats.select(key, "n", "s").mapInPandas(draw, f"{key} {kt}, n bigint, mean double, lo double, hi double")


def poisson_cuts(top: int = 12) -> list[int]:
    """Bounds of a 32-bit number above which a Poisson(1) weight is at least 1, 2, ... ``top``."""
    import math

    below = [math.exp(-1) * sum(1 / math.factorial(i) for i in range(j + 1)) for j in range(top)]
    return [math.floor(p * 2**32) for p in below]


def poisson_weights(high, low, rounds, seed: int):
    """Weight of each row (64 bits of a key as two 32-bit arrays) in each round: a matrix of rows and rounds."""
    import numpy as np

    mask = np.uint64(0xFFFFFFFF)
    x = high[:, None] ^ ((rounds[None, :] * np.uint64(2654435769) + np.uint64(seed)) & mask)
    for word in (low[:, None], np.uint64(0)):
        x = (x ^ (x >> np.uint64(16))) * np.uint64(2146121005) & mask
        x = (x ^ (x >> np.uint64(15))) * np.uint64(2221713035) & mask
        x = x ^ (x >> np.uint64(16)) ^ word
    return np.searchsorted(np.array(poisson_cuts(), dtype=np.uint64), x, side="right")


def poisson_intervals(df: DataFrame, key: str, row_id: Column, values: list[str], n_boot: int = 1000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Mean and percentile interval of real-valued scores per ``key``, by a Poisson bootstrap.

    In round b a row weighs Poisson(1), drawn from a hash of (row, round): a rerun or a lost task draws the same. Rows of one
    ``row_id`` weigh alike under every key, so methods are resampled in pairs. Every task adds up all rounds of its rows
    (round 0: the plain sums) and only those sums are shuffled; no row is replicated. A null value has no part in its own mean;
    a round that draws no row of a key is left out.
    Columns: ``key, n``, and for each value ``v``: ``v_mean, v_lo, v_hi``. Null keys form a group.
    """
    kt = df.schema[key].dataType.simpleString()
    digest = F.md5(row_id.cast("string"))
    words = [F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint").alias(n) for n, at in (("_a", 1), ("_c", 9))]
    data = df.select(F.col(key).alias("_k"), *words, F.array(*[F.col(v).cast("double") for v in values]).alias("_x"))

    def add_up(batches):
        import numpy as np
        import pandas as pd

        rounds = np.arange(1, n_boot + 1, dtype=np.uint64)
        sums: dict = {}

        def flush():
            out = pd.DataFrame([(k, s[0].tolist(), s[1].tolist()) for k, s in sums.items()], columns=["k", "w", "s"])
            sums.clear()
            return out

        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                part = pdf.iloc[at : at + 1024]
                w = poisson_weights(part["_a"].to_numpy(np.uint64), part["_c"].to_numpy(np.uint64), rounds, seed)
                w = np.concatenate([np.ones((len(part), 1)), w], axis=1)
                x = np.array([list(r) for r in part["_x"]], dtype=np.float64)
                there = ~np.isnan(x)
                codes, keys = pd.factorize(part["_k"], use_na_sentinel=False)
                for c, k in enumerate(keys):
                    at_k = codes == c
                    k = None if pd.isna(k) else k
                    got = np.stack([there[at_k].T.astype(np.float64) @ w[at_k], np.nan_to_num(x[at_k]).T @ w[at_k]]).reshape(2, -1)
                    sums[k] = got if k not in sums else sums[k] + got
                if len(sums) > 256:
                    yield flush()
        if sums:
            yield flush()

    drawn = data.mapInPandas(add_up, f"k {kt}, w array<double>, s array<double>")
    cells = drawn.select("k", F.posexplode(F.arrays_zip("w", "s")).alias("i", "z")).groupBy("k", "i").agg(F.sum("z.w").alias("w"), F.sum("z.s").alias("s"))
    width = n_boot + 1
    stat = F.when(F.col("w") > 0, F.col("s") / F.col("w"))
    drawn_at = F.floor(F.col("i") / width).cast("int")
    plain, size = F.col("i") % width == 0, F.size("l")
    per = cells.groupBy("k", drawn_at.alias("v")).agg(
        F.max(F.when(plain, stat)).alias("mean"), F.array_sort(F.collect_list(F.when(~plain, stat))).alias("l")
    )
    lo, hi = F.get("l", F.greatest(F.lit(0), F.floor(size * (alpha / 2)).cast("int") - 1)), F.get("l", F.greatest(F.lit(0), F.floor(size * (1 - alpha / 2)).cast("int") - 1))
    box = per.select("k", "v", F.struct("mean", lo.alias("lo"), hi.alias("hi")).alias("b"))
    wide = box.groupBy("k").agg(*[F.max(F.when(F.col("v") == i, F.col("b"))).alias(f"_{i}") for i in range(len(values))])
    counts = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    cols = [F.col(f"_{i}.{f}").alias(f"{v}_{f}") for i, v in enumerate(values) for f in ("mean", "lo", "hi")]
    return counts.join(wide, F.col("_key").eqNullSafe(F.col("k"))).select(F.col("_key").alias(key), "n", *cols)


def paired_permutation(df: DataFrame, key: str, diff: str, n_perm: int = 2000, seed: int = 42) -> DataFrame:
    """Two-sided p-value with add-one smoothing, per ``key``.

    Flipping signs only needs how many pairs differ by each amount: the number of flips among m equal differences is
    Binomial(m, 1/2). Every cell (key, amount) draws for itself, seeded by its amount; tasks add up their cells' totals,
    one row of ``n_perm`` numbers for each key, and those are summed. No task holds a whole group, real-valued or not.
    """
    kt = df.schema[key].dataType.simpleString()
    cells = df.where(F.col(diff) != 0).groupBy(key, F.abs(diff).cast("double").alias("size")).agg(F.count(F.lit(1)).alias("m"), F.sum(diff).alias("sum"))

    def draw(batches):
        import struct

        import numpy as np
        import pandas as pd

        totals = {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                rng = np.random.default_rng([seed, int.from_bytes(struct.pack(">d", r.size), "big"), int(r.m)])
                totals[r[0]] = totals.get(r[0], 0) + r.size * (2 * rng.binomial(int(r.m), 0.5, size=n_perm) - int(r.m))
        if totals:
            yield pd.DataFrame({key: list(totals), "t": list(totals.values())})

    drawn = cells.select(key, "size", "m").mapInPandas(draw, f"{key} {kt}, t array<double>")
    total = drawn.select(key, F.posexplode("t").alias("i", "x")).groupBy(key, "i").agg(F.sum("x").alias("x"))
    seen = cells.groupBy(key).agg(F.abs(F.sum("sum").cast("double")).alias("obs"))
    extreme = total.join(seen, key).where(F.abs("x") >= F.col("obs") - 1e-9).groupBy(key).agg(F.count(F.lit(1)).alias("ge"))
    base = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(seen, key, "left").join(extreme, key, "left")
    ge = F.when(F.col("obs").isNull(), F.lit(n_perm)).otherwise(F.coalesce("ge", F.lit(0)))
    return base.select(key, "n", ((ge + 1) / F.lit(n_perm + 1)).alias("p_value"))


def accuracy_panel(df: DataFrame, keys: list[str], outcome: str, z: float = 1.96) -> DataFrame:
    """Accuracy of 0/1 outcomes with a normal interval, one partial aggregate for each group."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(outcome).alias("_p"))
    half = F.sqrt(F.col("_p") * (1 - F.col("_p")) / F.col("n")) * z
    return g.select(
        *keys, "n", F.round("_p", 6).alias("accuracy"), F.round(F.greatest(F.lit(0.0), F.col("_p") - half), 6).alias("lo"), F.round(F.least(F.lit(1.0), F.col("_p") + half), 6).alias("hi")
    )


def candidate_trace(pool: DataFrame, key: str, rank: str, is_target: Column, final: int) -> DataFrame:
    """Q24: whether a target is in the pool and among its first ``final``, its first rank, and the pool's size."""
    at = F.min(F.when(is_target, F.col(rank)))
    return pool.groupBy(key).agg(at.isNotNull().alias("in_pool"), F.coalesce(at <= final, F.lit(False)).alias("in_final"), at.alias("first_rank"), F.count(F.lit(1)).alias("pool_size"))
