"""Sequential selections that no window frame can express, as per-row folds.

Each fold runs over one query's ranked candidates, which an earlier top-k has bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sentences import split_claims
from ..functions.text import strip, token_len_fallback


def split_claim_to_budget(c: Column, max_tokens: int, max_chunks: int | None = None) -> Column:
    """struct(chunks, was_split, was_truncated); all chunks unless ``max_chunks`` is given."""
    t = strip(c)
    parts = split_claims(t)
    parts = F.when(F.size(parts) <= 1, F.array(t)).otherwise(parts)
    mark = "\x1e"

    def clauses(p: Column) -> Column:
        subs = F.filter(F.transform(F.split(F.regexp_replace(p, r"([,，;；、])\s*", f"$1{mark}"), mark), strip), lambda x: x != "")
        fine = F.when(F.size(subs) > 0, subs).otherwise(F.array(p))
        return F.when(token_len_fallback(p) <= max_tokens, F.array(p)).otherwise(fine)

    fine = F.flatten(F.transform(parts, clauses))
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))

    def pack(acc: Column, seg: Column) -> Column:
        cand = strip(F.concat(acc["buf"], F.lit(" "), seg))
        return (
            F.when(acc["buf"] == "", F.struct(acc["out"].alias("out"), seg.alias("buf")))
            .when(token_len_fallback(cand) <= max_tokens, F.struct(acc["out"].alias("out"), cand.alias("buf")))
            .otherwise(F.struct(F.array_append(acc["out"], acc["buf"]).alias("out"), seg.alias("buf")))
        )

    packed = F.aggregate(fine, zero, pack, lambda a: F.when(a["buf"] != "", F.array_append(a["out"], a["buf"])).otherwise(a["out"]))
    short = token_len_fallback(t) <= max_tokens

    def result(ch: Column) -> Column:
        cut = F.lit(False) if max_chunks is None else F.size(ch) > max_chunks
        over = cut | ((F.size(ch) == 1) & (token_len_fallback(F.get(ch, 0)) > max_tokens))
        return F.struct((ch if max_chunks is None else F.slice(ch, 1, max_chunks)).alias("chunks"), F.lit(True).alias("was_split"), over.alias("was_truncated"))

    one = F.struct(F.array(t).alias("chunks"), F.lit(False).alias("was_split"), F.lit(False).alias("was_truncated"))
    none = F.struct(F.array().cast("array<string>").alias("chunks"), F.lit(False).alias("was_split"), F.lit(False).alias("was_truncated"))
    # Bind the packed list once: a one-element transform keeps the fold from being repeated.
    long = F.get(F.transform(F.array(packed), result), 0)
    return F.when(t == "", none).when(short, one).otherwise(long)


def list_projection(ranked: DataFrame, key: str, rank: str, block: str, items: str, per_block: int = 4) -> DataFrame:
    """Ranked blocks' items, at most ``per_block`` kept per block and max(8, 4n) in all.

    Only kept items count against the block; items beyond the cap are not marked as
    seen, so a later block may still emit them. ``ranked`` holds one row per block.
    """
    per = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(rank, block, items))).alias("bs"))
    bt = ranked.schema[block].dataType.simpleString()
    zero = F.struct(
        F.array().cast("array<string>").alias("seen"), F.array().cast(f"array<struct<item:string,block:{bt}>>").alias("out"), F.lit(0).alias("kept")
    )
    total = F.greatest(F.lit(8), F.size("bs") * 4)

    def one(acc: Column, it: Column, b: Column) -> Column:
        low = F.lower(it)
        full = (acc["kept"] >= per_block) | (F.size(acc["out"]) >= total)
        skip = full | (it == "") | F.array_contains(acc["seen"], low)
        return F.when(skip, acc).otherwise(
            F.struct(
                F.array_append(acc["seen"], low).alias("seen"),
                F.array_append(acc["out"], F.struct(it.alias("item"), b.alias("block"))).alias("out"), (acc["kept"] + 1).alias("kept"),
            )
        )

    def step(acc: Column, b: Column) -> Column:
        fresh = F.struct(acc["seen"].alias("seen"), acc["out"].alias("out"), F.lit(0).alias("kept"))
        return F.aggregate(F.transform(b[items], strip), fresh, lambda a, it: one(a, it, b[block]))

    out = per.select(key, F.posexplode(F.aggregate("bs", zero, step, lambda a: a["out"])).alias("pos", "x"))
    return out.select(key, "pos", F.col("x.item").alias("item"), F.col("x.block").alias("block"))


def budgeted_selection(
    cands: DataFrame, key: str, order: list[str], item: str, cost: str, budget: int, max_cost: int, max_items: int = 4
) -> DataFrame:
    """Q28: take candidates in order while they fit; one that does not fit is skipped, not a stop.

    ``order`` columns sort ascending; costs are clamped to [0, max_cost], null counts as max_cost. Of candidates of equal
    cost only the first ``max_items`` can ever be taken (what does not fit once never fits later), so each key folds over at
    most (max_cost + 1) x max_items rows, cut before the shuffle, however many candidates it has.
    """
    clamped = F.greatest(F.lit(0), F.least(F.lit(max_cost), F.coalesce(F.col(cost).cast("int"), F.lit(max_cost))))
    it = cands.schema[item].dataType.simpleString()
    rows = cands.select(key, *dict.fromkeys([*order, item]), clamped.alias("_cost"))
    first = Window.partitionBy(key, "_cost").orderBy(*order, item)
    rows = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= max_items)
    per = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(item).alias("_item"), "_cost"))).alias("cs"))
    zero = F.struct(F.lit(0).alias("used"), F.array().cast(f"array<struct<item:{it},cost:int>>").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        fits = (acc["used"] + c["_cost"] <= budget) & (F.size(acc["out"]) < max_items)
        return F.when(
            fits,
            F.struct((acc["used"] + c["_cost"]).alias("used"), F.array_append(acc["out"], F.struct(c["_item"].alias("item"), c["_cost"].alias("cost"))).alias("out")),
        ).otherwise(acc)

    out = per.select(key, F.posexplode(F.aggregate("cs", zero, step, lambda a: a["out"])).alias("pos", "x"))
    return out.select(key, "pos", F.col("x.item").alias(item), F.col("x.cost").alias("cost"))
