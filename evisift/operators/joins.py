"""Lookups that are joins (J04-J23, U03, U08); where keys repeat, the first or the last row wins, as each function says.

Containment is never a nested loop: a text offers its runs of a few characters, or its tokens, and meets the
dictionary by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rows import explode_rows
from ..functions.text import bind, squash, strip
from ..session import BROADCAST_LIMIT_BYTES, broadcast_if_small, cut_lineage


#: Characters of the grams that anchor a term, and the terms of one anchor from which on a second gram tells them apart.
GRAM, SPLIT = 8, 16

#: Characters up to which a text is cut at each place.
SHORT = 256

#: Bytes of a broadcast anchor besides its key, with the tables of the hash.
ROW_BYTES = 320

#: Rows up to which slots are looked up in a map.
MAP_ROWS = 1000


def _places(c: Column, lengths: list[int]) -> Column:
    """(p, gram) of every run of each length in ``lengths``, p from 0 in code points; linear in the text.

    Short texts are cut at each place, which costs less there than growing the runs by a character at a time.
    """

    def of(chars: Column) -> Column:
        n = F.size(chars)

        def longer(grams: Column, k: int, made: list[Column]) -> Column:
            if k in lengths:
                whole = F.slice(grams, F.lit(1), F.greatest(n - (k - 1), F.lit(0)))
                made = [*made, F.transform(whole, lambda g, i: F.struct(i.alias("p"), g.alias("gram")))]
            if k == lengths[-1]:
                return F.flatten(F.array(*made))
            return bind(F.zip_with(grams, F.slice(chars, F.lit(k + 1), n), lambda a, b: F.concat(a, b)), lambda g: longer(g, k + 1, made))

        return longer(chars, 1, [])

    def cut(k: int) -> Column:
        starts = F.sequence(F.lit(0), F.length(c) - k)
        runs = F.transform(starts, lambda p: F.struct(p.alias("p"), F.substring(c, p + 1, F.lit(k)).alias("gram")))
        return F.when(F.length(c) >= k, runs).otherwise(F.array().cast("array<struct<p:int,gram:string>>"))

    grown = bind(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), of)
    return F.when(F.length(c) <= SHORT, F.flatten(F.array(*[cut(k) for k in lengths]))).otherwise(grown)


def _key_places(keys: DataFrame, *carry: str) -> DataFrame:
    """(key, off, gram, carry) of every gram of GRAM characters of a key; a shorter key is its own gram."""
    own = F.array(F.struct(F.lit(0).alias("p"), F.col("key").alias("gram")))
    at = F.when(F.length("key") < GRAM, own).otherwise(_places(F.col("key"), [GRAM]))
    return explode_rows(keys, ["key", *carry], at, "g").select("key", *carry, F.col("g.p").alias("off2"), F.col("g.gram").alias("gram2"))


def anchors(keys: DataFrame) -> DataFrame:
    """(key, gram, off, gap, gram2) of distinct ``keys(key)``: each at the gram that fewest keys have, the last such one.

    Names of a family share their head; what tells them apart is rare, so it anchors them. Where more than SPLIT keys
    are left at one gram, each gets the gram (and its distance) that is rarest among those keys as well; it is null for the others.
    Exploded grams are many times what Spark's estimate says, so their joins are sorted: a broadcast would pass them through the driver.
    """
    places = _key_places(keys)
    rare = places.groupBy("gram2").agg(F.count("*").alias("n"))
    best = lambda: F.min(F.struct("n", (-F.col("off2")).alias("back"), "gram2")).alias("b")
    first = places.join(rare.hint("merge"), "gram2").groupBy("key").agg(best()).select("key", F.col("b.gram2").alias("gram"), (-F.col("b.back")).alias("off"))
    first = cut_lineage(first)
    hot = first.groupBy("gram").count().where(F.col("count") > SPLIT).select("gram")
    if hot.isEmpty():
        return first.select("key", "gram", "off", F.lit(None).cast("int").alias("gap"), F.lit(None).cast("string").alias("gram2"))
    crowded = first.join(hot, "gram", "left_semi")
    others = _key_places(crowded, "gram", "off").where("off2 <> off").withColumn("gap", F.col("off2") - F.col("off"))
    kinds = others.groupBy("gram", "gap", "gram2").agg(F.count("*").alias("n"))
    second = others.join(kinds.hint("merge"), ["gram", "gap", "gram2"]).groupBy("key").agg(F.min(F.struct("n", (-F.col("off2")).alias("back"), "gram2", "gap")).alias("b"))
    return cut_lineage(first.join(second.select("key", "b.gap", "b.gram2"), "key", "left").select("key", "gram", "off", "gap", "gram2"))


def anchored(texts: DataFrame, at: DataFrame) -> DataFrame:
    """(qid, p, key): places of ``texts(qid, t)`` where a key of ``anchors`` may start, because its anchor is there."""
    lengths = sorted(r[0] for r in at.select(F.length("gram").alias("n")).distinct().collect())  # GRAM values at most
    if not lengths:
        return texts.select("qid", F.lit(0).alias("p"), F.lit("").alias("key")).limit(0)
    n, held = at.agg(F.count(F.lit(1)), F.sum(F.octet_length("key"))).first()
    few = n * ROW_BYTES + 2 * held <= BROADCAST_LIMIT_BYTES
    meet = lambda side: F.broadcast(side) if few else side.hint("merge")  # noqa: E731  # the grams of the texts never pass through the driver
    grams = explode_rows(texts, ["qid"], _places(F.col("t"), lengths), "g").select("qid", "g.p", "g.gram")
    met = grams.join(meet(at.where("gap is null").select("key", "gram", "off")), "gram").select("qid", (F.col("p") - F.col("off")).alias("p"), "key")
    crowded = at.where("gap is not null")
    if crowded.isEmpty():
        return met.where("p >= 0")
    # The distances of a crowded anchor's second grams: as many as a key has places.
    gaps = crowded.groupBy("gram").agg(F.collect_set("gap").alias("gaps"))
    spots = grams.join(meet(gaps), "gram").groupBy("qid").agg(F.collect_list(F.struct("p", "gram", "gaps")).alias("spots")).join(texts, "qid")
    pairs = F.flatten(F.transform("spots", lambda s: F.transform(s["gaps"], lambda g: F.struct(s["p"].alias("p"), s["gram"].alias("gram"), g.alias("gap"), F.substring(F.col("t"), s["p"] + g + 1, F.lit(GRAM)).alias("gram2")))))
    told = explode_rows(spots, ["qid"], pairs, "g").where("g.p + g.gap >= 0").select("qid", "g.p", "g.gram", "g.gap", "g.gram2")
    split = told.join(meet(crowded), ["gram", "gap", "gram2"]).select("qid", (F.col("p") - F.col("off")).alias("p"), "key")
    return met.unionByName(split).where("p >= 0")


def term_places(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(qid, p, key) for every place p (code points, from 0) where a text of ``texts(qid, t)`` holds one of ``keys(key)``.

    qid is unique, keys are distinct and not empty. A text offers its runs of GRAM characters (and of the lengths of shorter keys), which
    meet the keys' anchors by equality; what is left of each text, a few places, is verified on it.
    """
    found = anchored(texts, anchors(keys)).groupBy("qid").agg(F.collect_set(F.struct("p", "key")).alias("c"))
    sure = F.filter("c", lambda x: F.substring(F.col("t"), x["p"] + 1, F.length(x["key"])) == x["key"])
    return explode_rows(found.join(texts, "qid"), ["qid"], sure, "h").select("qid", "h.p", "h.key")


def contained_terms(queries: DataFrame, terms: DataFrame, fold: bool = False) -> DataFrame:
    """``queries(qid, text)`` (qid unique) x ``terms(term, ...)`` where the text contains the term."""
    t = terms.where("term <> ''").withColumn("_k", F.lower("term") if fold else F.col("term"))
    texts = queries.select("qid", (F.lower("text") if fold else F.col("text")).alias("t"))
    found = term_places(texts, t.select(F.col("_k").alias("key")).distinct()).select("qid", F.col("key").alias("_k")).distinct()
    return found.join(t, "_k").drop("_k")


def token_terms(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """A term equals one of the text's tokens, case-insensitively."""
    toks = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_/-]+"), F.lit(0)), F.lower))
    q = explode_rows(queries, ["qid"], toks, "_k")
    return q.join(terms.where("term <> ''").withColumn("_k", F.lower("term")), "_k").drop("_k")


def last_per_key(df: DataFrame, key: str, ord_col: str, *cols: str) -> DataFrame:
    """The last duplicate of a key wins (a map overwritten in file order)."""
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), ord_col).alias("v")).select(key, "v.*")


def lookup(left: DataFrame, right: DataFrame, key: str, ord_col: str, *cols: str) -> DataFrame:
    """Left lookup against the last duplicate."""
    return left.join(last_per_key(right, key, ord_col, *cols), key, "left")


def items_in_request_order(requests: DataFrame, bank: DataFrame, key: str, ord_col: str) -> DataFrame:
    """``requests(qid, ids)`` -> bank rows in request order, first bank match wins."""
    ids = requests.select("qid", F.posexplode("ids").alias("pos", key))
    cols = [c for c in bank.columns if c not in (key, ord_col)]
    first = bank.groupBy(key).agg(F.min_by(F.struct(*cols), ord_col).alias("v")).select(key, "v.*")
    return ids.join(first, key)


def not_present(new: DataFrame, existing: DataFrame, key: str, ord_col: str) -> DataFrame:
    """Rows whose key is neither stored nor earlier in the same batch."""
    fresh = new.join(existing.select(key).distinct(), key, "left_anti")
    keep = fresh.groupBy(key).agg(F.min(ord_col).alias(ord_col)).select(ord_col)
    return fresh.join(keep, ord_col, "left_semi")


def next_unused(ranked: DataFrame, used: DataFrame, k: int) -> DataFrame:
    """Per query the best k ids not used before. ``ranked`` comes from a top-k."""
    fresh = ranked.where(F.coalesce(F.col("rid").cast("string"), F.lit("")) != "").join(used.select("qid", "rid"), ["qid", "rid"], "left_anti")
    w = Window.partitionBy("qid").orderBy("rank")
    return fresh.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= k)


def evidence_for_slots(evidence: DataFrame, slots: DataFrame) -> DataFrame:
    """``slots(slot, wanted array)`` meets ``evidence(evidence_id, types array)``; an empty wanted list takes all.

    evidence_id is unique. The slots of each type are one small map (left to a join where they are not), so that a row finds
    its distinct slots in place and the evidence is not shuffled.
    """
    some = slots.where(F.size("wanted") > 0).select("slot", F.explode(F.transform("wanted", lambda x: F.lower(strip(x)))).alias("t")).distinct()
    some = cut_lineage(some)
    every = slots.where(F.size("wanted") == 0).select("slot", F.lit(1).alias("_a"))
    if some.count() <= MAP_ROWS:
        by_type = some.where("t is not null").groupBy("t").agg(F.collect_list("slot").alias("slots"))
        named = by_type.agg(F.map_from_entries(F.collect_list(F.struct("t", "slots"))).alias("m"))  # one row
        found = F.array_distinct(F.flatten(F.filter(F.transform("types", lambda t: F.try_element_at(F.col("m"), F.lower(t))), lambda s: s.isNotNull())))
        typed = explode_rows(evidence.crossJoin(F.broadcast(named)), ["evidence_id"], found, "slot").select("slot", "evidence_id")
    else:
        ev = evidence.select("evidence_id", F.explode(F.transform("types", F.lower)).alias("t"))
        typed = some.join(ev, "t").select("slot", "evidence_id").distinct()
    return typed.unionByName(evidence.select("evidence_id", F.lit(1).alias("_a")).join(broadcast_if_small(cut_lineage(every)), "_a").select("slot", "evidence_id"))


def unconsumed(evidence: DataFrame, consumed: DataFrame) -> DataFrame:
    """Evidence with schema slots that no slot consumed."""
    return evidence.where(F.size("types") > 0).join(consumed.select("evidence_id").distinct(), "evidence_id", "left_anti")


def match_text(c: Column) -> Column:
    """J16 normalization: lower case, collapsed whitespace."""
    return squash(F.lower(F.coalesce(c, F.lit(""))))


def oracle_hits(pool: DataFrame, golds: DataFrame) -> DataFrame:
    """Golds of a query found in its pool, containment either way.

    Both sides are per-query lists bounded by an earlier top-k; the join is on ``qid``.
    """
    p = pool.select("qid", match_text(F.col("text")).alias("p")).where("p <> ''")
    g = golds.select("qid", "gold_no", match_text(F.col("text")).alias("g")).where("g <> ''")
    hit = g.join(p, "qid").where(F.contains("p", F.col("g")) | F.contains("g", F.col("p")))
    found = hit.select("qid", "gold_no").distinct().groupBy("qid").agg(F.count(F.lit(1)).alias("hits"))
    return g.groupBy("qid").agg(F.count(F.lit(1)).alias("golds")).join(found, "qid", "left").select(
        "qid", "golds", F.coalesce("hits", F.lit(0)).alias("hits")
    )


def supporting_sentences(titles: Column, sent_ids: Column, ctx_titles: Column, ctx_sentences: Column) -> Column:
    """(title, sentence no) pairs -> sentences of the first paragraph with that title."""
    pairs = F.arrays_zip(titles.alias("t"), sent_ids.alias("s"))
    texts = F.transform(
        pairs,
        lambda p: strip(F.when(p["s"] >= 0, F.get(F.get(ctx_sentences, F.array_position(ctx_titles, p["t"]).cast("int") - 1), p["s"]))),
    )
    return F.array_distinct(F.filter(texts, lambda x: x.isNotNull() & (x != "")))


def merge_evidence(graph: DataFrame, text: DataFrame) -> DataFrame:
    """Graph rows before text rows, first of each stripped text kept. Columns ``qid, pos, text``."""
    both = graph.select("qid", F.lit(0).alias("src"), "pos", strip(F.col("text")).alias("text")).unionByName(
        text.select("qid", F.lit(1).alias("src"), "pos", strip(F.col("text")).alias("text"))
    )
    return both.where("text <> ''").groupBy("qid", "text").agg(F.min(F.struct("src", "pos")).alias("at")).select("qid", "at.src", "at.pos", "text")


def has_url(c: Column) -> Column:
    """U08 predicate."""
    return c.rlike(r"(?i)https?://\S+")


def seen_aliases(aliases: DataFrame, triples: DataFrame) -> DataFrame:
    """Alias records ``(name, alias)`` of names that are subject or object of some triple."""
    seen = triples.select(F.explode(F.array("subject", "object")).alias("name")).distinct()
    return aliases.join(seen, "name", "left_semi")


def answer_anchors(titles: DataFrame, answers: DataFrame) -> DataFrame:
    """Every supporting title ``(qid, pos, title)`` points at its question's answer ``(qid, answer)``."""
    name = F.concat_ws("_", F.lit("tri_answer"), F.col("qid").cast("string"), F.col("pos").cast("string"))
    return titles.join(answers, "qid").select(name.alias("triple_id"), F.col("title").alias("subject"), F.lit("answer_anchor").alias("predicate"), F.col("answer").alias("object"))


def win_cases(predictions: DataFrame, support: DataFrame) -> DataFrame:
    """Won predictions ``(id, win)`` beside the filled supporting sentences of ``(id, sentences)``."""
    kept = F.filter(F.transform("sentences", strip), lambda x: x != "")
    return predictions.where("win").join(support.select("id", kept.alias("support")), "id").select("id", "support")


def range_join(points: DataFrame, p: str, spans: DataFrame, lo: str, hi: str, width: int) -> DataFrame:
    """Each span with every integer point in [lo, hi]: both meet by equality of their bins of ``width``, then exactly.

    A span is offered once for each bin it touches, so ``width`` should be near the usual length of a span. Nulls and empty spans meet nothing.
    """
    bin_of = lambda c: F.floor(F.col(c) / F.lit(width))
    touched = F.explode(F.sequence(bin_of(lo), bin_of(hi)))
    offered = spans.where(F.col(lo) <= F.col(hi)).withColumn("_bin", touched)
    return points.withColumn("_bin", bin_of(p)).join(offered, "_bin").where(F.col(p).between(F.col(lo), F.col(hi))).drop("_bin")
