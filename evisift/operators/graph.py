"""Typed knowledge graph as nodes / edges / index tables.

``triples`` carries ``ord`` (insertion order, unique), ``triple_id, subject, subject_type,
predicate, object, object_type, confidence, sentence_id, sentence_text, source_block_id,
source_doc_id``. Nothing ranks the edges of a node: hubs may own a large share of all
edges, so claims are settled by partial aggregates of an order key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import taxonomy as X
from ..functions.text import squash, strip
from ..session import cut_lineage
from .joins import range_join, term_places
from .ranking import global_position, running_total


def index_key(c: Column) -> Column:
    """Lookup key of a name: collapsed whitespace, lower case."""
    return strip(F.lower(squash(c)))


def relation_table(spark) -> DataFrame:
    """Built-in relation taxonomy (a fixed table of 19 rows)."""
    rows = [(r, inv, i, ",".join(served)) for i, (r, inv, served) in enumerate(X.RELATIONS)]
    return spark.createDataFrame(rows, "rel string, inverse string, rel_no int, intents string")


def last_triples(triples: DataFrame) -> DataFrame:
    """A re-added triple_id replaces the earlier payload but keeps its first position."""
    cols = [c for c in triples.columns if c not in ("triple_id", "ord")]
    g = triples.groupBy("triple_id").agg(
        F.min("ord").alias("ord"), F.max_by(F.struct(*cols), "ord").alias("p")
    )
    return g.select("triple_id", "ord", "p.*")


def _mentions(triples: DataFrame) -> DataFrame:
    """Subject and object names with type, in registration order."""
    both = F.array(
        F.struct(strip(F.col("subject")).alias("name"), strip(F.col("subject_type")).alias("etype"), (F.col("ord") * 2).alias("mo")),
        F.struct(strip(F.col("object")).alias("name"), strip(F.col("object_type")).alias("etype"), (F.col("ord") * 2 + 1).alias("mo")),
    )
    return triples.select(F.explode(both).alias("m")).select("m.*").where("name <> ''")


def entities(triples: DataFrame) -> DataFrame:
    """One row per name; the first non-empty type wins."""
    return _mentions(triples).groupBy("name").agg(
        F.coalesce(F.min_by("etype", F.when(F.col("etype") != "", F.col("mo"))), F.lit("")).alias("entity_type"),
        F.min("mo").alias("first_seen"), F.max("mo").alias("last_seen"),
    )


def merge_aliases(triples: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``aliases(canonical, alias, ord)`` -> (entities, absorbed names, rewritten triples).

    Absorbed names stay rows ``(name, alias)``: a canonical may take over any number.

    The name index maps a key to the name registered last (aliases come after all
    triples). A name whose key points elsewhere is rewritten, one hop only. It is
    removed from the entities only if its canonical is itself an entity.
    """
    ents = entities(triples)
    idx = (
        ents.select(index_key(F.col("name")).alias("k"), F.col("name").alias("to"), F.col("last_seen").alias("o"), F.lit(0).alias("src"))
        .unionByName(
            aliases.where((strip(F.col("canonical")) != "") & (strip(F.col("alias")) != "")).select(
                index_key(F.col("alias")).alias("k"), strip(F.col("canonical")).alias("to"), F.col("ord").alias("o"), F.lit(1).alias("src")
            )
        )
        .groupBy("k").agg(F.max_by("to", F.struct("src", "o")).alias("to"))
    )
    mapped = ents.withColumn("k", index_key(F.col("name"))).join(idx, "k").drop("k")
    moves = mapped.where(F.col("name") != F.col("to")).select("name", "to", "entity_type")
    known = ents.select(F.col("name").alias("to"), F.lit(True).alias("canon_known"))
    moves = moves.join(known, "to", "left").select("name", "to", "entity_type", F.coalesce("canon_known", F.lit(False)).alias("absorbed"))
    gone = moves.where("absorbed")
    inherit = gone.where("entity_type <> ''").groupBy("to").agg(F.min_by("entity_type", "name").alias("inherited"))
    absorbed = gone.select(F.col("to").alias("name"), F.col("name").alias("alias"))
    kept = (
        ents.join(gone.select("name"), "name", "left_anti")
        .join(inherit.withColumnRenamed("to", "name"), "name", "left")
        .select("name", F.coalesce(F.nullif("entity_type", F.lit("")), "inherited", F.lit("")).alias("entity_type"), "first_seen")
    )
    mv = moves.select("name", F.col("to").alias("moved"))
    out = (
        triples.join(mv.withColumnRenamed("name", "subject"), "subject", "left")
        .withColumn("subject", F.coalesce("moved", "subject")).drop("moved")
        .join(mv.withColumnRenamed("name", "object"), "object", "left")
        .withColumn("object", F.coalesce("moved", "object")).drop("moved")
    )
    return kept, absorbed, out


def build_nodes(ents: DataFrame) -> DataFrame:
    """``node_0000`` ids by position in name order."""
    pos = global_position(ents, "name")
    text = F.when(F.col("pos") < 10000, F.lpad(F.col("pos").cast("string"), 4, "0")).otherwise(F.col("pos").cast("string"))
    return pos.withColumn("node_id", F.concat(F.lit("node_"), text)).drop("pos")


def build_edges(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """Outgoing edges with inverses; ``eord`` is the insertion order.

    Incoming edges are the same table read from ``tgt``. A relation that is its own
    inverse stays one-way (T10). Triples whose ends have no node drop out (T11).
    """
    n = nodes.select("name", "node_id").hint("merge")  # small as a file, large in the driver
    t = triples.select("triple_id", "ord", "subject", "predicate", "object")
    ends = (
        t.join(n.select(F.col("name").alias("subject"), F.col("node_id").alias("s")), "subject")
        .join(n.select(F.col("name").alias("object"), F.col("node_id").alias("o")), "object")
    )
    rel = F.broadcast(relation_table(triples.sparkSession).select(F.col("rel").alias("predicate"), "inverse"))
    both = ends.join(rel, "predicate", "left").select(
        "triple_id",
        F.array_compact(
            F.array(
                F.struct(F.col("s").alias("src"), F.col("predicate").alias("rel"), F.col("o").alias("tgt"), (F.col("ord") * 2).alias("eord")),
                F.when(
                    F.col("inverse").isNotNull() & (F.col("inverse") != F.col("predicate")),
                    F.struct(F.col("o").alias("src"), F.col("inverse").alias("rel"), F.col("s").alias("tgt"), (F.col("ord") * 2 + 1).alias("eord")),
                ),
            )
        ).alias("es"),
    )
    out = both.select("triple_id", F.explode("es").alias("e")).select("triple_id", "e.*")
    return out.groupBy("src", "rel", "tgt", "triple_id").agg(F.min("eord").alias("eord"))


def relation_order(edges: DataFrame) -> DataFrame:
    """Adds ``rord``: when this relation first appeared at the source node."""
    first = edges.groupBy("src", "rel").agg(F.min("eord").alias("rord"))
    return edges.join(first, ["src", "rel"])


def reverse_edges(edges: DataFrame) -> DataFrame:
    """Incoming view, re-keyed so that walks look alike in both directions."""
    return edges.select(F.col("tgt").alias("src"), "rel", F.col("src").alias("tgt"), "triple_id", "eord")


def walk(edges: DataFrame, starts: DataFrame, max_hops: int) -> DataFrame:
    """``starts(start, node, rels)`` -> ``(start, node, relation, triple_id, hop, path)``.

    Breadth first, one join per hop. A node is claimed once per start by the smallest
    ``path`` (queue order of the parent, then relation and edge order), a partial
    aggregate rather than a ranking. Empty ``rels`` means every relation.
    """
    e = relation_order(edges)
    frontier = starts.select("start", "node", "rels", F.array().cast("array<bigint>").alias("path"))
    seen = starts.select("start", "node").distinct()
    found = None
    for hop in range(1, max_hops + 1):
        step = (
            frontier.join(e, F.col("node") == F.col("src"))
            .where((F.size("rels") == 0) | F.array_contains("rels", F.col("rel")))
            .select("start", F.col("tgt").alias("node"), "rels", F.concat("path", F.array("rord", "eord")).alias("path"), "rel", "triple_id")
            .join(seen, ["start", "node"], "left_anti")
            .groupBy("start", "node")
            .agg(F.min(F.struct("path", "rel", "triple_id", "rels")).alias("c"))
            .select("start", "node", "c.path", F.col("c.rel").alias("relation"), "c.triple_id", "c.rels", F.lit(hop).alias("hop"))
        )
        if hop < max_hops:
            step = cut_lineage(step)  # read by the result, the next hop and the seen nodes
        found = step if found is None else found.unionByName(step)
        frontier = step.select("start", "node", "rels", "path")
        seen = seen.unionByName(step.select("start", "node"))
    return found.select("start", "node", "relation", "triple_id", "hop", "path")


def _with_sid(triples: DataFrame) -> DataFrame:
    return triples.withColumn("sid", strip(F.coalesce("sentence_id", F.lit("")))).where("sid <> ''")


def sentence_index(triples: DataFrame) -> DataFrame:
    """Per sentence the text of its first triple and the number of triples."""
    return _with_sid(triples).groupBy("sid").agg(
        F.min_by("sentence_text", "ord").alias("text"), F.min_by("source_doc_id", "ord").alias("source_doc_id"),
        F.count_distinct("triple_id").alias("n_triples"),
    )


def sentence_triples(triples: DataFrame) -> DataFrame:
    """The distinct (sentence, triple) links as rows; a sentence may carry any number."""
    return _with_sid(triples).select("sid", "triple_id").distinct()


def display_aliases(absorbed: DataFrame, k: int = 3) -> DataFrame:
    """The first k aliases of a name, as shown in contexts and anchors."""
    w = Window.partitionBy("name").orderBy("alias")
    few = absorbed.where("alias <> name").withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
    return few.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "alias"))), lambda s: s["alias"]).alias("aliases"))


def entity_index(nodes: DataFrame, absorbed: DataFrame | None = None) -> DataFrame:
    """Name or alias key -> node; the entry written last wins, as in a map built in name order.

    ``absorbed(name, alias)`` holds every alias; without it the names alone are indexed.
    """
    base = nodes.select("node_id", "name", F.col("name").alias("n"))
    if absorbed is not None:
        base = base.unionByName(nodes.select("node_id", "name").join(absorbed, "name").select("node_id", "name", F.col("alias").alias("n")))
    return base.select(index_key(F.col("n")).alias("key"), "node_id", "name").where("key <> ''").groupBy("key").agg(
        F.max_by("node_id", "name").alias("node_id")
    )


def recognise(queries: DataFrame, index: DataFrame) -> DataFrame:
    """Longest non-overlapping mentions of index keys in ``queries(qid, text)``.

    Containment is an equi-join on each key's rarest gram, verified at its place (``term_places``). Overlaps are settled per
    query by one fold, longest first.
    """
    keys = index.where("key <> ''")
    places = term_places(queries.select("qid", F.lower("text").alias("t")), keys.select("key").distinct())
    hits = places.join(keys.hint("merge"), "key").withColumn("n", F.length("key"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "key", "p", "n", "node_id")))
    zero = F.struct(
        F.array().cast("array<struct<p:int,e:int,node_id:string>>").alias("kept"), F.lit("").alias("key"), F.lit(0).alias("upto")
    )

    def take(acc: Column, m: Column) -> Column:
        end = m["p"] + m["n"]
        again = (acc["key"] == m["key"]) & (m["p"] < acc["upto"])  # inside this key's previous find
        clash = F.exists(acc["kept"], lambda s: ~((end <= s["p"]) | (m["p"] >= s["e"])))
        item = F.struct(m["p"].alias("p"), end.alias("e"), m["node_id"].alias("node_id"))
        return F.struct(
            F.when(again | clash, acc["kept"]).otherwise(F.array_append(acc["kept"], item)).alias("kept"),
            m["key"].alias("key"), F.when(again, acc["upto"]).otherwise(end).alias("upto"),
        )

    per = hits.groupBy("qid").agg(ordered.alias("ms")).select("qid", F.aggregate("ms", zero, take, lambda a: a["kept"]).alias("kept"))
    named = F.transform("kept", lambda k: F.struct(k["p"].alias("p"), k["e"].alias("e"), k["node_id"].alias("node_id"), F.substring(F.col("text"), k["p"] + 1, k["e"] - k["p"]).alias("mention")))
    kept = per.join(queries.select("qid", "text"), "qid").select("qid", F.posexplode(named).alias("match_no", "m"))
    return kept.select("qid", "match_no", F.col("m.mention").alias("mention"), F.col("m.node_id").alias("node_id"), F.col("m.p").alias("start_at"), F.col("m.e").alias("end_at"))


def classify_intent(c: Column) -> Column:
    """Intent with most keywords present, first maximum wins, '' if none."""
    low = F.lower(c)
    best = None
    for i, (intent, words) in enumerate(X.INTENT_KEYWORDS.items()):
        n = sum((F.contains(low, F.lit(w.lower())).cast("int") for w in words), F.lit(0))
        cell = F.when(n > 0, F.struct(n.alias("n"), F.lit(-i).alias("i"), F.lit(intent).alias("intent")))
        best = [cell] if best is None else [*best, cell]
    return F.coalesce(F.greatest(*best)["intent"], F.lit(""))


def intent_relation_column(intent: Column) -> Column:
    """Relations serving an intent; empty for none."""
    intents = sorted({i for _, _, served in X.RELATIONS for i in served})
    pairs = [x for i in intents for x in (F.lit(i), F.array(*[F.lit(r) for r in X.intent_relations(i)]))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(intent)), F.array().cast("array<string>"))


def retrieve(
    queries: DataFrame, triples: DataFrame, nodes: DataFrame, edges: DataFrame, max_hops: int = 2, max_evidence: int = 10,
    fix_empty_id: bool = False,
) -> DataFrame:
    """Evidence rows per query from walks, fallbacks and the relation scan.

    ``queries(qid, text, intent)``. The relation scan adds, after the walk, the first
    sentences of every triple with a wanted relation. At most ``max_evidence`` of them
    can be used and fewer than ``max_evidence`` can already be taken, so the first
    2 x ``max_evidence`` distinct sentences per intent replace the scan exactly.
    """
    idx = entity_index(nodes)
    wanted = queries.select("qid", intent_relation_column(F.col("intent")).alias("rels"), F.lower("intent").alias("intent"))
    m = cut_lineage(recognise(queries, idx).join(wanted, "qid"))  # read by every branch below
    starts = m.select(F.struct("qid", "match_no").alias("start"), F.col("node_id").alias("node"), "rels")
    out = cut_lineage(walk(edges, starts, max_hops))
    dry = starts.join(out.select("start").distinct(), "start", "left_anti")
    back = walk(reverse_edges(edges), dry, max_hops)
    walked = cut_lineage(out.unionByName(back))
    lost = starts.where(F.size("rels") > 0).join(
        walked.select(F.col("start.qid").alias("q")).distinct(), F.col("start.qid") == F.col("q"), "left_anti"
    )
    broad = walk(edges, lost.select("start", "node", F.array().cast("array<string>").alias("rels")), 1)
    hits = walked.unionByName(broad).select(
        F.col("start.qid").alias("qid"), F.lit(0).alias("branch"), F.col("start.match_no").alias("match_no"), "path", "relation", "triple_id", "hop"
    )
    sid = F.coalesce("sentence_id", F.lit(""))
    info = triples.select(
        "triple_id", "ord", "predicate", "subject", "object", sid.alias("sid"), F.coalesce("sentence_text", F.lit("")).alias("text"),
    ).where("text <> ''")
    if fix_empty_id:
        info = info.withColumn("sid", F.when(F.col("sid") == "", F.col("triple_id")).otherwise(F.col("sid")))
    served = relation_table(triples.sparkSession).select(F.col("rel").alias("predicate"), F.explode(F.split("intents", ",")).alias("intent")).where("intent <> ''")
    scan = info.join(F.broadcast(served), "predicate").groupBy("intent", "sid").agg(F.min(F.struct("ord", "triple_id", "predicate", "subject", "object", "text")).alias("f"))
    scan = (
        scan.withColumn("n", F.row_number().over(Window.partitionBy("intent").orderBy("f.ord")))
        .where(F.col("n") <= 2 * max_evidence)
        .select("intent", F.array(F.col("f.ord")).alias("path"), F.col("f.predicate").alias("relation"), "f.triple_id", "f.subject", "f.object", "sid", "f.text")
    )
    matched = m.select("qid", "intent").distinct()
    scanned = matched.join(scan, "intent").select(
        "qid", F.lit(1).alias("branch"), F.lit(0).alias("match_no"), "path", "relation", "triple_id", F.lit(0).alias("hop"), "subject", "object", "sid", "text"
    )
    # The scan's few triples serve every query: they bring their payload along instead of joining on hot ids.
    rows = hits.join(info.drop("ord", "predicate"), "triple_id").unionByName(scanned)
    first = rows.groupBy("qid", "sid").agg(
        F.min(F.struct("branch", "match_no", "path", "hop", "relation", "triple_id", "text", "subject", "object")).alias("f")
    )
    w = Window.partitionBy("qid").orderBy("f.branch", "f.match_no", "f.path", "f.triple_id")
    return (
        first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_evidence)
        .select("qid", "rank", F.col("sid").alias("sentence_id"), "f.text", "f.relation", "f.triple_id", "f.hop", "f.subject", "f.object")
    )


def entity_context(matches: DataFrame, nodes: DataFrame) -> DataFrame:
    """Description, else type, else aliases; up to three aliases are shown."""
    al = F.slice(F.filter("aliases", lambda a: a != F.col("name")), 1, 3)
    shown = F.when(F.size(al) > 0, F.concat(F.lit("（"), F.array_join(al, ", "), F.lit("）"))).otherwise("")
    desc = strip(F.coalesce("description", F.lit("")))
    part = (
        F.when(desc != "", F.concat("name", shown, F.lit("："), desc))
        .when(F.col("entity_type") != "", F.concat("name", shown, F.lit("，类型："), "entity_type"))
        .when(F.size(al) > 0, F.concat("name", F.lit("（又称 "), F.array_join(al, ", "), F.lit("）")))
    )
    j = matches.join(nodes, "node_id").select("qid", "match_no", part.alias("part")).where("part is not null")
    lines = F.array_sort(F.collect_list(F.struct("match_no", "part")))
    return j.groupBy("qid").agg(
        F.concat(F.lit("### 实体背景\n"), F.array_join(F.transform(lines, lambda s: F.concat(F.lit("- "), s["part"])), "\n")).alias("context")
    )


def _layer(rel: Column, side: int) -> Column:
    pairs = [F.lit(x) for r, lay in X.LAYER_RANGES.items() for x in (r, lay[side])]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), rel), F.lit(X.DEFAULT_LAYERS[side]))


def render_triple(s: Column, p: Column, o: Column) -> Column:
    """Subject, verb, object; cut at 45 characters."""
    pairs = [F.lit(x) for kv in X.RELATION_VERBS.items() for x in kv]
    verb = F.coalesce(F.try_element_at(F.create_map(*pairs), p), p)
    parts = F.filter(F.array(strip(s), strip(verb), strip(o)), lambda x: x != "")
    text = F.array_join(parts, " ")
    return F.when(F.length(text) > 45, F.rtrim(F.substring(text, 1, 45))).otherwise(text)


def compile_items(triples: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Manifest of anchors and triple items. Ids come from 30 characters of the name and may collide."""
    safe = F.substring(F.translate("name", "/ ", "__"), 1, 30)
    desc = strip(F.coalesce("description", F.lit(""))) if "description" in nodes.columns else F.lit("")
    short = F.substring(desc, 1, 40)
    anchor_text = (
        F.when(desc != "", F.concat("name", F.lit("（"), short, F.lit("）")))
        .when(F.size("aliases") > 0, F.concat("name", F.lit("（"), F.array_join(F.slice("aliases", 1, 2), "、"), F.lit("）")))
        .otherwise(F.col("name"))
    )
    anchors = nodes.select(
        F.concat(F.lit("anchor_"), safe).alias("item_id"), F.col("name").alias("entity_name"), F.lit("subject_anchor").alias("item_type"),
        anchor_text.alias("text"), F.lit("").alias("relation"), F.lit(X.ANCHOR_LAYERS[0]).alias("layer_start"),
        F.lit(X.ANCHOR_LAYERS[1]).alias("layer_end"), F.lit(None).cast("string").alias("triple_id"),
    )
    # One item per (node, triple); its number is the triple's position at the node.
    e = relation_order(edges).groupBy("src", "triple_id").agg(F.min(F.struct("rord", "eord")).alias("at"))
    numbered = number_within(e, "src", "at")
    t = triples.select("triple_id", "subject", "predicate", "object")
    items = numbered.join(nodes.select(F.col("node_id").alias("src"), "name").hint("merge"), "src").join(t, "triple_id").select(
        F.concat(F.lit("triple_"), safe, F.lit("_"), F.col("no").cast("string")).alias("item_id"), F.col("name").alias("entity_name"),
        F.lit("triple").alias("item_type"), render_triple(F.col("subject"), F.col("predicate"), F.col("object")).alias("text"),
        F.col("predicate").alias("relation"), _layer(F.col("predicate"), 0).alias("layer_start"), _layer(F.col("predicate"), 1).alias("layer_end"), "triple_id",
    )
    return anchors.unionByName(items)


def number_within(df: DataFrame, key: str, order: str) -> DataFrame:
    """0-based ``no`` within ``key``. A hub may own most rows, so positions come from one
    range-partitioned sort of the whole table instead of a per-key window."""
    pos = global_position(df, key, order)
    first = pos.groupBy(key).agg(F.min("pos").alias("_first"))
    return pos.join(first, key).withColumn("no", F.col("pos") - F.col("_first")).drop("pos", "_first")


def select_items(items: DataFrame, matched: DataFrame, allowed: DataFrame) -> DataFrame:
    """Anchors of matched entities always, triple items only if allowed.

    ``matched(qid, entity_name)``, ``allowed(qid, triple_id)``; no allowed rows means no triples.
    """
    mine = matched.join(items, "entity_name")
    anchors = mine.where("item_type = 'subject_anchor'")
    chosen = mine.where("item_type = 'triple'").join(allowed.distinct(), ["qid", "triple_id"], "left_semi")
    return anchors.unionByName(chosen.select(*anchors.columns))


def layer_prefix(selected: DataFrame, key: str, num_layers: int, usual: int = 8) -> DataFrame:
    """Where each selected item lies in the prefix of each layer of its ``key`` (a question).

    ``selected(key, item_id, ord, len, layer_start, layer_end)``, (key, ord) unique. An item fills ``len`` places in the layers of its range;
    items follow each other by ``ord``. Layers are padded in front to the longest one of the question; a layer without an item
    is all padding: one row with no item. Layers from ``num_layers`` on do not exist; a null length counts as 0; a null question, and
    one none of whose items has a place, get no rows. Returns key, layer, item_id, start, len, pad, width.
    """
    layers = selected.sparkSession.range(num_layers).select(F.col("id").cast("int").alias("layer"))
    spans = selected.where(F.col(key).isNotNull()).select(key, "item_id", "ord", F.coalesce("len", F.lit(0)).cast("long").alias("len"), "layer_start", "layer_end")
    held = range_join(F.broadcast(layers), "layer", spans, "layer_start", "layer_end", usual)  # num_layers rows
    held = cut_lineage(running_total(held, [key, "layer"], "ord", "len"))
    # Sums by question and layer: at most num_layers rows a question, so a hot question is small from here on.
    lengths = held.groupBy(key, "layer").agg(F.sum("len").alias("filled"))
    one = lengths.groupBy(key).agg(F.max("filled").alias("width"), F.map_from_entries(F.collect_list(F.struct("layer", "filled"))).alias("by_layer"))
    one = one.where("width > 0")
    all_layers = one.select(key, "width", F.explode(F.sequence(F.lit(0), F.lit(num_layers - 1))).alias("layer"), "by_layer")
    all_layers = all_layers.select(key, "layer", "width", (F.col("width") - F.coalesce(F.try_element_at("by_layer", F.col("layer")), F.lit(0))).alias("pad"))
    placed = all_layers.join(held.select(key, "layer", "item_id", "len", (F.col("upto") - F.col("len")).alias("before")), [key, "layer"], "left")
    return placed.select(key, "layer", "item_id", (F.col("pad") + F.col("before")).alias("start"), "len", "pad", "width")


def relation_gating(scored: DataFrame, key: str, relation: str, score: str, ord_col: str, top: int = 2) -> DataFrame:
    """Rows of the ``top`` relations by summed score; ties go to the relation seen first."""
    g = scored.groupBy(key, relation).agg(F.round(F.sum(score), 6).alias("total"), F.min(ord_col).alias("seen"))
    w = Window.partitionBy(key).orderBy(F.col("total").desc(), "seen")
    best = g.withColumn("rel_rank", F.row_number().over(w)).where(F.col("rel_rank") <= top)
    return scored.join(best.select(key, relation, "rel_rank", "total"), [key, relation])
