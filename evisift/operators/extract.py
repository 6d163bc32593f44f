"""Table-valued text functions: one row in, a list out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chars import CJK, WORD
from ..functions.rows import explode_rows
from ..functions.sentences import split_units, units_at
from ..functions.text import bind, squash, strip

BOUND_L, BOUND_R = f"(?<![{WORD}])", f"(?![{WORD}])"
STR_ARRAY = "array<string>"


def all_groups(c: Column, rx: str, group: int) -> Column:
    return F.regexp_extract_all(c, F.lit(rx), F.lit(group))


def empty(t: str = STR_ARRAY) -> Column:
    return F.array().cast(t)


def distinct_by(arr: Column, key) -> Column:
    """First of every key, input order kept. Two sorts inside the row, so long lists cost n log n."""
    keyed = F.array_sort(F.transform(arr, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))))
    firsts = bind(keyed, lambda a: F.filter(a, lambda s, i: (i == 0) | ~s["k"].eqNullSafe(F.get(a, i - 1)["k"])))
    return F.transform(F.array_sort(F.transform(firsts, lambda s: F.struct(s["i"], s["x"]))), lambda s: s["x"])


def first_n(arr: Column, n: int | None) -> Column:
    """The first ``n`` elements; all of them without a limit."""
    return arr if n is None else F.slice(arr, 1, n)


# Abbreviation patterns (group 1, group 2) and their confidence.
ABBR_EN = r"([A-Za-z][A-Za-z0-9 \-]{3,80})\s*[(\x{ff08}]\s*([A-Z][A-Z0-9\-]{1,12})\s*[)\x{ff09}]"
ABBR_ZH = rf"([{CJK}A-Za-z0-9\x{{b7}}\-\s]{{2,40}})\s*[(\x{{ff08}}]\s*([A-Z][A-Z0-9\-]{{1,12}})\s*[)\x{{ff09}}]"
ABBR_REV = r"([A-Z][A-Z0-9\-]{1,12})\s*[(\x{ff08}]\s*([^)\x{ff09}]{2,60})\s*[)\x{ff09}]"
PAIR = "array<struct<abbr:string,full:string,confidence:double,source:string>>"


def abbreviation_pairs(c: Column, max_pairs: int | None = None) -> Column:
    """Full (ABBR) in two scripts, then ABBR (Full); cut to ``max_pairs`` where given (a limit for blocks), then de-duplicated."""
    return bind(squash(c), lambda t: _pairs_of(t, max_pairs))


def _pairs_of(t: Column, max_pairs: int | None) -> Column:
    def pairs(rx: str, full_group: int, conf: float, source: str) -> Column:
        abbr = all_groups(t, rx, 3 - full_group)
        full = all_groups(t, rx, full_group)
        return F.zip_with(
            abbr, full,
            lambda a, f: F.struct(
                F.upper(squash(a)).alias("abbr"), squash(f).alias("full"), F.lit(conf).alias("confidence"), F.lit(source).alias("source")
            ),
        )

    def ok(p: Column) -> Column:
        return F.length(p["abbr"]).between(2, 12) & F.length(p["full"]).between(2, 120) & (F.upper(p["full"]) != p["abbr"])

    rev = F.filter(
        pairs(ABBR_REV, 2, 0.55, "abbr(full):rev"),
        lambda p: (F.length(p["full"]) <= 60) & p["full"].rlike(f"[A-Za-z{CJK}]"),
    )
    every = F.concat(pairs(ABBR_EN, 1, 0.95, "full(abbr):en"), pairs(ABBR_ZH, 1, 0.90, "full(abbr):zh"), rev)
    capped = first_n(F.filter(every, ok), max_pairs)
    out = distinct_by(capped, lambda p: F.struct(p["abbr"], p["full"]))
    # Without a parenthesis nothing can match: skip the scans.
    return F.when(t.rlike(r"[(\x{ff08}]"), out).otherwise(F.array().cast(PAIR))


# Title-case phrases and terms with a medical ending.
TITLE_PHRASE = f"{BOUND_L}[A-Z][a-z]{{2,}}(?:[ \\-][A-Z][a-z]{{2,}}){{0,5}}{BOUND_R}"
CJK_TERM = f"[{CJK}]{{2,20}}(?:综合征|病毒|感染|发热|血小板减少|抗体|疫苗|治疗)"


def entity_candidates(c: Column, max_entities: int | None = None) -> Column:
    """Title-case phrases, then CJK terms; cut to ``max_entities`` where given (a limit for blocks), then case-insensitively distinct."""
    return bind(squash(c), lambda t: _entities_of(t, max_entities))


def _entities_of(t: Column, max_entities: int | None) -> Column:
    en = F.filter(all_groups(t, TITLE_PHRASE, 0), lambda s: F.length(s).between(3, 80))
    zh = F.when(t.rlike(f"[{CJK}]"), F.filter(all_groups(t, CJK_TERM, 0), lambda s: F.length(s).between(2, 40))).otherwise(empty())
    return distinct_by(first_n(F.concat(en, zh), max_entities), F.lower)


def lines_of(c: Column) -> Column:
    """Stripped, non-empty lines."""
    return F.filter(F.transform(F.split(c, r"\r\n|[\n\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"), strip), lambda l: l != "")


def _bullet(l: Column) -> Column:
    return l.rlike(r"^[-*\x{2022}\x{b7}]")


def _bracket_number(l: Column) -> Column:
    return l.rlike(r"^[\x{ff08}(\x{3010}]") & (F.length(l) > 3) & F.substring(l, 1, 4).rlike(r"[\x{ff09})\x{3011}]")


def _two_digits(l: Column) -> Column:
    return l.rlike(r"^[0-9]{2}[.)\x{3001}]")


# List cues (group 2 is the list).
LIST_CUES = [
    r"(?i)(symptoms include|clinical manifestations are|clinical features include|patients typically present with)\s+([^.;]+)",
    r"(?i)(is characterized by|are characterized by|presents with|present with)\s+([^.;]+)",
    r"(?i)(symptoms (?:such as|including)|features (?:such as|including))\s+([^.;]+)",
    r"(?i)(表现为|症状包括|临床表现为|典型表现为|常见表现为|以.+为主要表现)\s*([^。；;]+)",
    r"(?i)(主要症状包括|临床特征包括|临床症状包括)\s*([^。；;]+)",
]


# Literal heads of the cues: texts without any of them skip the pattern scans.
LIST_CUE_HEADS = ["symptoms", "clinical manifestations are", "clinical features include", "patients typically", "characterized by", "presents with", "present with", "features"]


def _cued(c: Column, low: Column | None) -> Column:
    """Fragments after the list cues."""
    def every(rxs: list[str], gate: Column) -> Column:
        return F.when(gate, F.concat(*[all_groups(c, rx, 2) for rx in rxs])).otherwise(empty())

    heads = lambda lo: any_contains(lo, LIST_CUE_HEADS)
    latin = bind(F.lower(c), heads) if low is None else heads(low)
    return F.concat(every(LIST_CUES[:3], latin), every(LIST_CUES[3:], any_contains(c, ["表现", "症状", "特征"])))


def list_like_features(c: Column, max_items: int | None = None, low: Column | None = None) -> Column:
    """X06. Enumeration needs two leading digits, as in the contract. ``low`` is the lower-cased text, where a caller has it."""
    return bind(F.struct(lines_of(c).alias("lines"), _cued(c, low).alias("frags")), lambda b: _list_like(c, b["lines"], b["frags"], max_items))


def list_like_items(c: Column, low: Column | None = None) -> Column:
    """The items alone; lines and density are not looked at."""
    return F.array_distinct(_listed(_cued(c, low)))


def _list_like(c: Column, lines: Column, frags: Column, max_items: int | None) -> Column:
    sentences = F.greatest(F.lit(1), F.regexp_count(c, F.lit(r"[。.!?;；]")) + 1)
    return bind(_listed(frags), lambda items: _list_like_struct(lines, items, sentences, max_items))


def _listed(frags: Column) -> Column:
    parts = F.flatten(F.transform(frags, lambda f: F.split(squash(f), rf"(?i)[，,、;；]+|{BOUND_L}and{BOUND_R}|{BOUND_L}or{BOUND_R}")))
    return F.filter(F.transform(parts, squash), lambda s: F.length(s).between(2, 64))


def _list_like_struct(lines: Column, items: Column, sentences: Column, max_items: int | None) -> Column:
    return F.struct(
        F.exists(lines, _bullet).alias("has_bullets"),
        F.exists(lines, lambda l: _two_digits(l) | _bracket_number(l)).alias("has_enumeration"),
        F.least(F.lit(1.0), F.size(items) / sentences).alias("list_density"),
        first_n(F.array_distinct(items), max_items).alias("list_like_items"),
    )


def bullet_items(c: Column) -> Column:
    """X23."""
    got = F.transform(
        lines_of(c),
        lambda l: F.when(_bullet(l), strip(F.regexp_replace(l, r"^[-*\x{2022}\x{b7} ]+", "")))
        .when(_two_digits(l) | _bracket_number(l), strip(F.substring(l, F.lit(4), F.length(l)))),
    )
    return F.filter(got, lambda x: x.isNotNull() & (x != ""))


# --- Rule-driven list features (X07, X08) -------------------------------------------------
# Default rules per semantic type; a specific list replaces the generic one.
LIST_RULES = {
    "generic": {
        "signals": {"bullets": ["-", "*", "•"], "numbering_regex": ["^[0-9]+[.)]", "^[a-zA-Z][.)]"]},
        "split": {"delimiters": [",", ";", " and "]},
        "confidence": {"bullet": 0.6, "numbering": 0.6},
    },
    "drug": {"signals": {"trigger_phrases": []}, "split": {"delimiters": [",", ";"]}, "confidence": {"trigger_phrase": 0.0}},
    "location": {
        "signals": {
            "bullets": [], "numbering_regex": [],
            "trigger_phrases": [
                "were reported in", "was reported in", "reported in", "were found in", "was found in", "found in",
                "occurred in", "occur in", "distributed in", "distribution in", "分布于", "分布在", "发生在", "报告于", "报告在",
            ],
            "paren_cases_regex": r"\(\s*\d+\s+cases?\s*\)",
            "paren_cases_capture_regex": r"([A-Z][A-Za-z\-]{2,}(?:\s+[A-Z][A-Za-z\-]{2,})*\s*\(\s*\d+\s+cases?\s*\))",
        },
        "split": {"delimiters": [",", ";", " and ", "、", "，", "；", "及", "以及"]},
        "confidence": {"trigger_phrase": 0.55, "paren_cases": 0.6},
    },
    "symptom": {
        "signals": {
            "trigger_phrases": [
                "symptoms include", "clinical features include", "patients present with", "manifested by",
                "is characterized by", "are characterized by", "symptoms such as", "features such as",
            ]
        },
        "split": {"delimiters": [",", ";", " and "]},
        "confidence": {"trigger_phrase": 0.7},
    },
}


def merge_rules(generic: dict, specific: dict, concat_top_lists: bool = False) -> dict:
    """Nested dicts update; top-level lists replace (list rules) or concatenate (value rules)."""
    out = dict(generic)
    for k, v in specific.items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = {**out[k], **v}
        elif isinstance(v, list) and isinstance(out.get(k), list):
            out[k] = [*out[k], *v] if concat_top_lists else list(v)
        else:
            out[k] = v
    return out


# Phrases that report or find something somewhere, and words for places.
REPORT_PHRASES = [" were reported in ", " was reported in ", "reported in ", " distributed in ", "occurred in "]
FOUND_PHRASES = [
    " were reported in ", " was reported in ", "reported in ", " were found in ", " was found in ", "found in ", "occurred in ", "occur in ",
    " distributed in ", "distribution in ",
]
GEO_WORDS_EN = ["province", "city", "county", "counties", "prefecture", "district", "region", "areas", "cities", "town", "village"]
GEO_WORDS_ZH = ["省", "市", "县", "区", "州", "地区"]


def any_contains(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def infer_list_type(c: Column, slots: Column, low: Column | None = None) -> Column:
    """Location / symptom / drug / generic. ``low`` is the lower-cased text, where a caller has it."""
    return bind(F.lower(c), lambda lo: _list_type(c, lo, slots)) if low is None else _list_type(c, low, slots)


def _list_type(c: Column, low: Column, slots: Column) -> Column:
    slot_has = lambda rx: F.exists(slots, lambda s: F.lower(s).rlike(rx))
    cases = low.rlike(r"\(\s*\d+\s+cases?\s*\)")
    geo = any_contains(low, GEO_WORDS_EN) | any_contains(c, GEO_WORDS_ZH) | any_contains(low, FOUND_PHRASES)
    loc = slot_has("geographic|distribution|region|location|area|epidemiolog") | (cases & geo) | (~cases & any_contains(low, REPORT_PHRASES))
    return F.when(loc, "location").when(slot_has("clinical|symptom"), "symptom").when(slot_has("treatment|drug"), "drug").otherwise("generic")


def _split_in_order(arr: Column, delimiters: list[str]) -> Column:
    """Connectors are applied one after the other, in file order."""
    import re

    def cut(d: str):
        pieces = lambda p: F.filter(F.transform(F.split(p, re.escape(d)), strip), lambda s: s != "")
        return lambda p: F.when(F.contains(p, F.lit(d)), pieces(p)).otherwise(F.array(p))

    for d in delimiters:
        arr = F.flatten(F.transform(arr, cut(d)))
    return arr


def _after_phrase(c: Column, low: Column, phrase: Column) -> Column:
    """Text after the first occurrence of the phrase, up to the first separator kind that occurs past position 0."""
    # Separators, in the order in which they are tried.
    seps = F.array(*[F.lit(s) for s in [".", ";", "\n", "。", "；", "!", "！", "?", "？"]])
    at = F.call_function("locate", F.lower(phrase), low)

    def cut(frag: Column) -> Column:
        ends = F.filter(F.transform(seps, lambda s: F.call_function("instr", frag, s)), lambda j: j > 1)
        return F.when(F.size(ends) > 0, strip(F.substring(frag, F.lit(1), F.get(ends, 0) - 1))).otherwise(frag)

    return bind(strip(F.substring(c, at + F.length(phrase), F.length(c))), cut)


def _numbered(lines: Column, rx: str) -> tuple[Column, Column]:
    match = lambda l: l.rlike(rx)
    return F.exists(lines, match), F.transform(F.filter(lines, match), lambda l: strip(F.regexp_replace(l, rx, "")))


def rule_list_features(c: Column, rules: dict, semantic_type: str, low: Column | None = None) -> Column:
    """X07 for one semantic type: struct(signals, items, confidence, list_type). ``low`` is the lower-cased text, where a caller has it."""
    t = F.translate(F.regexp_replace(c, r"[\x{ad}\x{200b}\x{200c}\x{200d}\x{2060}]", ""), "\xa0", " ")
    capture = rules.get("signals", {}).get("paren_cases_capture_regex")
    clean = lambda s: strip(F.regexp_replace(strip(s), r"(?i)^(?:and|or)\s+", ""))

    def with_caps(t: Column) -> Column:
        caps = F.transform(all_groups(t, capture, 1), clean) if capture else empty()
        lowered = F.lower(t) if low is None else F.when(t == c, low).otherwise(F.lower(t))
        pack = F.struct(lines_of(t).alias("lines"), caps.alias("caps"), lowered.alias("low"))
        return bind(pack, lambda b: _rule_features(t, b["low"], b["lines"], b["caps"], rules, semantic_type))

    return bind(t, with_caps)


def _rule_features(t: Column, low: Column, lines: Column, caps: Column, rules: dict, semantic_type: str) -> Column:
    sig, split, conf = rules.get("signals", {}), rules.get("split", {}), rules.get("confidence", {})
    signals, items, scores = [], [], [F.lit(0.0)]
    capture = sig.get("paren_cases_capture_regex")
    captured = F.lit(False)
    if capture:
        captured = F.size(caps) > 0
        signals.append(F.when(captured, F.lit("paren_cases_capture")))
        scores.append(F.when(captured, float(conf.get("paren_cases", 0.0))).otherwise(0.0))
        items.append(caps)
    bullets = sig.get("bullets", [])
    if bullets:
        cls = "".join("\\" + b for b in bullets if ord(b) < 128) + "".join(b for b in bullets if ord(b) >= 128)
        is_b = lambda l: l.rlike(f"^[{cls}]")
        hit = F.exists(lines, is_b)
        signals.append(F.when(hit, F.lit("bullet")))
        scores.append(F.when(hit, float(conf.get("bullet", 0.0))).otherwise(0.0))
        items.append(F.transform(F.filter(lines, is_b), lambda l: strip(F.regexp_replace(l, f"^[{cls}]+", ""))))
    if sig.get("numbering_regex"):
        done, picked = F.lit(False), empty()
        for rx in sig["numbering_regex"]:
            hit, mine = _numbered(lines, rx)
            picked = F.when(done, picked).when(hit, mine).otherwise(picked)
            done = done | hit
        signals.append(F.when(done, F.lit("numbering")))
        scores.append(F.when(done, float(conf.get("numbering", 0.0))).otherwise(0.0))
        items.append(picked)
    phrases = sig.get("trigger_phrases", [])
    fired = None
    if phrases:
        # One expression over the list of phrases, not one per phrase.
        fired = F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(low, F.lower(p)))
        scores.append(F.when(F.size(fired) > 0, float(conf.get("trigger_phrase", 0.0))).otherwise(0.0))
        frags = F.filter(F.transform(fired, lambda p: _after_phrase(t, low, p)), lambda f: f != "")
        found = _split_in_order(frags, split.get("delimiters", []))
        items.append(F.when(captured, empty()).otherwise(found) if semantic_type == "location" else found)
    if sig.get("paren_cases_regex") and not capture:
        rx = "(?i)" + sig["paren_cases_regex"]
        sent = strip(F.regexp_extract(t, rf"(?i)([^.;\n。；!！?？]*{sig['paren_cases_regex']}[^.;\n。；!！?？]*)", 1))
        hit = t.rlike(rx) & (sent != "")
        signals.append(F.when(hit, F.lit("paren_cases")))
        scores.append(F.when(hit, float(conf.get("paren_cases", 0.0))).otherwise(0.0))
        items.append(F.when(hit, _split_in_order(F.array(sent), split.get("delimiters", []))).otherwise(empty()))
    raw = F.transform(F.concat(*items) if items else empty(), strip)

    def keep(s: Column) -> Column:
        good = s.rlike(f"[A-Za-z0-9{CJK}]")
        if semantic_type == "location":
            good = good & ~s.rlike(r"^(?:\d{4}|[A-Za-z])$") & (~captured | s.rlike(r"(?i)\(\s*\d+\s+cases?\s*\)"))
        return good

    sigs = F.array_compact(F.array(*signals)) if signals else empty()
    if fired is not None:
        sigs = F.concat(sigs, F.transform(fired, lambda p: F.concat(F.lit("trigger_phrase:"), p)))
    return F.struct(
        sigs.alias("signals"), F.array_distinct(F.filter(raw, keep)).alias("list_items"),
        F.greatest(*scores, F.lit(0.0)).alias("confidence"), F.lit("other" if semantic_type == "generic" else semantic_type).alias("list_type"),
    )


def list_features(df: DataFrame, text: str, slots: str, rules: dict[str, dict] | None = None, low: str | None = None) -> DataFrame:
    """X07+X08: adds ``lf``. Each row runs only the rule set of its own type. ``low`` names the lower-cased text, where there is one."""
    rules = rules or LIST_RULES
    lowered = None if low is None else F.col(low)

    def by_type(kind: Column) -> Column:
        out = None
        for name in ("location", "symptom", "drug", "generic"):
            feat = rule_list_features(F.col(text), merge_rules(rules.get("generic", {}), rules.get(name, {})), name, lowered)
            out = F.when(kind == name, feat) if out is None else out.when(kind == name, feat)
        return out

    return df.withColumn("lf", bind(infer_list_type(F.col(text), F.col(slots), lowered), by_type))


def list_bank_meta(lf: Column, like: Column, slots: Column) -> Column:
    """List metadata of a bank row from both feature kinds."""
    return bind(F.struct(lf.alias("lf"), like.alias("like"), slots.alias("slots")), lambda b: _bank_meta(b["lf"], b["like"], b["slots"]))


def _bank_meta(lf: Column, like: Column, slots: Column) -> Column:
    items = F.when(F.size(lf["list_items"]) > 0, lf["list_items"]).otherwise(like["list_like_items"])
    sig = lf["signals"]
    has = lambda w: F.exists(sig, lambda s: F.contains(s, F.lit(w)))
    low_slots = F.transform(slots, F.lower)
    cue = has("trigger_phrase") | F.exists(low_slots, lambda s: s.rlike("clinical|symptom"))
    enum = like["has_bullets"] | like["has_enumeration"] | has("bullet") | has("numbering")
    loc = has("paren_cases") | F.exists(sig, lambda s: F.startswith(F.lower(s), F.lit("trigger_phrase:")))
    tenth = lambda b: F.when(b, 0.1).otherwise(0.0)
    return F.struct(
        ((F.size(sig) > 0) | (F.size(items) > 0) | like["has_bullets"] | like["has_enumeration"]).alias("list_like"),
        F.size(items).alias("list_feature_count"),
        F.round(F.least(F.lit(1.0), F.size(items) * 0.3 + tenth(cue) + tenth(enum) + tenth(loc)), 6).alias("list_confidence"),
        sig.alias("list_signals"), lf["list_type"].alias("list_type"),
    )


# --- Evidence units (X09-X12, X25) ---------------------------------------------------------
# Signs of an enumeration, of running prose, of sections that inject nothing, and clauses that lead into a list.
ENUM_SIGNAL = rf"(?i)[,;，；、和或及]|{BOUND_L}(?:and|or){BOUND_R}"
DISCOURSE = rf"(?i){BOUND_L}(in addition|furthermore|see also){BOUND_R}"
BLOCKING = rf"(?i){BOUND_L}(statistical analysis|methods|materials and methods|copyright|license|p value|confidence interval){BOUND_R}"
# Literals without which the two patterns cannot match a lower-cased text.
DISCOURSE_HEADS = ["in addition", "furthermore", "see also"]
BLOCKING_HEADS = ["statistical analysis", "methods", "copyright", "license", "p value", "confidence interval"]
LEAD_CLAUSE = rf"(?i)^.*?{BOUND_L}(with|including|include|present with|characterized by){BOUND_R}"
LEAD_CLAUSE_ZH = "^.*?(包括|主要包括|表现为|表现出|常见表现包括|临床表现包括|临床表现为)[:：]?"
LEAD_IN_ZH = "^(此外|另外|同时|同时也|此外也|其中|并且|而且)[，,]\\s*"
UNIT = "struct<sentence_id:string,unit_type:string,semantic_role:string,text:string,confidence:double,reasons:array<string>>"


def _discursive(low: Column) -> Column:
    return any_contains(low, DISCOURSE_HEADS) & low.rlike(DISCOURSE)


def _blocking(low: Column) -> Column:
    return any_contains(low, BLOCKING_HEADS) & low.rlike(BLOCKING)


def section_type(c: Column, block_type: Column, is_table: Column, low: Column | None = None) -> Column:
    """X09. ``low`` is the lower-cased text, where a caller has it."""
    low, bt = F.lower(c) if low is None else low, F.lower(strip(F.coalesce(block_type, F.lit(""))))
    return (
        F.when(bt.isin("figure", "fig"), "figure").when(bt == "table", "table")
        .when(bt.isin("supplementary", "supplement", "supp"), "supplementary").when(is_table, "table")
        .when(F.contains(low, F.lit("supplementary")), "supplementary").when(F.contains(low, F.lit("figure")), "figure")
        .when(low.rlike("table[ :]"), "table").when(strip(c) != "", "paragraph").otherwise("other")
    )


def enumeration_items(s: Column) -> Column:
    """X11: struct(items, mixed)."""
    t = F.regexp_replace(s, LEAD_IN_ZH, "")
    t = F.regexp_replace(t, rf"(?i){BOUND_L}(and|or){BOUND_R}", ",")
    t = F.regexp_replace(t, "以及|及|和|或", "，")
    raw = F.filter(F.transform(F.split(t, "[,;，；、]"), strip), lambda p: p != "")
    raw = F.transform(
        raw,
        lambda p, i: F.when(
            i == 0, strip(F.regexp_replace(strip(F.regexp_replace(p, LEAD_CLAUSE, "")), LEAD_CLAUSE_ZH, ""))
        ).otherwise(p),
    )
    return bind(F.filter(raw, lambda p: F.length(p).between(2, 60)), _enumeration)


def _enumeration(items: Column) -> Column:
    digits = F.size(F.filter(items, lambda p: p.rlike(r"\d")))
    words = F.size(F.filter(items, lambda p: p.rlike(f"[A-Za-z{CJK}]")))
    return F.struct(items.alias("items"), ((digits >= 2) & (words >= 2)).alias("mixed"))


def _unit(sid: Column, kind: str | Column, role: str | Column, text: Column, conf: Column, reasons: Column) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        sid.cast("string").alias("sentence_id"), lit(kind).alias("unit_type"), lit(role).alias("semantic_role"), text.alias("text"),
        conf.cast("double").alias("confidence"), reasons.cast(STR_ARRAY).alias("reasons"),
    )


def _reasons(*rs: str) -> Column:
    return F.array(*[F.lit(r) for r in rs])


def sentence_unit(sid: Column, s: Column) -> Column:
    """X11/X12 for one sentence: enumerative fact, mixed fragment or plain fragment.

    Three items need two separators, so most sentences are plain without being lower-cased or cut.
    """
    plain = _unit(sid, "fragment", "non_fact", s, F.lit(0.2), _reasons("non_enumerative"))

    def judged(e: Column) -> Column:
        return F.when(F.size(e["items"]) < 3, plain).otherwise(bind(F.lower(s), lambda low: _sentence_unit(sid, s, low, e, plain)))

    return F.when(F.regexp_count(s, F.lit(ENUM_SIGNAL)) < 2, plain).otherwise(bind(enumeration_items(s), judged))


def _sentence_unit(sid: Column, s: Column, low: Column, e: Column, plain: Column) -> Column:
    refers = any_contains(low, ["as follows", "respectively", "listed below"])
    mixed = _unit(sid, "fragment", "non_fact", s, F.lit(0.2), _reasons("cross_semantic_mixed"))
    good = _unit(sid, "sentence_enumerative", "enumerative_fact", s, F.lit(0.85), empty())
    return F.when(_discursive(low) | _blocking(low), plain).when(e["mixed"], mixed).when(refers, plain).otherwise(good)


def evidence_units(block_id: Column, c: Column, section: Column, list_items: Column) -> Column:
    """Sentence units; only without a primary one: blocked fragment, list items or one fragment."""
    sents = F.transform(split_units(c), lambda s, i: F.struct(F.concat(block_id, F.lit("#s"), i.cast("string")).alias("sid"), s.alias("s")))
    units = F.transform(sents, lambda x: sentence_unit(x["sid"], x["s"]))
    listed = F.filter(F.transform(list_items, strip), lambda x: x != "")
    return bind(F.struct(units.alias("u"), listed.alias("i")), lambda b: _units_of_block(b["u"], c, section, b["i"]))


def _units_of_block(units: Column, c: Column, section: Column, items: Column) -> Column:
    """The section is asked for, and the text lower-cased, only where no sentence is a primary unit."""
    primary = F.exists(units, lambda u: u["unit_type"] == "sentence_enumerative")
    extra = bind(F.struct(section.alias("s"), F.lower(c).alias("low")), lambda b: _extra_units(c, b["low"], b["s"], items))
    return F.concat(units, F.when(primary, F.array().cast(f"array<{UNIT}>")).otherwise(extra))


def _extra_units(c: Column, low: Column, section: Column, items: Column) -> Column:
    none = F.lit(None)
    blocked_by = (
        F.when(section.isin("figure", "table", "supplementary"), F.array(F.concat(F.lit("section_excluded:"), section)))
        .when(_discursive(low), _reasons("discourse_list")).when(_blocking(low), _reasons("procedural_or_metadata"))
    )
    blocked = F.array(_unit(none, "fragment", "non_fact", c, F.lit(0.1), blocked_by))

    def item_unit(x: Column) -> Column:
        xl = F.lower(x)
        disc, block = xl.rlike(DISCOURSE), xl.rlike(BLOCKING)
        fact = ~disc & ~block & x.rlike(f"[A-Za-z{CJK}]") & (F.length(x) <= 120)
        why = (
            F.when(disc, _reasons("discourse_list")).when(block, _reasons("procedural_or_metadata"))
            .when(~fact, _reasons("non_enumerative")).when(F.length(x) < 3, _reasons("insufficient_specificity")).otherwise(empty())
        )
        conf = F.when(fact & (F.size(why) == 0), 0.65).otherwise(0.25)
        return _unit(none, "list_item", F.when(fact, "enumerative_fact").otherwise("non_fact"), x, conf, why)

    factual = ~any_contains(low, ["we ", "our ", "study", "analysis", "method", "supplementary"]) & low.rlike(f"[a-z{CJK}]")
    single = F.array(
        _unit(
            none, "fragment", F.when(factual, "descriptive_fact").otherwise("non_fact"), c, F.lit(0.2),
            F.when(factual, _reasons("non_enumerative")).otherwise(_reasons("insufficient_specificity")),
        )
    )
    return F.when(blocked_by.isNotNull(), blocked).when(F.size(items) > 0, F.transform(items, item_unit)).otherwise(single)


def injectable(u: Column) -> Column:
    """X12."""
    return (
        (u["semantic_role"] == "enumerative_fact") & u["unit_type"].isin("sentence_enumerative", "list_item") & (F.size(u["reasons"]) == 0)
    )


def simple_facts(units: Column) -> Column:
    """Injectable enumerations, or punctuated sentences of 12-360 characters that are not excluded."""
    def keep(u: Column) -> Column:
        barred = F.exists(u["reasons"], lambda r: F.startswith(r, F.lit("section_excluded:")) | (r == "procedural_or_metadata"))
        sentence = F.length(u["text"]).between(12, 360) & u["text"].rlike(r"[.!?。！？]\s*$")
        return ((u["unit_type"] == "sentence_enumerative") & injectable(u)) | (~barred & sentence)

    return F.array_distinct(F.transform(F.filter(units, keep), lambda u: strip(u["text"])))


def sentence_table(df: DataFrame, block_id: str, text: str) -> DataFrame:
    """``(block_id, sentence_id, offset, text)``."""
    out = explode_rows(df, [block_id], units_at(F.col(text)), "i", "s")
    return out.select(
        block_id, F.concat(F.col(block_id).cast("string"), F.lit("#s"), F.col("i").cast("string")).alias("sentence_id"),
        F.col("s.offset").alias("offset"), F.col("s.text").alias("text"),
    )


# --- Sidecar facts and schema text (X14-X16) ----------------------------------------------
def sidecar_facts(block_id: Column, pairs: Column, primary: Column, is_definition: Column, text: Column, fills: Column) -> Column:
    """Abbreviation 0.9, definition 0.7, slot fill 0.6; distinct within the block.

    ``fills`` is an array of struct(slot, value).
    """
    def fact(ev: Column, kind: str, s: Column, p: Column, o: Column, conf: float) -> Column:
        return F.struct(
            ev.alias("evidence_id"), F.lit(kind).alias("type"), s.alias("subject"), p.alias("predicate"), o.alias("object"),
            F.lit(conf).alias("confidence"),
        )

    bid = block_id.cast("string")
    abbr = F.transform(
        F.filter(pairs, lambda p: (strip(p["abbr"]) != "") & (strip(p["full"]) != "")),
        lambda p: fact(F.concat(bid, F.lit("::abbr::"), p["abbr"]), "abbreviation", p["abbr"], F.lit("stands_for"), p["full"], 0.9),
    )
    subject = F.coalesce(F.get(F.filter(F.transform(pairs, lambda p: strip(p["full"])), lambda f: f != ""), 0), primary)
    definition = F.when(
        is_definition & (F.coalesce(subject, F.lit("")) != ""),
        F.array(fact(F.concat(bid, F.lit("::def::"), subject), "definition", subject, F.lit("is_defined_as"), squash(text), 0.7)),
    ).otherwise(F.slice(abbr, 1, 0))
    slot = F.when(
        F.coalesce(subject, F.lit("")) != "",
        F.transform(
            F.filter(fills, lambda x: x["value"] != ""),
            lambda x: fact(F.concat(bid, F.lit("::slot::"), x["slot"]), "slot_fill", subject, F.concat(F.lit("has_"), x["slot"]), x["value"], 0.6),
        ),
    ).otherwise(F.slice(abbr, 1, 0))
    every = F.concat(abbr, definition, slot)
    return distinct_by(every, lambda f: F.struct(f["type"], f["subject"], f["predicate"], f["object"]))


# Schema field, cue pattern on lower-cased text, rendered note.
SCHEMA_NOTES = [
    ("transmission_primary", "tick|蜱|叮咬", "tick bite (蜱叮咬)"),
    ("transmission_secondary", "human-to-human|person-to-person|人传人", "human-to-human transmission (人传人)"),
    ("transmission_secondary", "body fluid|blood|体液|血液", "contact with blood/body fluids (血液/体液接触)"),
    ("transmission_secondary", "aerosol|droplet|airborne|气溶胶|飞沫", "respiratory droplets/aerosol (飞沫/气溶胶)"),
    ("pathogenesis_notes", "cytokine|细胞因子", "cytokines / cytokine storm (细胞因子/风暴)"),
    ("pathogenesis_notes", "immun|免疫", "immune response/dysregulation (免疫反应/失衡)"),
    ("pathogenesis_notes", f"interferon|{BOUND_L}ifn{BOUND_R}|干扰素", "interferon/IFN signaling (干扰素通路)"),
    ("pathogenesis_notes", "inflammation|inflammatory|炎症", "inflammation / hyperinflammation (炎症/过度炎症)"),
    ("pathogenesis_notes", "mods|multi-organ|多器官|器官功能衰竭", "multi-organ dysfunction (MODS/多器官功能障碍)"),
]
SCHEMA_FIELDS = ["transmission_primary", "transmission_secondary", "pathogenesis_notes"]


def schema_blocks(df: DataFrame, key: str, text: str, ord_col: str) -> DataFrame:
    """One schema row per key.

    A note can occur once per field, so the group is reduced to the first position of
    each of the nine notes by partial aggregates; texts never travel.
    """
    low = F.lower(F.col(text))
    firsts = [F.min(F.when(low.rlike(rx), F.struct(F.col(ord_col).alias("o"), F.lit(i).alias("i")))).alias(f"n{i}") for i, (_, rx, _) in enumerate(SCHEMA_NOTES)]
    g = df.groupBy(key).agg(*firsts)
    cols = []
    for field in SCHEMA_FIELDS:
        cells = [
            F.when(F.col(f"n{i}").isNotNull(), F.struct(F.col(f"n{i}.o").alias("o"), F.lit(i).alias("i"), F.lit(note).alias("t")))
            for i, (f, _, note) in enumerate(SCHEMA_NOTES) if f == field
        ]
        cols.append(F.transform(F.array_sort(F.array_compact(F.array(*cells))), lambda s: s["t"]).alias(field))
    return g.select(key, *cols)


def schema_text(*, max_items: int = 3) -> Column:
    """Compact constraint text of one schema row."""
    def fmt(field: str) -> Column:
        return F.when(F.size(field) == 0, "N/A").otherwise(F.array_join(F.slice(field, 1, max_items), "; "))

    parts = [F.lit("Confirmed evidence slots (do NOT treat as a full answer; do NOT invent new facts):\n")]
    for f in SCHEMA_FIELDS:
        parts += [F.lit(f"- {f}: "), fmt(f), F.lit("\n")]
    return F.concat(*parts)


# --- Symptom filter and enumerations (X20, X21) --------------------------------------------
# Symptom cues, terms and excluded passages.
SYMPTOM_CUES = ["symptom", "clinical feature", "manifestation"]
SYMPTOM_TERMS = ["fever", "thrombocytopenia", "bleeding", "fatigue", "vomiting", "diarrhea"]
PATIENT_PATTERNS = r"patients?\s+.*present\s+with|characterized\s+by|including\s+.*\b(fever|thrombocytopenia|bleeding|fatigue|vomiting|diarrhea)\b"
# One of these is in every text that the patterns match.
PATIENT_HEADS = ["patient", "characterized", "including"]
EXCLUDED = [
    "supplementary", "table", "figure", "statistical analysis", "copyright", "methods", "p value", "confidence interval",
    "in addition,", "moreover,",
]


def _patients(low: Column) -> Column:
    return any_contains(low, PATIENT_HEADS) & low.rlike(PATIENT_PATTERNS)


def symptom_items(items: Column) -> Column:
    keep = lambda x: bind(F.lower(x), lambda low: any_contains(low, SYMPTOM_CUES + SYMPTOM_TERMS) | _patients(low))
    return F.array_distinct(F.filter(F.transform(items, strip), lambda x: (x != "") & keep(x)))


def symptom_filter(text: Column, items: Column, is_list: Column) -> Column:
    """struct(reason, items). The cue is sought in windows of one sentence either side."""
    from ..functions.sentences import split_ascii

    kept = symptom_items(items)
    return bind(F.struct(split_ascii(text).alias("s"), F.lower(text).alias("low")), lambda b: bind(kept, lambda k: _symptom_verdict(text, b["low"], b["s"], k, is_list)))


def _symptom_verdict(text: Column, low: Column, s: Column, kept: Column, is_list: Column) -> Column:
    n = F.size(s)
    wins = F.when(n == 0, F.array(text)).otherwise(
        F.transform(s, lambda x, i: F.array_join(F.slice(s, F.greatest(i, F.lit(1)), F.when(i == 0, 2).otherwise(3)), " "))
    )
    # No window holds a word that the text does not; a cue of two words may meet at the blank between sentences.
    hopeful = any_contains(low, [w.split(" ")[0] for w in SYMPTOM_CUES] + PATIENT_HEADS)
    cue = hopeful & F.exists(wins, lambda w: bind(F.lower(w), lambda lw: any_contains(lw, SYMPTOM_CUES) | _patients(lw)))
    why = None
    for e in EXCLUDED:
        c = F.contains(low, F.lit(e))
        why = F.when(c, f"excluded:{e}") if why is None else why.when(c, f"excluded:{e}")
    why = why.when(~is_list, "missing_structure").when(~cue, "missing_symptom_cue").when(F.size(kept) == 0, "list_items_not_symptom").otherwise("ok")
    return F.struct(why.alias("reason"), F.when(why == "ok", kept).otherwise(empty()).alias("items"))


def enumeration_tail(c: Column) -> Column:
    """Symptom-like items of a sentence."""
    t = strip(F.regexp_replace(strip(c), LEAD_CLAUSE, ""))
    t = F.regexp_replace(t, rf"(?i){BOUND_L}(and|or){BOUND_R}", ",")
    parts = F.transform(F.filter(F.split(t, "[;,]"), lambda p: strip(p) != ""), lambda p: F.btrim(p, F.lit(" .;:,")))
    return symptom_items(F.filter(parts, lambda p: F.length(p).between(2, 60)))


def symptom_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """X20, X21 by row: verdict with its items, number of sentences, and the symptoms enumerated in any sentence (repeats over sentences stay)."""
    from ..functions.sentences import split_ascii

    c = F.col(text)

    def of(b: Column) -> Column:
        tail = F.flatten(F.transform(b["s"], enumeration_tail))
        verdict = bind(list_like_items(c, b["low"]), lambda a: bind(symptom_items(a), lambda k: _symptom_verdict(c, b["low"], b["s"], k, F.size(a) > 0)))
        return F.struct(verdict.alias("r"), F.size(b["s"]).alias("n"), tail.alias("tail"))

    r = df.select(key, bind(F.struct(split_ascii(c).alias("s"), F.lower(c).alias("low")), of).alias("e"))
    return r.select(key, "e.r.reason", "e.r.items", F.col("e.n").alias("n_sentences"), "e.tail")


# --- Quotes, abbreviations in answers, nested annotations (X22, X24, X26) -------------------
def valid_quote(quote: Column, source: Column, squashed: Column | None = None) -> Column:
    """Sentence-like, 20-800 characters, present verbatim or up to whitespace.

    ``squashed`` is the source with its white space collapsed, where a caller has it for many quotes of one source.
    """
    from ..functions.noise import is_low_value_sentence


    def of(q: Column) -> Column:  # the shape first: it is cheap and most pieces fail it
        shape = F.length(q).between(20, 800) & (q.rlike(r"[.!?。！？]$") | (F.length(q) >= 80))
        return (q != "") & shape & ~is_low_value_sentence(q) & (F.contains(source, q) | F.contains(squash(source) if squashed is None else squashed, squash(q)))

    return bind(strip(quote), of)


def plausible_expansion(full: Column, abbr: Column) -> Column:
    low = F.lower(full)
    words = F.filter(F.split(squash(full), " "), lambda w: w.rlike(f"^[{WORD}]+$") & ~F.contains(w, F.lit("_")))
    return (
        (full != "") & ~low.rlike("^(abstract|keywords|introduction)") & ~low.rlike(" (is|are|was|were|caused by) ")
        & (F.size(words) >= 2) & (F.length(full) >= F.length(abbr) + 4)
    )


def expansion_score(full: Column) -> Column:
    n = F.size(F.filter(F.split(squash(full), " "), lambda w: w != ""))
    return n * 2 - F.when(n > 12, 2).otherwise(0)


def best_expansion(pairs: Column, abbr: Column) -> Column:
    """X24 from metadata pairs: plausible, confident, best score, first wins ties."""
    up = F.upper(strip(abbr))
    ok = F.filter(
        pairs,
        lambda p: (F.upper(p["abbr"]) == up) & (F.length(p["abbr"]) >= 3) & plausible_expansion(p["full"], up)
        & (F.length(F.get(F.split(F.lower(squash(p["full"])), " "), 0)) >= 4) & (p["confidence"] >= 0.85),
    )
    scored = F.transform(ok, lambda p, i: F.struct((-expansion_score(p["full"])).alias("neg"), i.alias("i"), p["full"].alias("full")))
    return F.coalesce(F.array_min(scored)["full"], F.lit(""))


def expansion_in_text(text: Column, abbr: str) -> Column:
    """X24 from text: Full (ABBR), else ABBR (Full)."""
    import re

    a = re.escape(abbr.upper())
    t = squash(text)
    trim = lambda c: F.btrim(c, F.lit(" ,;:.-"))
    f1 = trim(F.regexp_extract(t, rf"([A-Za-z][A-Za-z0-9\-\s]{{5,120}})\s*\(\s*{a}\s*\)", 1))
    f2 = trim(F.regexp_extract(t, rf"{BOUND_L}{a}{BOUND_R}\s*\(\s*([A-Za-z][A-Za-z0-9\-\s]{{5,120}})\)", 1))
    up = F.lit(abbr.upper())
    return F.when(plausible_expansion(f1, up), f1).when(plausible_expansion(f2, up), f2).otherwise("")


def nested_answers(short: Column, long: Column) -> Column:
    """Short answers first, then long ones; blank-free, ordered, distinct."""
    flat = F.concat(F.flatten(short), long)
    return F.array_distinct(F.filter(F.transform(flat, strip), lambda x: x.isNotNull() & (x != "")))


def evidence_rows(blocks: DataFrame, block_id: str, sentences: Column) -> DataFrame:
    """One row for every evidence sentence of a block, numbered from 1 in its id; blank ones take a number but no row."""
    rows = explode_rows(blocks, [block_id], sentences, "_i", "text")
    named = rows.select(F.concat(F.col(block_id), F.lit("::ev"), (F.col("_i") + 1).cast("string")).alias("evidence_id"), block_id, strip(F.col("text")).alias("text"))
    return named.where("text <> ''")


def quote_counts(source: Column, quotes: Column) -> Column:
    """X22 for all quotes of a source: struct(valid, n), decided inside the row with the source squashed once."""

    def count(q: Column, flat: Column) -> Column:
        return F.struct(F.size(F.filter(q, lambda x: valid_quote(x, source, flat))).cast("bigint").alias("valid"), F.size(q).cast("bigint").alias("n"))

    return bind(squash(source), lambda flat: bind(quotes, lambda q: count(q, flat)))
