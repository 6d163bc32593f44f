"""Slot-value cleaning and deletion-only type guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chars import CJK
from ..functions.rows import explode_rows
from ..functions.text import bind, strip
from .extract import BOUND_L, BOUND_R, _split_in_order, any_contains

# Default cleaning rules per semantic type.
VALUE_RULES = {
    "generic": {"normalize": {}, "split": {"connectors": [",", ";", " and ", " with ", " of "]}, "filter": {"deny_terms": []}},
    "drug": {"normalize": {}, "split": {"connectors": [",", ";"]}, "filter": {"deny_terms": []}},
    "location": {
        "normalize": {
            "strip_prefixes": [
                r"^(the\s+imported\s+cases\s+were\s+distributed\s+in\s+)", r"^(the\s+cases\s+were\s+distributed\s+in\s+)",
                r"^(imported\s+cases\s+were\s+distributed\s+in\s+)", r"^(cases\s+were\s+distributed\s+in\s+)",
            ],
            "strip_suffixes": [
                r"\s*\(\s*\d+\s+cases?\s*\)\s*$", r"\s*\(\s*n\s*=\s*\d+\s*\)\s*$", r"\s+with\s+one\s+case\s+each\.?$",
                r"\s+with\s+\d+\s+cases?\b.*$", r"\s+\(with\s+\d+\s+cases?\)\b.*$",
            ],
        },
        "split": {"connectors": [",", ";", " and ", "、", "，", "；", "及", "以及"]},
        "filter": {"deny_terms": ["distributed", "imported", "cases", "case ", "one case", "each"]},
    },
    "symptom": {
        "normalize": {
            "thrombocytopenia": ["platelet counts", "low platelet", "decreased platelets", "low platelet counts"],
            "leukopenia": ["decreased white blood cell", "low white blood cell", "decreased wbc", "low wbc"],
            "leukocytopenia": ["leucocytopenia"],
        },
        "split": {"connectors": [" of ", " and ", " with "]},
        "filter": {"deny_terms": ["no ", "without ", "absence of ", "clear mind", "conscious", "alert"]},
    },
}
_META = ("regex_subs", "strip_prefixes", "strip_suffixes")

# What cannot be a location, symptom or drug.
NOT_LOCATION = [
    "however", "moreover", "in addition", "since currently", "method", "methods", "results", "discussion", "abstract",
    "keywords", "introduction", "conclusion", "figure", "fig", "table", "supplementary", "copyright", "p.r.",
]
CLAUSE_WORDS = [
    " is ", " are ", " was ", " were ", " be ", " been ", " being ", " have ", " has ", " had ", " show", " indicate", " suggest",
    " report", " distribute", " occur", " detect", " classify", " carry", " transmit", " analyze", " investigation", " surveillance",
    " prevalence", " genotype", " virus", " tick", " antibody", " clinical", " symptom",
]
SYMPTOM_WORDS = [
    "fever", "thrombocytopenia", "leukocytopenia", "bleeding", "hemorrhag", "vomit", "diarrhea", "fatigue", "headache", "nausea",
    "rash", "pain", "myalgia", "cough", "dyspnea", "neurolog", "gastro", "thrombo", "leuko",
]
NOT_DRUG = [
    "therefore", "however", "currently", "among", "of", "them", "including", "and", "or", "in", "this", "study", "the",
    "specimens", "oral", "sera",
]
KNOWN_DRUGS = ["ribavirin", "favipiravir", "remdesivir", "oseltamivir", "baloxavir", "acyclovir"]
# What names a place, in a location and (fewer) in a symptom.
LOCATION_PLACES = "province|city|county|district|state|region|prefecture|municipality|island|islands|mountain|mountains"
SYMPTOM_PLACES = "province|city|county|district|state|region|prefecture"


def _word(rx: str) -> str:
    return f"{BOUND_L}({rx}){BOUND_R}"


# What each type refuses and takes, the first rule that holds decides, none of them refuses. A rule is
# (test, argument, verdict); tests: longer (characters), is and has (words, lower case), low and raw (pattern in lower case
# or as written), lacks (no such pattern as written).
GUARD_RULES: dict[str, list[tuple[str, object, bool]]] = {
    "location": [
        ("longer", 64, False),
        ("is", NOT_LOCATION, False),
        ("raw", r"[.:;?!\x{ff0f}/\\]|http|www", False),
        ("raw", r"\d", False),
        ("low", f"^(and|or|but|while|with|without|including|such as){BOUND_R}", False),
        ("has", CLAUSE_WORDS, False),
        ("raw", f"(?s)^(?=.*[{CJK}]).*(省|市|县|区|州|盟|旗|镇|乡|村|岛|山|湖|河)$", True),
        ("raw", f"(?s)^(?=.*[{CJK}]).{{1,12}}$", True),
        ("raw", f"[{CJK}]", False),
        ("lacks", "[A-Z]", False),
        ("low", _word(LOCATION_PLACES), True),
        ("raw", r"^[A-Z][A-Za-z'\-]+(?:\s+[A-Z][A-Za-z'\-]+){0,3}$", True),
    ],
    "symptom": [
        ("longer", 80, False),
        ("has", ["http", "www", "doi", "figure", "table", "supplementary", "copyright"], False),
        ("low", r"(?s)^(?!.*covid).*\d", False),
        ("raw", "[:;]", False),
        ("low", rf"{BOUND_L}p\s*[<=](?=[\p{{L}}\p{{N}}_])|{BOUND_L}ci{BOUND_R}|{BOUND_L}confidence interval{BOUND_R}", False),
        ("low", f"(reported in|distributed in|found in|occurred in){BOUND_R}", False),
        ("raw", "地区|区域|地域|省|市|我国|中国|国内|分布|流行", False),
        ("low", _word(SYMPTOM_PLACES), False),
        ("low", _word("genotype|lineage|clade|family|phenuiviridae|bunyaviridae|nairoviridae"), False),
        ("low", _word("pcr|elisa|assay|kit|diagnos|specimen|samples?"), False),
        ("has", SYMPTOM_WORDS, True),
        ("low", "(itis|emia|osis|algia|uria|pathy|pnea|rrhea)$", True),
        ("low", _word("is|are|was|were|be|been|being|have|has|had"), False),
        ("raw", r"^\S*(?:\s+\S*){0,3}$", True),
    ],
    "drug": [
        ("longer", 64, False),
        ("has", ["http", "www", "doi", "figure", "table", "supplementary"], False),
        ("raw", "[:;。，]", False),
        ("low", _word("reported in|distributed in|province|city|county|region"), False),
        ("raw", "地区|省|市|我国|中国|分布", False),
        ("has", ["fever", "symptom", "thrombocytopenia", "bleeding", "diarrhea", "vomit"], False),
        ("low", _word("treatment|therapy|therapeutic|approved|approval|fda"), False),
        ("is", NOT_DRUG, False),
        ("raw", " ", False),
        ("low", "penia$", False),
        ("low", r"^(ifn|interferon)[\-\s]?(alpha|beta|gamma|λ|lambda)?$", True),
        ("low", r"^ifn[\-\s]?(α|β|γ|lambda|λ)$", True),
        ("lacks", r"^[A-Za-z][A-Za-z0-9\-+/]*$", False),
        ("low", "(vir|mab|nib|ciclovir|statin|mycin|pril|sartan|azole|caine|prazole|dine|dronate)$", True),
        ("is", KNOWN_DRUGS, True),
    ],
}


def guard(kind: str):
    """The rules of a type as a test of a value; blank values are refused."""

    def accepts(v: Column) -> Column:
        low = F.lower(v)
        tests = {
            "longer": lambda n: F.length(v) > n, "is": lambda ws: low.isin(ws), "has": lambda ws: any_contains(low, ws), "low": low.rlike, "raw": v.rlike,
            "lacks": lambda rx: ~v.rlike(rx),
        }
        out = F.when(v == "", False)
        for test, argument, verdict in GUARD_RULES[kind]:
            out = out.when(tests[test](argument), verdict)
        return out.otherwise(False)

    return accepts


is_location, is_symptom, is_drug = (guard(kind) for kind in ("location", "symptom", "drug"))
GUARDS = {"location": is_location, "symptom": is_symptom, "drug": is_drug}


def normalize_value(v: Column, norm: dict) -> Column:
    """Regex substitutions, prefixes, suffixes, then the canonical map (exact, case-insensitive)."""
    for sub in norm.get("regex_subs", []):
        flags = "(?i)" if "IGNORECASE" in sub.get("flags", []) else ""
        v = F.regexp_replace(v, flags + sub["pattern"], sub.get("repl", ""))
    for rx in [*norm.get("strip_prefixes", []), *norm.get("strip_suffixes", [])]:
        v = F.regexp_replace(v, "(?i)" + rx, "")
    v = strip(v)
    out = None
    for canon, variants in norm.items():
        if canon in _META:
            continue
        same = F.lower(v).isin([x.lower() for x in [canon, *variants]])
        out = F.when(same, canon) if out is None else out.when(same, canon)
    return v if out is None else out.otherwise(v)


def clean_values(values: Column, semantic_type: str, rules: dict | None = None) -> Column:
    """struct(cleaned_values, removed_values, normalized, split) for one semantic type."""
    from .extract import merge_rules

    rules = rules or merge_rules(VALUE_RULES["generic"], VALUE_RULES.get(semantic_type, {}), concat_top_lists=True)
    raw = F.filter(F.transform(values, strip), lambda v: v != "")
    norm = F.transform(raw, lambda v: normalize_value(v, rules.get("normalize", {})))
    return bind(norm, lambda n: _cleaned(n, semantic_type, rules))


def _cleaned(norm: Column, semantic_type: str, rules: dict) -> Column:
    deny = [t.lower() for t in rules.get("filter", {}).get("deny_terms", []) if t]
    accepts = GUARDS.get(semantic_type)

    def judged(v: Column) -> Column:  # each part is split off and judged once
        kept = F.when(accepts(v) if accepts else F.lit(True), "kept").otherwise("fallen")
        return F.struct(v.alias("v"), (F.when(any_contains(F.lower(v), deny), "denied").otherwise(kept) if deny else kept).alias("as"))

    def told(parts: Column) -> Column:
        of = lambda kind: F.transform(F.filter(parts, lambda p: p["as"] == kind), lambda p: p["v"])
        return F.struct(
            F.array_distinct(F.filter(of("kept"), lambda v: v != "")).alias("cleaned_values"), F.concat(of("denied"), of("fallen")).alias("removed_values"),
            norm.alias("normalized"), F.transform(parts, lambda p: p["v"]).alias("split_values"),
        )

    return bind(F.transform(_split_in_order(norm, rules.get("split", {}).get("connectors", [])), judged), told)


def cleaned_counts(rows: DataFrame, values: str, types: tuple[str, ...]) -> DataFrame:
    """(semantic_type, kept, removed) over all rows; the values of a row are made once and cleaned for every type."""

    def counted(v: Column, kind: str) -> Column:
        return bind(clean_values(v, kind), lambda r: F.struct(F.lit(kind).alias("semantic_type"), F.size(r["cleaned_values"]).alias("kept"), F.size(r["removed_values"]).alias("removed")))

    cells = bind(F.col(values), lambda v: F.array(*[counted(v, kind) for kind in types]))
    each = explode_rows(rows, [], cells, "c").select("c.*")
    return each.groupBy("semantic_type").agg(F.sum("kept").alias("kept"), F.sum("removed").alias("removed"))
