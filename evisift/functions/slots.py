"""Fixed values and expressions for slot inference and fact types."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import WORD
from .text import bind, strip

# Question word -> slot.
QUESTION_SLOTS = [
    ("(how|怎么|如何).*(transmit|传播|spread)", "transmission"),
    ("(what|什么).*(cause|原因|机制|mechan)", "pathogenesis"),
    ("(what|哪些).*(symptom|症状|表现)", "clinical_features"),
    ("(how|怎么|如何).*(diagnos|诊断|检测)", "diagnosis"),
    ("(how|怎么|如何).*(treat|治疗|cure)", "treatment"),
    ("(what|哪些).*(risk|危险因素|风险)", "risk_factors"),
    ("(what|哪些).*(complicat|并发症)", "complications"),
    ("(what|多少).*(mortality|死亡率|fatality)", "prognosis"),
    ("(how|怎么).*(prevent|预防)", "prevention"),
]
# Concepts that become slots themselves (whole words).
CONCEPT_SLOTS = [
    r"risk\s*factor|危险因素|风险因素",
    "complicat[" + WORD + "]*|并发症",
    "incubation|潜伏期",
    "reservoir|宿主|动物宿主",
    "seroprevalence|血清阳性率",
    r"case\s*fatality|病死率",
    r"viral\s*load|病毒载量",
    r"immune\s*evasion|免疫逃逸",
    r"cytokine\s*storm|细胞因子风暴",
    "human-to-human|人传人",
]
# Fallback pattern -> slot.
FALLBACK_SLOTS = [
    ("transmission", "transmit|传播|spread|route|vector|tick|蜱"),
    ("pathogenesis", "pathogen|mechanism|发病机制|致病|cytokine|immun|inflam"),
    ("clinical_features", "symptom|症状|clinical|manifest|fever|sign"),
    ("diagnosis", "diagnos|检测|诊断|test|pcr|elisa|assay"),
    ("treatment", "treat|治疗|therap|drug|antivir|cure|药物"),
    ("epidemiology", "epidem|流行病|incidence|prevalence|outbreak"),
    ("disease_full_name", r"全称|全名|缩写|英文全称|stand\s*for|full\s*name"),
    ("geographic_distribution", "地区分布|分布在|哪些地方|哪里|在哪些省|china|province|geographic"),
    ("prevention", "prevent|预防|vaccine|vaccin|prophyla"),
    ("prognosis", "prognos|预后|outcome|mortality|survival"),
]
# Registry order of adjudicable slots.
SLOT_REGISTRY = [
    "transmission", "pathogenesis", "mechanism", "diagnosis", "prevention", "treatment", "epidemiology",
    "clinical_features", "risk_factors", "complications", "prognosis", "overview", "disease_full_name",
    "geographic_distribution",
]
# Fact type -> (pattern, domain prior allowed, speculation allowed).
FACT_TYPES = [
    ("taxonomy.definition", r"(全称|全名|缩写|展开|英文全称|full\s*name|stand\s*for|what\s+does\s+\w+\s+stand\s+for)", True, False),
    ("epidemiology.geography", "(哪些地方|哪里|在哪些省|地区分布|分布在|中国.*哪里|where.*china|geograph|province)", False, False),
]


def has_any(low: Column, alternatives: str) -> Column:
    """Does the lower-cased text match ``a|b|c``? Literals are plain substring tests; an
    alternative with a pattern in it is tried only where its literal head occurs."""
    out = F.lit(False)
    for alt in alternatives.split("|"):
        head = re.split(r"[\\\[(.*+?]", alt)[0]
        hit = F.contains(low, F.lit(head))
        out = out | (hit if head == alt else hit & low.rlike(alt))
    return out


def infer_slots(c: Column, low: Column | None = None) -> Column:
    """Union of question-word, concept and fallback slots, sorted. ``low`` is the lower-cased text, where a caller has it."""
    return bind(F.lower(strip(c)) if low is None else strip(low), _slots_of)


def _slots_of(low: Column) -> Column:
    cells = []
    for rx, slot in QUESTION_SLOTS:
        first, second = rx[1:-1].split(").*(")
        cells.append(F.when(has_any(low, first) & has_any(low, second) & low.rlike("(?d)" + rx), F.lit(slot)))
    for rx in CONCEPT_SLOTS:
        m = F.when(has_any(low, rx), F.regexp_extract(low, f"(?<![{WORD}])({rx})(?![{WORD}])", 1)).otherwise("")
        name = F.regexp_replace(F.regexp_replace(m, r"\s+", "_"), r"[^a-z0-9_\x{4e00}-\x{9fff}]", "")
        cells.append(F.nullif(name, F.lit("")))
    cells += [F.when(has_any(low, rx), F.lit(slot)) for slot, rx in FALLBACK_SLOTS]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*cells))))


def registered(found: Column) -> Column:
    """X04 from slots already inferred."""
    known = F.array(*[F.lit(s) for s in SLOT_REGISTRY])
    return bind(found, lambda fs: F.filter(known, lambda s: F.array_contains(fs, s)))


def registry_slots(c: Column, low: Column | None = None) -> Column:
    """Inferred slots that are registered, in registry order."""
    return registered(infer_slots(c, low))


def fact_types(c: Column) -> Column:
    """Q12: fact types asked for."""
    q = F.lower(strip(c))
    return F.array_compact(F.array(*[F.when(q.rlike("(?i)" + rx), F.lit(n)) for n, rx, _, _ in FACT_TYPES]))


def fact_policy(c: Column) -> Column:
    """Q12: (domain prior allowed, speculation allowed) over all asked fact types."""
    q = F.lower(strip(c))
    prior = spec = F.lit(True)
    for _, rx, allow_prior, allow_spec in FACT_TYPES:
        asked = q.rlike("(?i)" + rx)
        prior = prior & (~asked | F.lit(allow_prior))
        spec = spec & (~asked | F.lit(allow_spec))
    return F.struct(prior.alias("domain_prior"), spec.alias("speculative"))


def block_type(slots: Column, is_table: Column) -> Column:
    """Table first, then slots by priority."""
    has = lambda s: F.array_contains(slots, F.lit(s))
    return (
        F.when(is_table, "table").when(has("treatment"), "treatment").when(has("diagnosis"), "diagnosis")
        .when(has("transmission"), "transmission").when(has("pathogenesis") | has("mechanism"), "pathogenesis")
        .when(has("clinical_features"), "clinical_features").when(has("prevention"), "prevention").otherwise("general")
    )
