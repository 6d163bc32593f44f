"""Default entity types, relation types, layer ranges and intents."""

# Entity types.
ENTITY_TYPES = ["pathogen", "disease", "symptom", "drug", "mechanism", "anatomy", "lab_value", "epidemiology"]

# Relation, its inverse, the query intents it serves.
RELATIONS = [
    ("causes", "caused_by", ["symptom", "mechanism", "pathogenesis"]),
    ("caused_by", "causes", ["etiology", "mechanism"]),
    ("treats", "treated_by", ["drug", "treatment", "therapy"]),
    ("treated_by", "treats", ["drug", "treatment"]),
    ("manifests_as", "manifestation_of", ["symptom", "clinical"]),
    ("manifestation_of", "manifests_as", ["symptom", "clinical"]),
    ("is_a", "has_subtype", ["definition", "identity", "classification"]),
    ("has_subtype", "is_a", ["definition", "classification"]),
    ("part_of", "has_part", ["anatomy", "structure"]),
    ("has_part", "part_of", ["anatomy", "structure"]),
    ("located_in", "location_of", ["location", "distribution", "epidemiology"]),
    ("location_of", "located_in", ["location"]),
    ("inhibits", "inhibited_by", ["mechanism", "drug"]),
    ("inhibited_by", "inhibits", ["mechanism", "drug"]),
    ("associated_with", "associated_with", []),
    ("transmits_via", "transmission_route_for", ["transmission", "epidemiology", "prevention"]),
    ("transmission_route_for", "transmits_via", ["transmission", "epidemiology"]),
    ("prevents", "prevented_by", ["prevention", "treatment"]),
    ("prevented_by", "prevents", ["prevention"]),
]

# Relation -> (first layer, last layer).
LAYER_RANGES = {
    "is_a": (0, 7), "has_subtype": (0, 7), "also_known_as": (0, 7), "has_molecular_weight": (0, 7),
    "utilizes": (0, 7), "detects": (0, 7),
    "causes": (8, 15), "caused_by": (8, 15), "manifests_as": (8, 15), "manifestation_of": (8, 15),
    "leads_to": (8, 15), "associated_with": (8, 15),
    "treats": (12, 19), "treated_by": (12, 19), "prevents": (12, 19), "prevented_by": (12, 19),
    "diagnosed_by": (12, 19),
    "located_in": (4, 11), "location_of": (4, 11), "part_of": (4, 11), "has_part": (4, 11),
    "transmits_via": (4, 11), "transmission_route_for": (4, 11), "distributed_in": (4, 11),
    "inhibits": (8, 15), "inhibited_by": (8, 15),
}
ANCHOR_LAYERS = (0, 3)
DEFAULT_LAYERS = (0, 7)

# Relation -> verb used in the rendered sentence.
RELATION_VERBS = {
    "causes": "导致", "caused_by": "由…引起", "treats": "治疗", "treated_by": "被…治疗",
    "manifests_as": "表现为", "manifestation_of": "是…的表现", "is_a": "属于", "has_subtype": "包括",
    "part_of": "是…的一部分", "has_part": "包含", "located_in": "分布于", "location_of": "是…的分布区",
    "inhibits": "抑制", "inhibited_by": "被…抑制", "transmits_via": "经…传播",
    "transmission_route_for": "是…的传播途径", "prevents": "预防", "prevented_by": "被…预防",
    "associated_with": "与…相关", "also_known_as": "又称", "distributed_in": "分布于",
    "has_molecular_weight": "分子量约为", "utilizes": "利用", "detects": "检测",
}

# Query intent -> keywords, first maximum wins.
INTENT_KEYWORDS = {
    "symptom": ["症状", "表现", "临床", "symptom", "sign", "表征", "不适", "起病"],
    "drug": ["药物", "治疗", "drug", "treatment", "therapy", "用药", "给药", "法匹拉韦"],
    "mechanism": ["机制", "mechanism", "pathway", "通路", "过程", "原理", "发病机制"],
    "transmission": ["传播", "transmission", "传染", "途径", "感染途径", "蜱虫"],
    "definition": ["是什么", "定义", "什么是", "identity", "属于", "缩写", "全称"],
    "epidemiology": ["流行", "分布", "epidemiology", "prevalence", "发病率", "流行病学"],
    "prevention": ["预防", "prevention", "防控", "防护"],
    "location": ["部位", "位置", "location", "anatomy", "器官"],
    "etiology": ["病因", "病原", "etiology", "原因", "致病"],
}


def intent_relations(intent: str) -> list[str]:
    """Relations serving an intent, in relation order."""
    return [r for r, _, served in RELATIONS if intent and intent.lower() in served]
