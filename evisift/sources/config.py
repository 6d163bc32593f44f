"""Small configuration files read on the driver."""

from __future__ import annotations

import json
from pathlib import Path

from ..functions import taxonomy
from ..operators.extract import LIST_RULES, merge_rules
from ..operators.values import VALUE_RULES


def load_json(path: str | Path, default):
    """A missing or unreadable file means the default."""
    p = Path(path)
    try:
        return json.loads(p.read_text(encoding="utf-8")) if p.exists() else default
    except ValueError:
        return default


def load_relations(path: str | None = None) -> list[tuple[str, str, list[str]]]:
    """Configured relation types, or the built-in 19."""
    raw = load_json(path, None) if path else None
    if not isinstance(raw, dict):
        return list(taxonomy.RELATIONS)
    return [(k, v.get("inverse", ""), list(v.get("retrieval_intents") or [])) for k, v in raw.items()]


def load_rules(folder: str | None, semantic_type: str, kind: str) -> dict:
    """``kind`` is ``list`` or ``value``; YAML files override the built-in rules."""
    built_in = LIST_RULES if kind == "list" else VALUE_RULES
    generic, specific = built_in["generic"], built_in.get(semantic_type, {})
    if folder:
        import yaml

        def read(name: str, fallback: dict) -> dict:
            p = Path(folder) / f"{name}.yaml"
            got = yaml.safe_load(p.read_text(encoding="utf-8")) if p.exists() else None
            return got if isinstance(got, dict) else fallback

        generic, specific = read("generic", generic), read(semantic_type, specific)
    return merge_rules(generic, specific, concat_top_lists=kind == "value")


def load_sidecar(spark, folder: str) -> dict:
    """Alias map, triggers and fixed entities as dictionary tables; a missing file is empty."""
    base = Path(folder)
    alias = load_json(base / "alias_map.json", {})
    trig = load_json(base / "schema_triggers.json", {})
    fixed = load_json(base / "fixed_entities.json", {})
    as_list = lambda v: [str(x) for x in v] if isinstance(v, list) else [str(v)]
    return {
        "abbrs": spark.createDataFrame([(k, as_list(v)) for k, v in alias.items()], "term string, expansions array<string>"),
        "triggers": spark.createDataFrame([(k, as_list(v)) for k, v in trig.items()], "term string, slots array<string>"),
        "fixed": spark.createDataFrame([(k, str(v)) for k, v in fixed.items()], "term string, canonical string"),
    }


def load_contracts(path: str) -> list[dict]:
    """List form, or the legacy form with hard and soft id lists."""
    raw = load_json(path, [])
    if isinstance(raw, dict) and "patterns" in raw:
        raw = raw["patterns"]
    if isinstance(raw, dict):  # legacy
        ids = [(i, "hard") for i in raw.get("hard", [])] + [(i, "soft") for i in raw.get("soft", [])]
        return [{"pattern_id": i, "forms": [], "slots": [], "schema": i.startswith("schema:"), "level": lvl} for i, lvl in ids]
    out = []
    for c in raw:
        sk = c.get("question_skeleton") or {}
        forms = sk.get("surface_forms", []) if isinstance(sk, dict) else sk
        slots = c.get("slots") or {}
        is_schema = str(c["pattern_id"]).startswith("schema:") or any(str(s.get("inference_level", "")).lower() == "schema" for s in slots.values())
        out.append({"pattern_id": c["pattern_id"], "forms": [forms] if isinstance(forms, str) else list(forms), "slots": list(slots), "schema": is_schema})
    return out
