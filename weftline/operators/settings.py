"""Settings on the driver: merging, stages, presets, shares."""

from __future__ import annotations

import json
from collections.abc import Mapping

STAGES = ("taxonomy", "prompts", "responses", "preferences", "judge", "filters", "review", "export")


def merged(base: Mapping, over: Mapping | None) -> dict:
    """``base`` with ``over`` laid on it, mappings by mapping; anything else is replaced."""
    out = dict(base)
    for k, v in (over or {}).items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def known(base: Mapping, over: Mapping | None) -> dict:
    """``merged`` with keys that ``base`` lacks left out."""
    return merged(base, {k: v for k, v in (over or {}).items() if k in base and v is not None})


def stages(spec: str) -> list[int]:
    """Stage numbers of a list such as 1,3-5 or names, in order, each once."""
    out: set[int] = set()
    for part in filter(None, (p.strip() for p in spec.split(","))):
        a, dash, b = part.partition("-")
        low = STAGES.index(a) + 1 if a in STAGES else int(a)
        high = (STAGES.index(b) + 1 if b in STAGES else int(b)) if dash else low
        if not 1 <= low <= high <= len(STAGES):
            raise ValueError(f"no such stages: {part}")
        out |= set(range(low, high + 1))
    return sorted(out)


def planned_rows(topics: int, subtopics: int, leaves: int, rows_per_leaf: int, depth: int = 3) -> int:
    return topics * (subtopics if depth > 2 else 1) * leaves * rows_per_leaf


def rebalanced(mix: Mapping[str, int], key: str, value: int) -> dict[str, int]:
    """Shares that sum to 100 after one is set: the others scale, the last of them takes the rest."""
    value = max(0, min(100, value))
    others = [k for k in mix if k != key]
    total, out, left = sum(mix[k] for k in others), {**mix, key: value}, 100 - value
    for k in others[:-1]:
        out[k] = max(0, min(left, round((mix[k] / total if total else 1 / len(others)) * (100 - value))))
        left -= out[k]
    if others:
        out[others[-1]] = max(0, left)
    return out


def load(text: str) -> dict:
    """Settings from a project file, or from the settings alone."""
    held = json.loads(text)
    return held["config"] if isinstance(held, dict) and isinstance(held.get("config"), dict) else held


# The four starting points of a project. A tree is topics, subtopics, leaves and rows a leaf.
PRESETS: dict[str, dict] = {
    "quick-sft": {"data_types": ["sft"], "taxonomy": {"topics": 7, "subtopics_per_topic": 3, "leaves_per_topic": 3, "rows_per_leaf": 8}, "export": {"formats": ["sft"]}, "judge": False},
    "dpo-corruptor": {"data_types": ["sft", "dpo"], "taxonomy": {"topics": 6, "subtopics_per_topic": 3, "leaves_per_topic": 4, "rows_per_leaf": 6}, "preferences": {"strategy": "corruptor"}, "export": {"formats": ["sft", "dpo"]}, "judge": True},
    "tool-calling-200": {"data_types": ["tools"], "taxonomy": {"topics": 5, "subtopics_per_topic": 2, "leaves_per_topic": 4, "rows_per_leaf": 5, "task_types": ["TRIAGE", "PROCEDURE", "DECIDE"]}, "responses": {"ensemble": [{"slug": "openai/gpt-4o", "temperature": 0.5}]}, "export": {"formats": ["tools"], "validate_template": "llama-3.1"}, "judge": False},
    "reasoning-traces": {"data_types": ["grpo"], "taxonomy": {"topics": 5, "subtopics_per_topic": 3, "leaves_per_topic": 4, "rows_per_leaf": 5, "task_types": ["EXPLAIN", "DECIDE", "PROCEDURE"]}, "responses": {"reasoning_tags": True, "max_tokens": 3072}, "export": {"formats": ["grpo"]}, "judge": False},
}


def preset(key: str, over: Mapping | None = None) -> dict:
    """A preset's settings with ``over`` laid on them; KeyError for an unknown one."""
    return merged(json.loads(json.dumps(PRESETS[key])), over)


def preset_rows(settings: Mapping) -> int:
    """Rows that a tree of these settings plans, before a negative branch."""
    tree = settings["taxonomy"]
    return planned_rows(tree["topics"], tree["subtopics_per_topic"], tree["leaves_per_topic"], tree["rows_per_leaf"])
