"""Configuration on the driver: YAML or dictionaries, environment expansion, presets, cohort manifests."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import os
import re

from .operators.rubric import PRESETS, SCALE, Preset


def expanded(x):
    """$NAME and ${NAME} in strings, recursively; an unset variable is an error."""
    if isinstance(x, dict):
        return {k: expanded(v) for k, v in x.items()}
    if isinstance(x, list):
        return [expanded(v) for v in x]
    return re.sub(r"\$\{?(\w+)\}?", lambda m: os.environ[m[1]], x) if isinstance(x, str) else x


def load(path: str) -> dict:
    """A YAML (if PyYAML is there) or JSON file, expanded; roles name endpoints and may override their fields."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        raw = json.loads(text)
    except ValueError:
        import yaml

        raw = yaml.safe_load(text)
    conf = expanded(raw)
    endpoints = conf.get("endpoints", {})
    for role, spec in conf.get("roles", {}).items():
        spec = {"endpoint": spec} if isinstance(spec, str) else spec
        conf.setdefault("resolved", {})[role] = endpoints[spec["endpoint"]] | {k: v for k, v in spec.items() if k != "endpoint"}
    return conf


def preset(spec: str | dict) -> Preset:
    """A named preset, or one from fractions; unknown fields are errors."""
    if isinstance(spec, str):
        return PRESETS[spec]
    exact = {k: round(v * SCALE) if isinstance(v, float) else v for k, v in spec.items()}
    return Preset(**exact)


def fingerprint(conf) -> str:
    plain = dataclasses.asdict(conf) if dataclasses.is_dataclass(conf) else conf
    return hashlib.sha1(json.dumps(plain, sort_keys=True).encode()).hexdigest()[:16]


def merged_manifest(old: dict | None, new: dict, allow_mismatch: bool = False) -> dict:
    """A cohort manifest with the new papers added in order; another recipe is an error unless allowed, then it goes to history."""
    if old is None:
        return {**new, "history": []}
    changed = [k for k in new if k not in ("paper_ids", "history") and old.get(k) != new[k]]
    if changed and not allow_mismatch:
        raise ValueError(f"the cohort was made with other settings: {changed}")
    history = old.get("history", []) + ([{k: old.get(k) for k in changed}] if changed else [])
    return {**old, **new, "paper_ids": list(dict.fromkeys([*old["paper_ids"], *new["paper_ids"]])), "history": history}
