"""Thresholds of the checks; a JSON overlay may replace any of them."""

from __future__ import annotations

import copy
import hashlib
import json
import re

# The defaults of every check.
DEFAULTS: dict = {
    "input": {"max_bytes": 33554432, "max_depth": 32, "max_nodes": 200000, "max_string": 10000, "max_array": 2000, "model": "1"},
    "validity": {"min_distance": 0.5, "lattice": [1.0, 100.0], "angles": [15.0, 165.0], "density": [0.5, 25.0], "occupancy_tolerance": 0.02, "metric_length": 0.01, "metric_angle": 0.5, "max_combinations": 20000, "neutrality_level": "warning"},
    "feasibility": {"threshold": 0.067, "atmospheres": ["air", "H2"], "temperature": 1273.15, "frame_limit": 600.0, "reactive": ["H2", "forming_gas", "NH3", "O2", "air", "CO2"]},
    "routes": {"max_routes": 3, "low_force": 0.05},
    "reward": {"id": "gated_mean@1.0", "unknown": 0.5, "weights": {"composition_valid": 0.25, "structure_valid": 0.20, "novelty": 0.25, "feasibility": 0.15, "claims_supported": 0.15}},
    "evidence": {"only": None, "offline": True},
}
SECRET = re.compile(r"key|secret|token|password", re.I)


def merge(base: dict, over: dict) -> dict:
    """Deep merge: objects are merged, everything else replaced."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def redact(value: object, name: str = "") -> object:
    """The value without the content of fields whose name sounds like a credential."""
    if isinstance(value, dict):
        return {k: redact(v, k) for k, v in value.items()}
    if isinstance(value, list):
        return [redact(v, name) for v in value]
    return "[redacted]" if value is not None and SECRET.search(name) else value


def unknown(config: dict, known: dict, path: str = "") -> list[str]:
    """Dotted names of settings that the defaults do not have; credentials may stand anywhere, they are redacted."""
    out = []
    for k, v in config.items():
        if k not in known and SECRET.search(k):
            continue
        if k not in known:
            out.append(f"{path}{k}")
        elif isinstance(v, dict) and isinstance(known[k], dict):
            out += unknown(v, known[k], f"{path}{k}.")
    return sorted(out)


def resolve(path: str | None = None, **overrides: object) -> dict:
    """Defaults, then the JSON file, then overrides; a setting of the file that there is none of is an error."""
    config = DEFAULTS
    if path is not None:
        with open(path, encoding="utf-8") as f:
            overlay = json.load(f)
        if wrong := unknown(overlay, DEFAULTS):
            raise ValueError(f"unknown settings: {', '.join(wrong)}")
        config = merge(config, overlay)
    return merge(config, overrides)


def digest(config: dict) -> str:
    return hashlib.sha256(json.dumps(redact(config), sort_keys=True, separators=(",", ":")).encode()).hexdigest()
