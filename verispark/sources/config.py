"""Configuration in layers: defaults, file, environment, arguments."""

from __future__ import annotations

import json
import os
from typing import Any

PREFIX = "VERISPARK_"
FILES = ["verispark.json", "verispark.yaml", "verispark.yml"]
DEFAULTS: dict[str, Any] = {
    "report_dir": "verispark-reports",
    "locale": "en",
    "fail_on": {"fairness_score_below": 70, "quality_score_below": 70, "drift_verdict_in": ["shifted"], "risk_tier_in": ["unacceptable"], "vendor_score_below": None, "residency_verdict_in": ["non_compliant"], "guard_blocks_above": None, "chain_violation": True},
}


def coerce(raw: str) -> Any:
    """true, false, null, numbers and JSON by their form; everything else is text."""
    words = {"true": True, "yes": True, "on": True, "false": False, "no": False, "off": False, "null": None, "none": None, "": None}
    if raw.strip().lower() in words:
        return words[raw.strip().lower()]
    try:
        return json.loads(raw)
    except ValueError:
        return raw


def merged(low: dict[str, Any], high: dict[str, Any]) -> dict[str, Any]:
    out = dict(low)
    for k, v in high.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def read_file(path: str) -> dict[str, Any]:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError(f"{path} needs a YAML library") from e
    return yaml.safe_load(text) or {}


def load(path: str | None = None, env: dict[str, str] | None = None, overrides: dict[str, Any] | None = None) -> tuple[dict[str, Any], str]:
    """The values and where they came from."""
    values, came = dict(DEFAULTS), ["defaults"]
    path = path or next((f for f in FILES if os.path.exists(f)), None)
    if path:
        values, came = merged(values, read_file(path)), [*came, path]
    own = {k[len(PREFIX) :].lower(): coerce(v) for k, v in (os.environ if env is None else env).items() if k.startswith(PREFIX)}
    if own:
        values, came = merged(values, own), [*came, "env"]
    if overrides:
        values, came = merged(values, overrides), [*came, "args"]
    return values, " → ".join(came)
