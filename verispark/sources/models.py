"""Which model a check uses: the environment first, then a model named for the check, then its tier."""

from __future__ import annotations

import os
from dataclasses import dataclass
from typing import Any

from verispark.sources.config import PREFIX

NONE = "none"
DETERMINISTIC = "deterministic"


@dataclass(frozen=True)
class Choice:
    check: str
    tier: str
    primary: tuple[str, str]
    fallback: tuple[str, str] | None

    @property
    def deterministic(self) -> bool:
        return self.primary[0] == NONE


def parse(ref: str) -> tuple[str, str]:
    """provider:model or provider/model; a name alone is a model without a provider."""
    for sep in (":", "/"):
        if sep in ref:
            provider, model = ref.split(sep, 1)
            return provider.strip(), model.strip()
    return NONE, ref.strip() or DETERMINISTIC


def tiers(config: dict[str, Any] | None = None, env: dict[str, str] | None = None) -> dict[str, tuple[str, str]]:
    """Tier to (provider, model); ``cheap`` is always there.  VERISPARK_TIER__<NAME> wins over the configuration."""
    env = dict(os.environ) if env is None else env
    named = {"cheap": {}} | (config or {}).get("tiers", {})
    out = {}
    for name, spec in named.items():
        own = env.get(f"{PREFIX}TIER__{name.upper()}")
        out[name] = parse(own) if own else ((spec or {}).get("provider", NONE), (spec or {}).get("model", DETERMINISTIC))
    return out


def resolve(check: str, config: dict[str, Any] | None = None, env: dict[str, str] | None = None) -> Choice:
    """The chain of one check.  A fallback that equals the first choice is none."""
    env = dict(os.environ) if env is None else env
    spec = ((config or {}).get("checks") or {}).get(check) or {}
    known = tiers(config, env)
    tier = spec.get("tier", "cheap")
    own = env.get(f"{PREFIX}MODEL__{check}")
    if own:
        first = parse(own)
    elif spec.get("provider") and spec.get("model"):
        first = (spec["provider"], spec["model"])
    else:
        first = known.get(tier, known["cheap"])
    second = known.get(spec["fallback"]) if spec.get("fallback") else None
    return Choice(check, tier, first, None if second == first else second)
