"""Settings (SRC-25): from keyword arguments, else environment variables of the same name with the prefix CODELOOM_."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Settings:
    """allowed_roots limits what may be registered (empty: everything); the rest are sizes and depths of the plans."""

    allowed_roots: tuple[str, ...] = field(default_factory=tuple)
    dimensions: int = 64
    top_k: int = 10
    impact_depth: int = 3
    history_limit: int = 50
    log_limit: int = 50

    @staticmethod
    def from_env(**given) -> Settings:
        for f in fields(Settings):
            raw = os.environ.get(f"CODELOOM_{f.name.upper()}")
            if raw is not None and f.name not in given:
                given[f.name] = tuple(x for x in raw.split(",") if x) if f.name == "allowed_roots" else int(raw)
        return Settings(**given)
