"""Settings: one frozen tree, layered keyword arguments > environment > YAML file > defaults."""

from __future__ import annotations

import dataclasses
import os
import re
from dataclasses import dataclass, field, fields
from typing import Any

ENV = "TIDEMARK_"


@dataclass(frozen=True)
class Index:
    timezone: str = "America/New_York"
    low_confidence: float = 0.60
    recent_days: int = 1


@dataclass(frozen=True)
class Lede:
    flat: float = 5
    mild: float = 15
    moderate: float = 35
    change_min_delta: float = 5
    lookback_days: int = 5
    min_headlines: int = 5


@dataclass(frozen=True)
class Explain:
    background_days: int = 30
    min_headlines: int = 8
    min_cluster_size: int = 3
    cluster_purity: float = 0.70
    cluster_distance: float = 0.6
    min_term_headlines: int = 2
    name_terms: int = 3
    ngram_lo: int = 1
    ngram_hi: int = 2
    min_df: int = 2
    oov_warn: float = 0.20
    #: Path of a kept vocabulary that themes use instead of a fit of their window; empty for none.
    vocabulary: str = ""


@dataclass(frozen=True)
class Gates:
    staleness_hours: float = 36
    single_source_share: float = 0.70
    low_confidence_rate: float = 0.50


@dataclass(frozen=True)
class Report:
    negative: int = 3
    positive: int = 3
    neutral: int = 2


@dataclass(frozen=True)
class Split:
    train: float = 0.70
    val: float = 0.15
    test: float = 0.15
    seed: int = 42

    def __post_init__(self):
        if abs(self.train + self.val + self.test - 1) > 1e-9:
            raise ValueError("split ratios must sum to 1")


@dataclass(frozen=True)
class Model:
    repo: str = "local/rules"
    revision: str = "0" * 40
    batch_size: int = 32
    lexicon_positive: float = 0.05
    lexicon_negative: float = -0.05

    def __post_init__(self):
        if not re.fullmatch("[0-9a-f]{40}", self.revision):
            raise ValueError("the model revision must be a full 40-digit commit hash")

    @property
    def id(self) -> str:
        return f"{self.repo}@{self.revision}"


@dataclass(frozen=True)
class Settings:
    index: Index = field(default_factory=Index)
    lede: Lede = field(default_factory=Lede)
    explain: Explain = field(default_factory=Explain)
    gates: Gates = field(default_factory=Gates)
    report: Report = field(default_factory=Report)
    split: Split = field(default_factory=Split)
    model: Model = field(default_factory=Model)


def _cast(kind: str, value: Any) -> Any:
    return {"int": int, "float": float, "str": str}[kind](value)


def load(path: str | None = None, env: dict[str, str] | None = None, **overrides: dict[str, Any]) -> Settings:
    """``overrides`` are sections: load(index={"timezone": "UTC"}). Environment: TIDEMARK_INDEX__TIMEZONE=UTC."""
    env = dict(os.environ) if env is None else env
    from_file: dict[str, dict] = {}
    if path:
        import yaml

        with open(path, encoding="utf-8") as f:
            from_file = yaml.safe_load(f) or {}
    default = Settings()
    known = {s.name for s in fields(default)}
    if unknown := (set(from_file) | set(overrides)) - known:
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    sections = {}
    for s in fields(default):
        part = getattr(default, s.name)
        kinds = {f.name: f.type for f in fields(part)}
        values = dict(from_file.get(s.name, {}))
        for name in kinds:
            if (key := f"{ENV}{s.name}__{name}".upper()) in env:
                values[name] = env[key]
        values |= overrides.get(s.name, {})
        if extra := set(values) - set(kinds):
            raise ValueError(f"unknown settings in {s.name}: {sorted(extra)}")
        sections[s.name] = dataclasses.replace(part, **{k: _cast(kinds[k], v) for k, v in values.items()})
    return Settings(**sections)
