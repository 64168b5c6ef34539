"""Typed settings, read from YAML: endpoints with their transforms, filters, caps and cutoffs."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

import yaml

TRANSFORMS = ("log10", "identity", "logit_pct")
SIGNS = (">=", "<=", ">", "<")


@dataclass(frozen=True)
class Endpoint:
    """One measured quantity: its raw column, modelling space, row filter, cap, and triage rule."""

    name: str
    column: str
    transform: str = "identity"
    unit: str = ""
    filter_column: str | None = None
    filter_pattern: str | None = None
    cap: float | None = None
    cutoff: float | None = None
    sign: str = ">="
    value_model: str = "forest"

    def __post_init__(self):
        if self.transform not in TRANSFORMS:
            raise ValueError(f"endpoint {self.name}: unknown transform {self.transform!r}")
        if self.sign not in SIGNS:
            raise ValueError(f"endpoint {self.name}: unknown sign {self.sign!r}")


@dataclass(frozen=True)
class Settings:
    """All that plans take from configuration; unknown top-level keys stay in `extra`."""

    endpoints: tuple[Endpoint, ...] = ()
    public_files: dict[str, list[str]] = field(default_factory=dict)
    best_origins: dict[str, list[str]] = field(default_factory=dict)
    groupings: dict[str, list[str]] = field(default_factory=dict)
    display_order: tuple[str, ...] = ()
    origin_min_n: int = 100
    group_folds: bool = True
    n_folds: int = 5
    seed: int = 42
    train_share: float = 0.7
    confidence_split: float = 0.5
    slope: float = 2.0
    run_ttl_minutes: int = 60
    max_runs: int = 50
    pins: dict[str, dict[str, int | None]] = field(default_factory=dict)
    extra: dict[str, Any] = field(default_factory=dict)

    def endpoint(self, name: str) -> Endpoint:
        for e in self.endpoints:
            if e.name == name:
                return e
        raise KeyError(name)

    def ordered(self) -> list[str]:
        """Endpoint names in display order, those it leaves out last."""
        names = [e.name for e in self.endpoints]
        return [x for x in self.display_order if x in names] + [x for x in names if x not in self.display_order]


def load_settings(path: str | Path) -> Settings:
    """Settings of a YAML file; an endpoint is a mapping of Endpoint's fields under its name."""
    data = yaml.safe_load(Path(path).read_text()) or {}
    known = {f.name for f in fields(Settings)} - {"extra"}
    values = {k: v for k, v in data.items() if k in known}
    if "endpoints" in values:
        values["endpoints"] = tuple(Endpoint(name=k, **v) for k, v in values["endpoints"].items())
    if "display_order" in values:
        values["display_order"] = tuple(values["display_order"])
    return Settings(**values, extra={k: v for k, v in data.items() if k not in known})
