"""Strict configuration: dataclasses filled from nested dicts, unknown keys and bad values refused."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace
from pathlib import Path
from typing import Any

from simlake.analyze.compare import CompareConfig
from simlake.analyze.duplicates import DuplicateConfig


@dataclass(frozen=True)
class ConcernsConfig:
    enabled: bool = False
    min_projection: float = 0.45
    top_units_per_concern: int = 50
    queries: tuple = ()


@dataclass(frozen=True)
class Config:
    """Everything a run needs."""

    source_dir: str | None = None
    projects: dict = field(default_factory=dict)
    store: str = "simlake-store"
    languages: tuple = ()
    exclude: tuple = ()
    retention: str = "report"
    min_body_nodes: int = 8
    max_body_chars: int = 10_000
    dimensions: int = 256
    page_size: int = 100_000
    analysis: DuplicateConfig = DuplicateConfig()
    concerns: ConcernsConfig = ConcernsConfig()
    comparison: CompareConfig = CompareConfig()

    def sources(self) -> dict[str, str]:
        """Label to source directory; a lone ``source_dir`` is project ``main``."""
        return {"main": self.source_dir} if self.source_dir else dict(self.projects)


class ConfigError(ValueError):
    """A setting that cannot be used."""


def _fill(kind: type, values: dict, where: str) -> Any:
    known = {f.name: f for f in fields(kind)}
    for name in values:
        if name not in known:
            raise ConfigError(f"unknown setting {where}{name}")
    base = kind()
    filled = {}
    for name, value in values.items():
        inner = getattr(base, name)
        filled[name] = _fill(type(inner), value or {}, f"{where}{name}.") if is_dataclass(inner) else tuple(value) if isinstance(inner, tuple) else value
    return kind(**filled)


def load(values: dict | None) -> Config:
    """A validated configuration from a nested dict."""
    config = _fill(Config, values or {}, "")

    def check(ok: bool, text: str) -> None:
        if not ok:
            raise ConfigError(text)

    check(bool(config.source_dir) != bool(config.projects), "give either source_dir or projects")
    for label in config.sources():
        check(bool(re.fullmatch(r"[A-Za-z0-9_-]+", label)), f"a project label has letters, digits, _ and - only: {label!r}")
    check(config.retention in ("full", "report", "minimal"), "retention is full, report or minimal")
    a, c, k = config.analysis, config.comparison, config.concerns
    check(0 < a.candidate_threshold <= a.similarity_threshold <= a.rerank_threshold <= 1.5, "thresholds must rise: 0 < candidate <= similarity <= rerank <= 1.5")
    check(min(a.block_size or 1, a.max_edges_per_unit, a.max_semantic_cluster_size) >= 1 and a.max_cluster_size >= 2, "sizes must be positive and clusters hold two units")
    check(0 < c.candidate_threshold <= c.match_threshold <= 1.5 and c.top_k_per_unit >= 1, "comparison needs 0 < candidate <= match <= 1.5 and top_k of at least 1")
    check(c.calibration in ("none", "background") and c.calibration_anchor in ("top1_p95", "same_name", "hybrid"), "unknown calibration")
    check(0 <= c.candidate_sigma_floor <= c.match_sigma_floor and c.strong_min_margin_sigma >= 0, "sigma floors must rise from 0")
    check((c.calibration_sample_pairs is None or 1 <= c.calibration_sample_pairs <= 1_000_000) and 0 <= c.abtt_components <= 64, "calibration sample or components out of range")
    check(-1 <= k.min_projection <= 1 and k.top_units_per_concern >= 1, "concern settings out of range")
    check(not k.enabled or bool(k.queries), "concerns need queries")
    names = [q["name"] for q in k.queries]
    check(len(names) == len(set(names)) and all(q.get("query", "").strip() for q in k.queries), "concern names must differ and queries not be empty")
    return config


#: Settings from the environment: SIMLAKE__COMPARISON__TOP_K_PER_UNIT=3 sets comparison.top_k_per_unit.
PREFIX = "SIMLAKE__"

TEMPLATE = """\
source_dir: .              # one project; or several, as label: folder
projects: {}
store: simlake-store
exclude: []
analysis:
  candidate_threshold: 0.70
  similarity_threshold: 0.81
  rerank_threshold: 0.85
concerns:
  enabled: false
  queries: []              # - {name: errors, query: retry after a failure}
comparison:
  candidate_threshold: 0.78
  match_threshold: 0.86
"""


def _read(text: str) -> Any:
    """YAML where a reader for it is installed, else JSON."""
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ConfigError(f"the settings cannot be read: {e}") from e


def load_file(path: str, environment: Mapping[str, str] = os.environ) -> Config:
    """A configuration from a file; folders are relative to it, and the environment overrides it."""
    file = Path(path)
    values = _read(file.read_text(encoding="utf-8")) or {}
    if not isinstance(values, dict):
        raise ConfigError("settings are names and values")
    for name in sorted(environment):
        if name.startswith(PREFIX):
            at, keys = values, name[len(PREFIX) :].lower().split("__")
            for key in keys[:-1]:
                at[key] = dict(at.get(key) or {})
                at = at[key]
            at[keys[-1]] = _read(environment[name])
    config = load(values)
    here = lambda p: p if "://" in p or os.path.isabs(p) else str((file.parent / p).resolve())
    return replace(config, source_dir=here(config.source_dir) if config.source_dir else None, projects={k: here(v) for k, v in config.projects.items()}, store=here(config.store))


def as_dict(config: Config) -> dict:
    return asdict(config)
