"""Configuration: typed sections with defaults, read from and written to files, merged recursively."""

from __future__ import annotations

import json
import logging
from dataclasses import asdict, dataclass, field, fields
from typing import Any

log = logging.getLogger("steploom")


@dataclass
class Retrieval:
    method: str = "hybrid"
    top_k: int = 5
    k_sparse: int = 50
    k_dense: int = 50
    rerank_top_n: int = 20
    alpha: float = 0.5


@dataclass
class Labels:
    n_rollouts: int = 5
    threshold: float = 0.5
    min_agreement: float = 0.8
    min_confidence: float = 0.7


@dataclass
class Search:
    max_children: int = 2
    max_depth: int = 7
    rollouts: int = 64
    exploration: float = 1.414
    discount: float = 0.9


@dataclass
class Config:
    retrieval: Retrieval = field(default_factory=Retrieval)
    labels: Labels = field(default_factory=Labels)
    search: Search = field(default_factory=Search)
    seed: int = 42


def merged(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """``base`` with the values of ``over``; sections are merged, anything else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def from_dict(values: dict[str, Any]) -> Config:
    """A configuration; keys it doesn't know are passed over with a warning."""
    made = {}
    for f in fields(Config):
        given = values.get(f.name)
        if isinstance(given, dict):
            section = f.default_factory  # type: ignore[misc]
            known = {x.name for x in fields(section)}
            for k in given.keys() - known:
                log.warning("unknown setting %s.%s", f.name, k)
            made[f.name] = section(**{k: v for k, v in given.items() if k in known})
        elif given is not None:
            made[f.name] = given
    for k in values.keys() - {f.name for f in fields(Config)}:
        log.warning("unknown setting %s", k)
    return Config(**made)


def load(path: str) -> Config:
    """From JSON, or from YAML where a YAML library is there."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    try:
        return from_dict(json.loads(text))
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as error:
            raise ValueError(f"{path} is no JSON, and no YAML library is installed") from error
        return from_dict(yaml.safe_load(text) or {})


def save(config: Config, path: str) -> None:
    with open(path, "w", encoding="utf-8") as file:
        json.dump(asdict(config), file, indent=2)
