"""Settings of a knowledge base, from a YAML file."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

import yaml

from noteloom.functions.scoring import BASE_LAMBDA, FAILURE_CATEGORIES, FLOOR
from noteloom.functions.text import model_version
from noteloom.operators.recall import COOLDOWN_S, MOST_PICKED


@dataclass(frozen=True)
class Model:
    provider: str
    model: str
    api_key_env: str = ""


@dataclass(frozen=True)
class Source:
    type: str
    source: str = ""
    target: str = "raw/notes"
    module: str = ""


@dataclass(frozen=True)
class Recency:
    enabled: bool = True
    base_lambda: float = BASE_LAMBDA
    floor: float = FLOOR
    category_ratio: Mapping[str, float] | None = None
    evergreen: tuple[str, ...] = ()


@dataclass(frozen=True)
class Recall:
    failure_categories: tuple[str, ...] = FAILURE_CATEGORIES
    max_inject: int = MOST_PICKED
    min_score: float = 0.55
    decision_min_score: float = 0.5
    gate_cooldown_s: float = COOLDOWN_S


@dataclass(frozen=True)
class Config:
    domain: str
    embedding: Model
    llm: Model | None = None
    language: str = "en"
    adapters: tuple[Source, ...] = ()
    intent_patterns: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    recency: Recency = Recency()
    recall: Recall = Recall()

    def model_version(self, dimension: int) -> str:
        """The one name that writers and readers of vectors use."""
        return model_version(self.embedding.provider, self.embedding.model, dimension)


def _made(kind: type, data: Any, lenient: bool):
    """A settings object; lists become tuples. Unknown keys are dropped where
    lenient, else they raise."""
    known = {f.name for f in fields(kind)}
    given = {k: tuple(v) if isinstance(v, list) else v for k, v in (data or {}).items() if not lenient or k in known}
    return kind(**given)


def from_mapping(data: Mapping[str, Any]) -> Config:
    return Config(
        domain=data["domain"],
        embedding=_made(Model, data["embedding"], False),
        llm=_made(Model, data["llm"], False) if data.get("llm") else None,
        language=data.get("language", "en"),
        adapters=tuple(_made(Source, a, False) for a in data.get("adapters") or ()),
        intent_patterns={k: tuple(v) for k, v in (data.get("intent_patterns") or {}).items()},
        recency=_made(Recency, data.get("recency"), True),
        recall=_made(Recall, data.get("recall"), True),
    )


def from_yaml(path: str) -> Config:
    return from_mapping(yaml.safe_load(Path(path).read_text(encoding="utf-8")))
