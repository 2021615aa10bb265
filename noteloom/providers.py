"""Embedding and text providers, called from pandas functions in batches."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class EmbeddingProvider(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class TextProvider(Protocol):
    def complete(self, prompt: str) -> str: ...


class HashedWords:
    """Deterministic vectors of hashed words: a stand-in without a network."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dimension
            for word in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[h % self.dimension] += 1.0 if h >> 63 else -1.0
            size = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / size for x in v])
        return out


_PROVIDERS: dict[str, Callable[..., EmbeddingProvider]] = {"hashed-words": HashedWords}


def register(name: str, make: Callable[..., EmbeddingProvider]) -> None:
    _PROVIDERS[name] = make


def provider(name: str, **options) -> EmbeddingProvider:
    if name not in _PROVIDERS:
        raise ValueError(f"no embedding provider is named {name}")
    return _PROVIDERS[name](**options)


def embedded(text: Column, source: EmbeddingProvider) -> Column:
    """struct(vec, error) of texts. A batch that fails is tried again text by
    text, so a bad text costs no other its vector; its error stays with it.
    Both are null for a null text."""

    def one(t: str) -> dict:
        try:
            return {"vec": list(source.embed([t])[0]), "error": None}
        except Exception as e:
            return {"vec": None, "error": f"{type(e).__name__}: {e}"}

    @F.pandas_udf("vec array<float>, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            some = [t for t in texts if t is not None]
            try:
                found = [{"vec": list(v), "error": None} for v in source.embed(some)] if some else []
                if len(found) != len(some):
                    raise ValueError(f"{len(found)} vectors for {len(some)} texts")
            except Exception:
                found = [one(t) for t in some]
            left = iter(found)
            yield pd.DataFrame([{"vec": None, "error": None} if t is None else next(left) for t in texts], columns=["vec", "error"])

    return run(text)


def embed(text: Column, source: EmbeddingProvider) -> Column:
    """Vectors of texts; null for null texts and those that fail."""
    return embedded(text, source)["vec"]


def rewrite(raw: DataFrame, source: TextProvider, prompt: str, most: int = 4000) -> DataFrame:
    """rel, hash, text, error of raw(rel, hash, content); errors stay in their row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for rel, digest, content in zip(batch["rel"], batch["hash"], batch["content"], strict=True):
                try:
                    rows.append((rel, digest, source.complete(prompt.format(content=(content or "")[:most])), None))
                except Exception as e:
                    rows.append((rel, digest, None, str(e)))
            yield pd.DataFrame(rows, columns=["rel", "hash", "text", "error"])

    return raw.select("rel", "hash", "content").mapInPandas(run, "rel string, hash string, text string, error string")


def expansions(reply: Column) -> Column:
    """The first three lines with text of a reply, 120 characters each; none
    for a null reply."""
    lines = F.transform(F.split(F.coalesce(reply, F.lit("")), "\n"), lambda line: F.left(F.regexp_replace(line, r"^\s+|\s+$", ""), F.lit(120)))
    return F.slice(F.filter(lines, lambda line: line != ""), 1, 3)
