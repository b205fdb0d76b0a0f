"""The provider contract, its registry, and a deterministic provider that needs no model."""

from __future__ import annotations

import re
import zlib
from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

QUERY, DOCUMENT = "query", "document"
_REGISTRY: dict[str, type[EmbeddingProvider]] = {}


def register(name: str):
    """Class decorator: a stored configuration of type ``name`` gives this provider."""

    def keep(cls):
        cls.type_name = name
        _REGISTRY[name] = cls
        return cls

    return keep


def provider_from_config(config: dict | None) -> EmbeddingProvider | None:
    if config is None:
        return None
    if (cls := _REGISTRY.get(config.get("type"))) is None:
        raise ValueError(f"Unknown embedding provider {config.get('type')!r}; registered: {', '.join(sorted(_REGISTRY))}")
    return cls(**{k: v for k, v in config.items() if k != "type"})


class EmbeddingProvider(ABC):
    """Subclasses embed checked, non-empty batches; keys and secrets never belong to the configuration."""

    type_name = ""
    batch_size = 64

    def config(self) -> dict:
        return {"type": self.type_name, **self.parameters()}

    def parameters(self) -> dict:
        return {}

    @abstractmethod
    def embed_batch(self, texts: list[str], kind: str) -> list[list[float]]: ...

    def embed(self, texts: list[str], kind: str = DOCUMENT) -> list[list[float]]:
        """A vector for each text, in order. A lone string and blank texts are errors; no texts give no vectors."""
        if isinstance(texts, str):
            raise TypeError("embed takes a list of strings, not one string")
        if blank := [i for i, t in enumerate(texts) if not t or not t.strip()]:
            raise ValueError(f"blank texts can't be embedded; positions: {blank}")
        out: list[list[float]] = []
        for at in range(0, len(texts), self.batch_size):
            part = texts[at : at + self.batch_size]
            vectors = self.embed_batch(part, kind)
            if len(vectors) != len(part):
                raise ValueError(f"{len(part)} texts gave {len(vectors)} vectors")
            out += vectors
        return out

    def dimension(self) -> int:
        return len(self.embed(["probe"])[0])


@register("hashing")
class HashingEmbedding(EmbeddingProvider):
    """Words hashed to signed dimensions, scaled to length 1. Equal texts have equal vectors everywhere."""

    batch_size = 1024

    def __init__(self, dim: int = 64):
        self.dim = dim

    def parameters(self) -> dict:
        return {"dim": self.dim}

    def embed_batch(self, texts: list[str], kind: str) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts):
            for word in re.findall(r"\w+", text.lower()) or [text]:
                h = zlib.crc32(word.encode())
                row[h % self.dim] += 1 if h & 0x80000000 else -1
            row /= np.sqrt((row * row).sum()) or 1
        return out.tolist()


def embed_column(text: Column, provider: EmbeddingProvider, kind: str = DOCUMENT) -> Column:
    """Vectors of a column, in Arrow batches; the provider is built once a task. Null texts have null vectors."""
    config = provider.config()

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = provider_from_config(config)
        for s in batches:
            out = pd.Series([None] * len(s), index=s.index, dtype=object)
            given = s[s.notna()]
            if len(given):
                out[given.index] = pd.Series(own.embed(given.tolist(), kind), index=given.index)
            yield out

    return run(text)
