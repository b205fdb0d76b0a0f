"""Providers behind an HTTP interface or an optional package. All need a network or a package that may be missing."""

from __future__ import annotations

import json
import os
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable

from tidemark.embed.provider import QUERY, EmbeddingProvider, register

#: Tries and seconds that a batch may take; the shortest wait.
TRIES, BUDGET, SHORTEST = 20, 180.0, 0.1


def duration_seconds(text: str | None) -> float | None:
    """1m0.612s, 20ms, 3 and the like in seconds."""
    if not text or not re.fullmatch(r"(?:[\d.]+(?:h|ms|m|s)?)+", text.strip()):
        return None
    unit = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 0.001, "": 1.0}
    return sum(float(n) * unit[u] for n, u in re.findall(r"([\d.]+)(h|ms|m|s|)", text.strip()) if n)


def rate_limit_wait(headers: dict, message: str) -> float:
    """Seconds to wait after a refusal: a quarter of what the headers say, else what the message says, else 1."""
    waits = [w for k, v in headers.items() if k.lower() in ("retry-after", "x-ratelimit-reset-requests", "x-ratelimit-reset-tokens") and (w := duration_seconds(v)) is not None]
    if waits:
        return max(SHORTEST, max(waits) / 4)
    found = re.search(r"try again in ([\d.hms]+)", message)
    return max(SHORTEST, (duration_seconds(found[1].rstrip(".")) if found else None) or 1.0)


def post(url: str, body: dict, headers: dict, timeout: float = 60) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.load(answer)


def patiently(call: Callable[[], dict], wait: Callable[[int, dict, str], float], sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> dict:
    """``call``, again after each 429 while tries and time last; other errors at once."""
    began = clock()
    for n in range(TRIES):
        try:
            return call()
        except urllib.error.HTTPError as e:
            pause = wait(n, dict(e.headers or {}), e.read().decode(errors="replace") if e.fp else "")
            if e.code != 429 or n + 1 == TRIES or clock() - began + pause > BUDGET:
                raise
            sleep(pause)
    raise AssertionError


class HttpEmbedding(EmbeddingProvider):
    base_url, key_name, model = "", "", ""

    def __init__(self, model: str | None = None, base_url: str | None = None, batch_size: int | None = None, prompts: dict | None = None, **extra):
        self.model, self.base_url = model or self.model, (base_url or self.base_url).rstrip("/")
        self.batch_size, self.prompts, self.extra = batch_size or self.batch_size, prompts or {}, extra

    def parameters(self) -> dict:
        return {"model": self.model, "base_url": self.base_url, "batch_size": self.batch_size, "prompts": self.prompts, **self.extra}

    def headers(self) -> dict:
        key = os.environ.get(self.key_name) if self.key_name else None
        return {"Authorization": f"Bearer {key}"} if key else {}

    def body(self, texts: list[str], kind: str) -> dict:
        return {"model": self.model, "input": texts, **self.extra}

    def read(self, answer: dict) -> list[list[float]]:
        return [x["embedding"] for x in sorted(answer["data"], key=lambda x: x["index"])]

    def wait(self, n: int, headers: dict, message: str) -> float:
        return rate_limit_wait(headers, message)

    path = "/embeddings"

    def embed_batch(self, texts: list[str], kind: str) -> list[list[float]]:
        texts = [self.prompts.get(kind, "") + t for t in texts]
        return self.read(patiently(lambda: post(self.base_url + self.path, self.body(texts, kind), self.headers()), self.wait))


@register("openai")
class OpenAIEmbedding(HttpEmbedding):
    base_url, key_name, model, batch_size = "https://api.openai.com/v1", "OPENAI_API_KEY", "text-embedding-3-small", 20


@register("cohere")
class CohereEmbedding(HttpEmbedding):
    base_url, key_name, model, batch_size, path = "https://api.cohere.com/v2", "COHERE_API_KEY", "embed-v4.0", 96, "/embed"

    def body(self, texts: list[str], kind: str) -> dict:
        role = "search_query" if kind == QUERY else "search_document"
        return {"model": self.model, "texts": texts, "input_type": role, "embedding_types": ["float"], **self.extra}

    def read(self, answer: dict) -> list[list[float]]:
        return answer["embeddings"]["float"]

    def wait(self, n: int, headers: dict, message: str) -> float:
        return min(60.0, 2.0**n)


@register("nvidia")
class NvidiaEmbedding(HttpEmbedding):
    base_url, key_name, model, batch_size = "https://integrate.api.nvidia.com/v1", "NVIDIA_API_KEY", "nvidia/llama-3.2-nv-embedqa-1b-v2", 20

    def body(self, texts: list[str], kind: str) -> dict:
        return {"model": self.model, "input": texts, "input_type": "query" if kind == QUERY else "passage", "truncate": "NONE", **self.extra}


@register("ollama")
class OllamaEmbedding(HttpEmbedding):
    base_url, model, batch_size = "http://localhost:11434/v1", "nomic-embed-text", 20


@register("sentence_transformers")
class SentenceTransformersEmbedding(EmbeddingProvider):
    batch_size = 64

    def __init__(self, model: str = "all-MiniLM-L6-v2", prompts: dict | None = None, device: str | None = None):
        self.name, self.prompts, self.device, self._model = model, prompts or {}, device, None

    def parameters(self) -> dict:
        return {"model": self.name, "prompts": self.prompts, "device": self.device}

    def embed_batch(self, texts: list[str], kind: str) -> list[list[float]]:
        if self._model is None:
            try:
                from sentence_transformers import SentenceTransformer
            except ImportError as e:
                raise ImportError("install sentence-transformers for this provider") from e
            self._model = SentenceTransformer(self.name, device=self.device)
        return self._model.encode([self.prompts.get(kind, "") + t for t in texts], batch_size=self.batch_size).tolist()
