"""A provider whose one dimension is the length of the text, for checks by hand and by SQL."""

from __future__ import annotations

from tidemark.embed.provider import DOCUMENT, EmbeddingProvider, register


@register("length")
class LengthEmbedding(EmbeddingProvider):
    batch_size = 4096

    def embed(self, texts: list[str], kind: str = DOCUMENT) -> list[list[float]]:
        """Blank texts have a length too."""
        return self.embed_batch(texts, kind)

    def embed_batch(self, texts: list[str], kind: str) -> list[list[float]]:
        return [[float(len(t))] for t in texts]
