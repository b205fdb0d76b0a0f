"""Embedding providers: text in batches to vectors, and back from their stored configuration."""

from tidemark.embed.provider import DOCUMENT, QUERY, EmbeddingProvider, HashingEmbedding, embed_column, provider_from_config, register
from tidemark.embed import length, remote  # noqa: F401  register their providers

__all__ = ["DOCUMENT", "QUERY", "EmbeddingProvider", "HashingEmbedding", "embed_column", "provider_from_config", "register"]
