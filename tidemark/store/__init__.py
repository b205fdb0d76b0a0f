"""Versioned stores of chunked documents."""

from tidemark.store.store import IngestSummary, Store

__all__ = ["IngestSummary", "Store"]
