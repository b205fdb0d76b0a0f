"""Ingesting a stream of documents into a store."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.store import IngestSummary, Store


def duplicate_origins(df: DataFrame) -> DataFrame:
    """Rows (origin, times) of the origins that a batch has more than once."""
    return df.where(F.col("origin").isNotNull()).groupBy("origin").agg(F.count("*").alias("times")).where("times > 1")


def stream_ingest(
    source: DataFrame, store: Store, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None, seen: Callable[[IngestSummary], None] | None = None
) -> StreamingQuery:
    """Start a query that upserts each micro-batch of ``source`` (origin, content) once available, then ends.

    A batch that a restart replays finds its documents unchanged and skips them, so the effect is exactly once. An error, such as an
    origin twice in a batch, ends the query; batches committed before it stay.
    """

    def write(batch: DataFrame, _: int) -> None:
        summary = store.refresh().ingest(batch, prepare)
        if seen:
            seen(summary)

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _mark(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n = sum(len(b) for b in batches)
    before = state.get[0] if state.exists else 0
    state.update((before + n,))
    if before + n > 1:
        yield pd.DataFrame({"origin": [key[0]], "times": [before + n]})


def stream_duplicates(source: DataFrame) -> DataFrame:
    """Rows (origin, times) of every origin that comes again, over the whole stream: one counter a key as state."""
    rows = source.where(F.col("origin").isNotNull()).select("origin")
    return rows.groupBy("origin").applyInPandasWithState(_mark, "origin string, times long", "n long", "update", GroupStateTimeout.NoTimeout)
