"""The interval map as keyed state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.intervals import IntervalMap
from tidemark.plans.durable import parts_for

_STATE = "starts array<long>, ends array<long>, gap_starts array<long>, gap_ends array<long>"
#: Spans of a bounded stream that a key of the state has about, where entities are small.
GROUP_ROWS = 2_000


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = IntervalMap(*map(list, state.get)) if state.exists else IntervalMap()
    for pdf in batches:
        for s, e in zip(pdf["s"].tolist(), pdf["e"].tolist()):
            held.add(s, e)
    state.update((held.starts, held.ends, held.gap_starts, held.gap_ends))
    rows = [(key[0], "period", s, e) for s, e in held] + [(key[0], "gap", s, e) for s, e in held.gaps()]
    yield pd.DataFrame(rows, columns=["key", "kind", "range_start", "range_end"])


def stream_intervals(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """The periods and gaps of every entity touched by a micro-batch, as they are after it (update mode).

    The state is the entity's ordered starts and ends, and those of its gaps; each span goes in by binary search and changes the gaps
    beside it. Rows with a null key, null, negative, reversed or empty span change nothing; repeated rows change nothing.
    """
    s, e = F.col(start), F.col(end)
    good = df.where((s >= 0) & (s < e) & F.col(key).isNotNull())
    rows = good.select(F.col(key).alias("key"), s.cast("long").alias("s"), e.cast("long").alias("e"))
    return rows.groupBy("key").applyInPandasWithState(
        _update, "key string, kind string, range_start long, range_end long", _STATE, "update", GroupStateTimeout.NoTimeout
    )


def _update_group(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A key of the state holds the maps of the entities, each by its block, whose hash falls on it."""
    maps: dict[tuple[str, int], IntervalMap] = {}
    version = 0
    if state.exists:
        version, names, blocks, *lists = state.get
        maps = {(n, b): IntervalMap(*map(list, four)) for n, b, *four in zip(names, blocks, *lists)}
    touched = set()
    for pdf in batches:
        for k, b, s, e in zip(pdf["key"].tolist(), pdf["block"].tolist(), pdf["s"].tolist(), pdf["e"].tolist()):
            if (k, b) not in maps:
                maps[k, b] = IntervalMap()
            maps[k, b].add(s, e)
            touched.add((k, b))
    names, blocks = [k for k, _ in maps], [b for _, b in maps]
    state.update((version + 1, names, blocks, *([getattr(m, f) for m in maps.values()] for f in IntervalMap.__slots__)))
    out = [(k, b, "period", s, e) for k, b in touched for s, e in maps[k, b]] + [(k, b, "gap", s, e) for k, b in touched for s, e in maps[k, b].gaps()]
    frame = pd.DataFrame(out, columns=["key", "block", "kind", "s", "e"])
    frame["version"] = version + 1
    yield frame


def drain(spans: DataFrame, folder: str) -> DataFrame:
    """Stream a bounded table of spans (key, block, s, e) into keyed state; rows (key, block, kind, s, e): the state's periods and gaps at the end.

    Input, state and output lie in ``folder``, which all executors share. Spans of one entity and block meet in one map. Small
    entities share a key of the state by their hash, as a key costs more than a span; there are as many as make
    about ``GROUP_ROWS`` spans each, so an entity's block, of bounded width, is the most that a key must hold.
    """
    spark = spans.sparkSession
    spans.select("key", "block", "s", "e").write.parquet(f"{folder}/in")
    n = max(4 * parts_for(spark), spark.read.parquet(f"{folder}/in").count() // GROUP_ROWS)
    schema = T.StructType.fromDDL("key string, block long, s long, e long")
    grp: Column = F.pmod(F.xxhash64("key", "block"), F.lit(n)).alias("grp")
    state = "version long, names array<string>, blocks array<long>, " + ", ".join(f"{f} array<array<long>>" for f in IntervalMap.__slots__)
    kept = (
        spark.readStream.schema(schema).parquet(f"{folder}/in").withColumn("grp", grp).groupBy("grp")
        .applyInPandasWithState(_update_group, "key string, block long, kind string, s long, e long, version long", state, "append", GroupStateTimeout.NoTimeout)
    )
    run = kept.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    if run.exception() is not None:
        raise run.exception()
    found = spark.read.schema(T.StructType.fromDDL("key string, block long, kind string, s long, e long, version long")).parquet(f"{folder}/out")
    if found.where("version > 1").isEmpty():  # one micro-batch, as a bounded input is unless the session splits it
        return found.drop("version")
    last = found.groupBy("key", "block").agg(F.max("version").alias("version"))
    return found.join(last, ["key", "block", "version"]).drop("version")
