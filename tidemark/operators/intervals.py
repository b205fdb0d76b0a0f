"""Continuous periods and gaps of overlapping spans, by an ordered map of disjoint intervals per entity."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.durable import cut, shared_folder


class IntervalMap:
    """Disjoint half-open intervals in order, and the non-empty gaps between them. Intervals that merely touch stay apart."""

    __slots__ = ("starts", "ends", "gap_starts", "gap_ends")

    def __init__(self, starts: list[int] | None = None, ends: list[int] | None = None, gap_starts: list[int] | None = None, gap_ends: list[int] | None = None):
        self.starts: list[int] = starts if starts is not None else []
        self.ends: list[int] = ends if ends is not None else []
        self.gap_starts: list[int] = gap_starts if gap_starts is not None else []
        self.gap_ends: list[int] = gap_ends if gap_ends is not None else []

    def add(self, start: int, end: int) -> None:
        """Insert one interval: two binary searches find what it overlaps, which it replaces; two more, the gaps that it changes."""
        starts, ends = self.starts, self.ends
        lo, hi = bisect_right(ends, start), bisect_left(starts, end)
        if lo < hi:
            if starts[lo] <= start and end <= ends[lo]:
                return
            start, end = min(start, starts[lo]), max(end, ends[hi - 1])
        else:
            hi = lo
        before, after = lo - 1, hi
        fresh = []
        if before >= 0 and ends[before] < start:
            fresh.append((ends[before], start))
        if after < len(starts) and end < starts[after]:
            fresh.append((end, starts[after]))
        # The gaps from the interval before to the one after are the only ones that can change.
        i = bisect_left(self.gap_starts, ends[before]) if before >= 0 else 0
        j = bisect_left(self.gap_starts, starts[after]) if after < len(starts) else len(self.gap_starts)
        self.gap_starts[i:j], self.gap_ends[i:j] = [a for a, _ in fresh], [b for _, b in fresh]
        starts[lo:hi], ends[lo:hi] = [start], [end]

    def gaps(self) -> list[tuple[int, int]]:
        return list(zip(self.gap_starts, self.gap_ends))

    def __iter__(self) -> Iterator[tuple[int, int]]:
        return iter(zip(self.starts, self.ends))


def _frame(maps: dict[str, IntervalMap]) -> pd.DataFrame:
    keys, starts, ends = [], [], []
    for k, m in maps.items():
        keys += [k] * len(m.starts)
        starts += m.starts
        ends += m.ends
    return pd.DataFrame({"key": keys, "s": starts, "e": ends})


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merge what one input partition holds of each entity. Full maps are sent on early, so memory stays bounded."""
    maps: dict[str, IntervalMap] = {}
    held = 0
    for pdf in batches:
        for k, s, e in zip(pdf["key"].tolist(), pdf["s"].tolist(), pdf["e"].tolist()):
            maps.setdefault(k, IntervalMap()).add(s, e)
        held += len(pdf)
        if held > 1_000_000:
            yield _frame(maps)
            maps, held = {}, 0
    if maps:
        yield _frame(maps)


def merge_intervals(
    df: DataFrame, key: str, start: str, end: str, *, valid: Column | None = None, block: int = 1 << 16
) -> DataFrame:
    """Rows (``key``, kind, range_start, range_end): the periods that overlapping spans form, and the gaps between them.

    Spans overlap when each starts before the other ends; spans that touch give two periods without a gap. Spans
    count where ``0 <= start < end``, unless ``valid`` says otherwise; null, negative, reversed and empty ones
    and spans of a null entity don't. Repeated rows change nothing; an empty table gives no rows; other columns of
    ``df`` are ignored.

    Each input partition merges what it holds of an entity (:class:`IntervalMap`), so copies and overlaps collapse before the one
    shuffle. The rest is a bounded stream into the keyed state of :mod:`tidemark.streaming.intervals`, a map per entity and block of
    start positions, so that a hot entity with many separate periods is many keys. Its state at the end, periods and gaps, is the
    result of every entity within one block; those of more blocks are joined up by windows over the blocks' extents, of which an
    entity has one row per block.
    """
    from tidemark.streaming.intervals import drain

    k, s, e = F.col(key), F.col(start), F.col(end)
    ok = (s >= 0) & (s < e) if valid is None else valid
    spans = df.where(ok & k.isNotNull()).select(k.alias("key"), s.cast("long").alias("s"), e.cast("long").alias("e"))
    spans = spans.mapInPandas(_partial, "key string, s long, e long").withColumn("block", F.floor(F.col("s") / F.lit(block)))
    rows = drain(spans, shared_folder(df.sparkSession, "intervals"))
    # An entity's blocks: how many, the furthest end before each, and where its first period begins.
    period, before = F.col("kind") == "period", Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    extent = rows.where(period).groupBy("key", "block").agg(F.max("e").alias("far"), F.min("s").alias("first"))
    extent = extent.withColumn("blocks", F.count("*").over(Window.partitionBy("key"))).withColumn("reach", F.max("far").over(before))
    wide = cut(extent.where("blocks > 1").select("key", "block", "reach", "first"))
    alone = rows.join(wide.select("key").distinct(), "key", "left_anti").select("key", "kind", "s", "e")
    placed = rows.join(wide, ["key", "block"])
    # Periods reached from an earlier block belong to the last period that began on its own before them.
    own = F.col("reach").isNull() | (F.col("s") >= F.col("reach"))
    heads = placed.where(period & own).groupBy("key", "block").agg(F.max("s").alias("head"))
    grid = wide.join(heads, ["key", "block"], "left")
    grid = grid.select("key", "block", F.last("head", ignorenulls=True).over(before).alias("carried"))
    full = placed.where(period).join(grid, ["key", "block"]).withColumn("island", F.when(own, F.col("s")).otherwise(F.col("carried")))
    periods = full.groupBy("key", "island").agg(F.max("e").alias("e")).select("key", F.lit("period").alias("kind"), F.col("island").alias("s"), "e")
    # A gap shrinks by what reaches into it from earlier blocks; another may lie before a block's first period.
    inside = placed.where(~period).select("key", "kind", F.greatest("s", "reach").alias("s"), "e")
    between = wide.select("key", F.lit("gap").alias("kind"), F.col("reach").alias("s"), F.col("first").alias("e"))
    gaps = inside.unionByName(between.where(F.col("s").isNotNull())).where(F.col("s") < F.col("e"))
    out = alone.unionByName(periods).unionByName(gaps)
    return out.select(F.col("key").alias(key), "kind", F.col("s").cast("int").alias("range_start"), F.col("e").cast("int").alias("range_end"))
