"""Array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lengths summed at once; sums of such blocks are taken first.
BLOCK = 64


def offsets(lengths: Column, levels: int = 2) -> Column:
    """Running sums of an int array before each element, in blocks, and blocks of blocks, so that long arrays don't cost their square."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("int"), lambda acc, x: acc + x)
    if not levels:
        return F.transform(lengths, lambda _, i: total(F.slice(lengths, F.lit(1), i)))
    n = F.size(lengths)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, BLOCK))
    bases = offsets(F.transform(blocks, total), levels - 1)
    inside = F.zip_with(blocks, bases, lambda part, base: F.transform(part, lambda _, i: base + total(F.slice(part, F.lit(1), i))))
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.flatten(inside))


def ordered_distinct(lists: Column) -> Column:
    """The elements of an array of arrays, each at its first place."""
    return F.array_distinct(F.flatten(lists))


def nearest(x: Column, candidates: Column, within: int) -> Column:
    """The candidate nearest to ``x``, the smaller of two equally near ones; null beyond ``within``."""
    best = F.array_min(F.transform(candidates, lambda c: F.struct(F.abs(c - x).alias("d"), c.alias("c"))))
    return F.when(best["d"] <= within, best["c"])


def dot(a: Column, b: Column) -> Column:
    """The inner product of two arrays, as double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
