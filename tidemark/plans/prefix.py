"""Running sums over unbounded groups without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.durable import cut, parts_for


def running_sum(
    df: DataFrame, keys: list[str], bucket: Column, order: list[Column], value: Column, out: str, null_keys: bool = True
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of ``keys`` up to and including this one in ``order``.

    ``bucket`` is any integer that never falls as ``order`` rises, so a hot group is spread over its buckets: sums
    are taken per (keys, bucket) with map-side combining, a window runs over those few sums alone, and a second
    window runs within a bucket. ``order`` must be total. Null values count as 0; keys may be null, unless the caller
    says that they aren't, which saves a shuffle.
    """
    b, v, base = "__bucket", "__value", "__base"
    rows = df.withColumn(b, bucket).withColumn(v, F.coalesce(value, F.lit(0)))
    sums = rows.groupBy(*keys, b).agg(F.sum(v).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*keys, b, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias(base))
    within = Window.partitionBy(*keys, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if not null_keys:
        summed = rows.withColumn(out, F.sum(v).over(within))
        return summed.join(bases, [*keys, b]).withColumn(out, F.col(base) + F.col(out)).drop(b, v, base)
    right = bases.select(*(F.col(k).alias(f"__r_{k}") for k in [*keys, b]), base)
    match = None
    for k in [*keys, b]:
        one = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        match = one if match is None else match & one
    return (
        rows.join(right, match)
        .withColumn(out, F.col(base) + F.sum(v).over(within))
        .drop(b, v, base, *(f"__r_{k}" for k in [*keys, b]))
    )


def range_sum(df: DataFrame, order: list[Column], value: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows up to and including this one in ``order``, which must be total.

    The rows are sorted over the cluster by ranges of ``order``; each range's sum, one row a partition, is added up before it. The sorted
    rows are cut from their lineage, so that both readings see the same ranges. Null values count as 0.
    """
    part, held, base = "__part", "__held", "__base"
    parts = parts_for(df.sparkSession)
    ranged = df.withColumn(held, F.coalesce(value, F.lit(0))).repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id())
    ranged = cut(ranged.sortWithinPartitions(*order))
    sums = ranged.groupBy(part).agg(F.sum(held).alias("__sum"))  # a row for each partition
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(part, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias(base))
    within = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(F.broadcast(bases), part).withColumn(out, F.col(base) + F.sum(held).over(within)).drop(part, held, base)


def magnitude_bucket(x: Column) -> Column:
    """A bigint that never falls as the double ``x`` rises: 4,096 steps in each power of two, on either side of 0."""
    size = F.when(F.abs(x) < 1e-300, F.lit(0.0)).otherwise(F.log2(F.least(F.abs(x), F.lit(1e300))) + 1100)
    return (F.signum(x) * size * 4096).cast("long")
