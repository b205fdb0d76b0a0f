"""One ranking from several differently scaled scores (problem 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.durable import cut
from tidemark.plans.prefix import magnitude_bucket, running_sum
from tidemark.plans.skew import salted_join

#: Names whose smaller values are better.
SMALLER_IS_BETTER = ("cosine_distance", "negative_inner_product")

#: Most different metric names; their correlation matrix goes to the driver.
MAX_NAMES = 500

#: Chunks of a query from which on its values are counted in buckets, each a task of its own.
BUCKET_ROWS = 10_000


def metric_name(name: Column) -> Column:
    """Names are compared trimmed, lower-cased, with - as _."""
    return F.translate(F.lower(F.trim(name)), "-", "_")


def _best(df: DataFrame, names: list[str], smaller: tuple[str, ...]) -> DataFrame:
    """Rows (query_id, chunk_id, g): for each of ``names`` the best value of the chunk, larger is better, or null."""
    m = df.select("query_id", "chunk_id", F.explode_outer("metrics").alias("m")).where(F.col("query_id").isNotNull() & F.col("chunk_id").isNotNull())
    m = m.select("query_id", "chunk_id", metric_name(F.col("m.name")).alias("name"), F.nanvl("m.value", F.lit(None).cast("double")).alias("v"))
    good = F.when(F.col("name").isin(*smaller), -F.col("v")).otherwise(F.col("v"))
    best = m.groupBy("query_id", "chunk_id").agg(*(F.max(F.when(F.col("name") == n, good)).alias(f"g{i}") for i, n in enumerate(names)))
    return best.select("query_id", "chunk_id", F.array(*(f"g{i}" for i in range(len(names)))).cast("array<double>").alias("g"))


def _names(df: DataFrame) -> list[str]:
    """The different metric names, in order."""
    m = df.select(F.explode("metrics").alias("m")).select(metric_name(F.col("m.name")).alias("name"))
    rows = m.where("name is not null and name <> ''").distinct().limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} metric names")
    return sorted(r[0] for r in rows)


def rank_scores(df: DataFrame, names: list[str], smaller: tuple[str, ...] = SMALLER_IS_BETTER) -> DataFrame:
    """Rows (query_id, chunk_id, z): the rank of each of ``names`` in the query, from 0 (worst) to 1 (best); null where no chunk has the name.

    Ties share the middle rank; where all chunks of a query are equal it is 0.5. A chunk without a name that others of its query have
    ranks with that name's worst: such chunks are counted, not listed. Ranks come from running counts over buckets of the different
    values, so a query of any size is many tasks; joins on what a hot query has many of are salted.
    """
    by = ["query_id", "j"]
    best = cut(_best(df, names, smaller)) if names else df.select("query_id", "chunk_id").where("query_id is not null and chunk_id is not null").distinct()
    if not names:
        return best.withColumn("z", F.array().cast("array<double>"))
    totals = best.groupBy("query_id").agg(F.count("*").alias("total"))
    hot = totals.where(F.col("total") > BUCKET_ROWS).select("query_id", F.lit(True).alias("hot"))
    rows = best.select("query_id", "chunk_id", F.posexplode("g").alias("j", "g")).where(F.col("g").isNotNull())
    values = rows.groupBy(*by, "g").agg(F.count("*").alias("n")).join(hot, "query_id", "left")
    bucket = F.when(F.col("hot"), magnitude_bucket(F.col("g"))).otherwise(0)  # those of a small query are one bucket
    upto = cut(running_sum(values, by, bucket, [F.col("g")], F.col("n"), "upto", null_keys=False).select(*by, "g", "n", "upto"))
    per = upto.groupBy(*by).agg(F.sum("n").alias("given"), F.min("g").alias("worst"), F.min_by("n", "g").alias("at_worst"))
    per = per.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("j", F.struct("given", "worst", "at_worst")))).alias("per")).join(totals, "query_id")
    placed = salted_join(rows, upto, [*by, "g"], "chunk_id", 2)
    own = placed.groupBy("query_id", "chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("j", F.struct("g", "n", "upto")))).alias("own"))
    both = salted_join(best.select("query_id", "chunk_id"), per, ["query_id"], "chunk_id", 2).join(own, ["query_id", "chunk_id"], "left")

    def rank(j: int) -> Column:
        all_of, mine = F.col("per")[j], F.col("own")[j]
        missing, lowest = F.col("total") - all_of["given"], mine["g"] == all_of["worst"]
        less = mine["upto"] - mine["n"] + F.when(lowest, 0).otherwise(missing)
        given = less + (mine["n"] + F.when(lowest, missing).otherwise(0) - 1) / 2
        place = F.when(mine.isNotNull(), given).otherwise((all_of["at_worst"] + missing - 1) / 2)
        return F.when(all_of.isNotNull(), F.when(F.col("total") > 1, place / (F.col("total") - 1)).otherwise(0.5))

    listed = both.select("query_id", "chunk_id", F.array(*map(rank, range(len(names)))).alias("z"))
    bare = best.select("query_id", "chunk_id").join(per.select("query_id"), "query_id", "left_anti")  # queries without any metric
    return listed.unionByName(bare.withColumn("z", F.array(*(F.lit(None).cast("double") for _ in names))))


def loadings(ranks: DataFrame, names: list[str]) -> dict[str, float]:
    """The first principal component of the rank-transformed scores, turned so that its loadings add up to 0 or more.

    Sums of products over pairs of names are taken in each batch and added up; only that matrix of names reaches the
    driver. A pair of names counts where a query has both. Ranks are oriented already, so a loading below 0 is that of a name that
    opposes the others; it counts in its declared direction, by its size.
    """
    k = len(names)
    if not k:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, k, k))
        for b in batches:
            z = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k) - 0.5
            given = (~np.isnan(z)).astype(float)
            z = np.nan_to_num(z)
            total += np.stack([given.T @ given, z.T @ given, (z * z).T @ given, z.T @ z])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4 * k * k)), pa.array(total.ravel())], ["i", "s"])

    sums = ranks.select("z").mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()  # 4 k k rows
    flat = np.zeros(4 * k * k)
    for r in sums:
        flat[r["i"]] = r["s"]
    n, x, xx, xy = flat.reshape(4, k, k)
    n = np.maximum(n, 1)
    var = xx - x * x / n
    spread = np.sqrt(np.maximum(var, 0) * np.maximum(var.T, 0))
    c = np.where(spread > 1e-12, (xy - x * x.T / n) / np.maximum(spread, 1e-12), 0.0)
    np.fill_diagonal(c, 1.0)
    first = np.linalg.eigh((c + c.T) / 2)[1][:, -1]
    return {name: float(v) for name, v in zip(names, first if first.sum() >= 0 else -first)}


def component(df: DataFrame, *, smaller: tuple[str, ...] = SMALLER_IS_BETTER) -> DataFrame:
    """Rows (name, loading, weight): how the metrics load on the first component, and the weights that :func:`fuse` gives their ranks."""
    names = _names(df)
    found = loadings(cut(rank_scores(df, names, smaller)), names)
    return df.sparkSession.createDataFrame([(n, v, abs(v)) for n, v in found.items()], "name string, loading double, weight double")


def _scored(df: DataFrame, smaller: tuple[str, ...], influence: str) -> DataFrame:
    """Rows (query_id, chunk_id, score)."""
    names = _names(df)
    ranks = cut(rank_scores(df, names, smaller))
    weights = {n: abs(v) for n, v in loadings(ranks, names).items()} if influence == "component" else dict.fromkeys(names, 1.0)
    w = F.array(*(F.lit(weights[n]) for n in names)) if names else F.array().cast("array<double>")
    total = F.aggregate(F.zip_with("z", w, lambda z, x: F.coalesce(z * x, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    return ranks.select("query_id", "chunk_id", F.round(total, 9).alias("score"))


def fuse(df: DataFrame, *, smaller: tuple[str, ...] = SMALLER_IS_BETTER, influence: str = "component") -> DataFrame:
    """Rows (query_id, chunk_id, score, place): each query's chunks in one order.

    ``influence`` "component" weighs the rank-transformed scores by the first principal component, "equal" weighs all
    names of a query alike. Chunks of equal score are ordered by chunk_id. A chunk given twice, as repeated or late row,
    counts once with the better of each value; null and NaN values and names are missing; chunks without any metric
    come last with score 0; rows of a null query or chunk are left out; an empty table gives no rows. Ids are integers.
    Places are running counts over buckets of the score, so no query is one task.
    """
    scored = _scored(df, smaller, influence).withColumn("neg", -F.col("score"))
    return running_sum(scored, ["query_id"], magnitude_bucket(F.col("neg")), [F.col("neg"), F.col("chunk_id")], F.lit(1), "place").drop("neg")


def top(df: DataFrame, n: int = 3, *, smaller: tuple[str, ...] = SMALLER_IS_BETTER, influence: str = "component") -> DataFrame:
    """The first ``n`` chunks of each query as in :func:`fuse`. Each task sends on its best ``n`` of a query only."""
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    scored = _scored(df, smaller, influence)
    return scored.withColumn("place", F.row_number().over(first).cast("long")).where(F.col("place") <= n)
