"""An index of a store's vectors: cells around centroids, as many of which are read as a measured recall asks for."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import search

#: Vectors the centroids are fitted on, and asked to measure recall; aimed rows of a cell; most cells; the recall of the ten nearest asked for.
SAMPLE, ASKED, CELL_ROWS, MOST_CELLS, RECALL = 20_000, 200, 2_000, 4_096, 0.95


def fit_centroids(x: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Means of ``cells`` clusters of the rows of ``x``; an empty cluster keeps its centroid."""
    centroids = x[np.random.default_rng(7).choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest_cells(x, centroids, 1)[:, 0]
        size = np.bincount(near, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        centroids[size > 0] = sums[size > 0] / size[size > 0, None]
    return centroids


def cell_distances(q: np.ndarray, centroids: np.ndarray, method: str) -> np.ndarray:
    """How far each centroid is from each row of ``q``; smaller is nearer."""
    dots = q @ centroids.T
    if method == "negative_inner_product":
        return -dots
    if method == "euclidean_distance":
        return (centroids * centroids).sum(axis=1)[None] - 2 * dots
    return -dots / np.maximum(np.sqrt((centroids * centroids).sum(axis=1)), 1e-30)[None]


def nearest_cells(x: np.ndarray, centroids: np.ndarray, n: int, method: str = "euclidean_distance") -> np.ndarray:
    """The numbers of the ``n`` nearest centroids of each row."""
    return np.argsort(cell_distances(x, centroids, method), axis=1, kind="stable")[:, :n]


def cell_column(vector: Column, centroids: np.ndarray) -> Column:
    """The cell of a vector, in Arrow batches; null for null vectors and those with null or NaN values."""

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = pd.Series([None] * len(s), index=s.index, dtype="Int32")
            ok = np.array([v is not None and len(v) == centroids.shape[1] for v in s], bool)
            if ok.any():
                x = np.stack(s[ok].to_list()).astype(np.float64)
                good = np.isfinite(x).all(axis=1)
                out[s.index[ok][good]] = nearest_cells(x[good], centroids, 1)[:, 0] if good.any() else []
            yield out

    return run(vector)


def build(rows: DataFrame, path: str) -> dict:
    """Write ``rows`` (with chunk_id and embedding) by cell to ``path``; what the manifest keeps of the index.

    Centroids are fitted on at most twice 20,000 vectors, every vector is put into the cell of its nearest one. Then up to 200 sampled vectors ask all rows
    exactly: the cells they would have to read, in order of distance, for 0.95 of their ten nearest are what a query
    reads by default, for each distance.
    """
    n = rows.count()
    sample = rows.where(F.col("embedding").isNotNull()).select("embedding").sample(False, min(1.0, SAMPLE / max(n, 1)), 5).limit(2 * SAMPLE).toPandas()["embedding"]
    x = np.stack(sample.to_list()).astype(np.float64) if len(sample) else np.zeros((0, 1))
    x = x[np.isfinite(x).all(axis=1)]
    if not len(x):
        return {"cells": 0, "probes": {}, "recall": {}}
    centroids = fit_centroids(x, max(1, min(MOST_CELLS, math.ceil(n / CELL_ROWS), len(x) // 4 or 1)))
    placed = rows.withColumn("cell", F.coalesce(cell_column(F.col("embedding"), centroids), F.lit(-1)))
    placed.repartition("cell", F.pmod(F.xxhash64("chunk_id"), F.lit(4))).write.partitionBy("cell").parquet(f"{path}/cells")
    rows.sparkSession.createDataFrame([(i, v.tolist()) for i, v in enumerate(centroids)], "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    asked = x[:: max(1, len(x) // ASKED)][:ASKED]
    held = rows.sparkSession.read.parquet(f"{path}/cells")
    queries = rows.sparkSession.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "q int, v array<double>")
    probes, recall = {}, {}
    for method in search.METRICS:
        best = search.vector_top_batch(held, queries, 10, vec_col="embedding", id_col="chunk_id", query_id="q", query_vec="v", method=method)
        found = best.join(held.select("chunk_id", "cell"), "chunk_id").select("q", "cell").where("cell >= 0").toPandas()  # ten rows a query
        order = np.argsort(nearest_cells(asked, centroids, len(centroids), method), axis=1)
        at = np.sort(order[found["q"].to_numpy(), found["cell"].to_numpy()]) if len(found) else np.zeros(1, int)
        need = int(at[max(0, math.ceil(RECALL * len(at)) - 1)]) + 1
        probes[method], recall[method] = need, float((at < need).mean())
    return {"cells": len(centroids), "probes": probes, "recall": recall}


def read_centroids(spark: SparkSession, path: str) -> np.ndarray:
    """The centroids, in order of their cells: at most 4,096."""
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    return np.array([r["centroid"] for r in rows])


def candidates(spark: SparkSession, path: str, centroids: np.ndarray, index: dict, vector: Sequence[float], method: str, probes: int | None) -> DataFrame:
    """The rows of the cells nearest to ``vector``; others aren't read."""
    method = search.ALIASES.get(method, method)
    cells = nearest_cells(np.array([vector], np.float64), centroids, probes or index["probes"][method], method)[0]
    rows = spark.read.parquet(f"{path}/cells")
    return rows.where(F.col("cell").isin([int(c) for c in cells])).drop("cell")
