"""Vector search, keyword search, their fusion, and the merging of overlapping chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.arrays import dot, ordered_distinct
from tidemark.functions.text import analyse, terms
from tidemark.plans.durable import cut, spread

#: Distances by name. All sort upwards.
METRICS = ("cosine_distance", "euclidean_distance", "negative_inner_product")

#: Other names of distances.
ALIASES = {"l2_distance": "euclidean_distance", "inner_product": "negative_inner_product"}

METRIC_LIST = "array<struct<name:string,value:double>>"


def distance(a: Column, b: Column, method: str = "cosine_distance") -> Column:
    """The distance of two arrays, as double, in the JVM. A zero vector's cosine distance is NaN and sorts last."""
    method = ALIASES.get(method, method)
    if method == "negative_inner_product":
        return -dot(a, b)
    if method == "euclidean_distance":
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x))
    if method != "cosine_distance":
        raise ValueError(f"unknown distance {method!r}; known: {', '.join(METRICS)}")
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, 1 - dot(a, b) / size).otherwise(F.lit(float("nan")))


def distance_to(vector: Sequence[float], method: str = "cosine_distance") -> Callable[[Column], Column]:
    """The distance of a column to one vector: a matrix times the vector for each Arrow batch."""
    method = ALIASES.get(method, method)
    if method not in METRICS:
        raise ValueError(f"unknown distance {method!r}; known: {', '.join(METRICS)}")
    q = np.asarray(vector, np.float64)

    @F.pandas_udf("double")
    def run(col: pd.Series) -> pd.Series:
        out = np.full(len(col), np.nan)
        ok = np.array([v is not None and len(v) == len(q) for v in col], bool)
        if ok.any():
            x = np.stack(col[ok].to_list()).astype(np.float64)
            with np.errstate(all="ignore"):
                if method == "negative_inner_product":
                    out[ok] = -(x @ q)
                elif method == "euclidean_distance":
                    out[ok] = np.sqrt(((x - q) ** 2).sum(axis=1))
                else:
                    out[ok] = 1 - (x @ q) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt(q @ q))
        return pd.Series(out)

    return run


def metric(name: str, value: Column) -> Column:
    return F.array(F.struct(F.lit(name).alias("name"), value.cast("double").alias("value")))


def vector_top(df: DataFrame, vector: Sequence[float], k: int, *, vec_col: str = "embedding", id_col: str = "chunk_id", method: str = "cosine_distance", where: Column | None = None) -> DataFrame:
    """The ``k`` rows nearest to ``vector`` with a column ``metric_value``; filtered before, never after; ties by ``id_col``.

    Rows without a vector of that length aren't candidates. One pass, then the best k of each partition.
    """
    rows = df.where(where) if where is not None else df
    rows = rows.where(F.size(vec_col) == len(vector))
    value = F.coalesce(distance_to(vector, method)(F.col(vec_col)), F.lit(float("nan")))  # pandas hands NaN back as null
    return rows.withColumn("metric_value", value).orderBy(F.asc("metric_value"), id_col).limit(k)


def vector_top_batch(df: DataFrame, queries: DataFrame, k: int, *, vec_col: str, id_col: str, query_id: str, query_vec: str, method: str = "cosine_distance", max_queries: int = 10_000) -> DataFrame:
    """Rows (query_id, id_col, metric_value, rank): each query's ``k`` nearest rows.

    The stated queries, about ``max_queries`` at once by hash of their id, meet all rows in blocks of Arrow batches by matrix products; each batch sends on
    its own best k of each query, so no pairs are materialised.
    """
    method = ALIASES.get(method, method)
    stated = queries.select(query_id, query_vec).where(F.col(query_vec).isNotNull())
    n = stated.count()
    if n > max_queries:
        blocks, own = -(-n // max_queries), dict(vec_col=vec_col, id_col=id_col, query_id=query_id, query_vec=query_vec, method=method)
        parts = [stated.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == i) for i in range(blocks)]
        return reduce(DataFrame.unionByName, [vector_top_batch(df, p, k, **own, max_queries=n) for p in parts])
    asked = stated.collect()
    dim = len(asked[0][1]) if asked else 0
    if any(len(r[1]) != dim for r in asked):
        raise ValueError("query vectors differ in length")
    kind, id_kind = queries.schema[query_id].dataType.simpleString(), df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(([r[0] for r in asked], np.array([r[1] for r in asked], np.float64).reshape(len(asked), dim)))

    def run(parts):
        names, q = shared.value
        names = np.array(names, object)
        norm = np.sqrt((q * q).sum(axis=1))
        for pdf in parts:
            if not len(pdf) or not len(q):
                continue
            x, ids = np.stack(pdf["v"].to_list()).astype(np.float64), pdf["id"].to_numpy()
            with np.errstate(all="ignore"):
                s = x @ q.T
                if method == "cosine_distance":
                    s = 1 - s / (np.sqrt((x * x).sum(axis=1))[:, None] * norm[None])
                elif method == "euclidean_distance":
                    s = np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] + (norm * norm)[None] - 2 * s))
                else:
                    s = -s
            order = np.lexsort((np.broadcast_to(ids[:, None], s.shape), s), axis=0)[:k]
            n = len(order)
            yield pd.DataFrame({"q": np.tile(names, n), "id": ids[order].ravel(), "metric_value": np.take_along_axis(s, order, 0).ravel()})

    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where((F.size("v") == dim) & F.col("id").isNotNull())
    best = rows.mapInPandas(run, f"q {kind}, id {id_kind}, metric_value double")
    w = Window.partitionBy("q").orderBy("metric_value", "id")
    top = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select(F.col("q").alias(query_id), F.col("id").alias(id_col), "metric_value", "rank")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _analysed(texts: pd.Series) -> pd.Series:
    return texts.map(analyse)


def postings(df: DataFrame, id_col: str, text: Column, *, stemmed: bool = False) -> DataFrame:
    """Rows (term, id, tf, dl): the inverted index of a column of texts."""
    words = _analysed(text) if stemmed else terms(F.coalesce(text, F.lit("")))
    rows = df.select(F.col(id_col).alias("id"), words.alias("w")).select("id", F.size("w").alias("dl"), F.explode("w").alias("term"))
    return rows.groupBy("id", "term").agg(F.count("*").cast("int").alias("tf"), F.first("dl").alias("dl")).select("term", "id", "tf", "dl")


def lengths(df: DataFrame, id_col: str, text: Column, *, stemmed: bool = False) -> DataFrame:
    """Rows (id, dl): how many terms each text has, 0 for those without."""
    words = _analysed(text) if stemmed else terms(F.coalesce(text, F.lit("")))
    return df.select(F.col(id_col).alias("id"), F.size(words).alias("dl"))


def query_terms(query: str, stemmed: bool = False) -> list[str]:
    """The different terms of a query, in order."""
    plain = "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower())
    return sorted(set(analyse(query) if stemmed else plain.split()))


def bm25(index: DataFrame, sizes: DataFrame | tuple[int, float], query: str, *, k: float = 1.2, b: float = 0.75, conjunctive: bool = False, stemmed: bool = False) -> DataFrame:
    """Rows (id, score): Okapi BM25 of the texts that hold a term of the query, or all of them. ``sizes``: the texts' lengths, or their number and mean.

    Each term adds log10((N - df + .5) / (df + .5) + 1) * tf * (k + 1) / (tf + k * (1 - b + b * dl / avgdl)). Only the query's postings are read; corpus
    figures come with one aggregate, broadcast as a row, document frequencies as a row a term.
    """
    wanted = query_terms(query, stemmed)
    hits = index.where(F.col("term").isin(wanted)) if wanted else index.limit(0)
    if isinstance(sizes, tuple):
        whole = index.sparkSession.createDataFrame([(int(sizes[0]), float(sizes[1]))], "n long, avgdl double")
    else:
        whole = sizes.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df_ = hits.groupBy("term").agg(F.count("*").alias("df"))  # at most one row for each word of the query
    idf = F.log10((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k + 1) / (F.col("tf") + k * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = hits.join(F.broadcast(df_), "term").crossJoin(F.broadcast(whole))  # one row
    out = scored.groupBy("id").agg(F.sum(part).alias("score"), F.count("*").alias("n_terms"))
    return (out.where(F.col("n_terms") == len(wanted)) if conjunctive else out).select("id", "score")


def bm25_scan(df: DataFrame, id_col: str, text: Column, query: str, *, k: float = 1.2, b: float = 0.75, conjunctive: bool = False) -> DataFrame:
    """As :func:`bm25` without stems, of texts that have no index: rows (id, score).

    One narrow pass of Arrow batches: each sends on the texts that hold a term, with their counts, and one row of its own figures, of which the
    corpus's are made. Those rows, without texts, are cut from their lineage, so texts are read once.
    """
    wanted = query_terms(query)
    kind = df.schema[id_col].dataType.simpleString()
    if not wanted:
        return df.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    names, split = pa.schema([("dl", pa.int32()), ("tf", pa.list_(pa.int32())), ("n", pa.int64()), ("words", pa.int64()), ("df", pa.list_(pa.int64()))]), re.compile("[a-z0-9]+").findall

    def run(batches):
        for b in batches:
            size, tf = np.zeros(b.num_rows, np.int64), np.zeros((b.num_rows, len(wanted)), np.int64)
            for i, text in enumerate(b.column(1).to_pylist()):
                words = split((text or "").lower())
                size[i], tf[i] = len(words), [words.count(t) for t in wanted]
            hit = np.flatnonzero(tf.any(axis=1))
            own = [None] * len(hit)
            columns = [
                pa.concat_arrays([b.column(0).take(pa.array(hit)), pa.nulls(1, b.column(0).type)]), [*size[hit].tolist(), None], [*tf[hit].tolist(), None],
                [*own, b.num_rows], [*own, int(size.sum())], [*own, (tf > 0).sum(axis=0).tolist()],
            ]
            yield pa.RecordBatch.from_arrays([columns[0], *(pa.array(c, f.type) for c, f in zip(columns[1:], names))], ["id", *names.names])

    counts = spread(df.select(F.col(id_col).alias("id"), text.alias("t"))).mapInArrow(run, f"id {kind}, dl int, tf array<int>, n long, words long, df array<long>")
    counts = cut(counts)
    df_ = [F.coalesce(F.sum(F.col("df")[i]), F.lit(0)).alias(f"d{i}") for i in range(len(wanted))]
    whole = counts.where("n is not null").agg(F.sum("n").alias("__n"), (F.sum("words") / F.sum("n")).alias("avgdl"), *df_)
    score = F.lit(0.0)
    for i in range(len(wanted)):
        tf, d = F.col("tf")[i], F.col(f"d{i}")
        score += F.log10((F.col("__n") - d + 0.5) / (d + 0.5) + 1) * tf * (k + 1) / (tf + k * (1 - b + b * F.col("dl") / F.col("avgdl")))
    every = F.array_min("tf") > 0 if conjunctive else F.lit(True)
    return counts.where("n is null").crossJoin(F.broadcast(whole)).where(every).select("id", score.alias("score"))  # one row


def bm25_top(df: DataFrame, scores: DataFrame, n: int | None, *, id_col: str = "chunk_id", drop_unmatched: bool = False) -> DataFrame:
    """The ``n`` best rows of ``df`` by score, or all in any order for None, with ``metric_value``; texts without a match follow with null, unless dropped; ties by ``id_col``."""
    joined = df.join(scores.withColumnRenamed("score", "metric_value").withColumnRenamed("id", id_col), id_col, "inner" if drop_unmatched else "left")
    return joined if n is None else joined.orderBy(F.desc_nulls_last("metric_value"), id_col).limit(n)


def matches_all(text: Column, query: str) -> Column:
    """Whether a text holds every term of the query, in lower case without stemming; a query without terms matches nothing."""
    words = F.array_distinct(terms(F.lit(query)))
    return (F.size(words) > 0) & (F.size(F.array_except(words, terms(text))) == 0)


def rank_all(text: Column, query: str) -> Column:
    """A rank above 0 that grows with how often the query's terms stand in a text and falls with its length."""
    words, own = F.array_distinct(terms(F.lit(query))), terms(text)
    hits = F.size(F.filter(own, lambda t: F.array_contains(words, t)))
    return hits / (hits + 1.0) / (1 + F.log(F.lit(1.0) + F.size(own)))


def fuse_methods(results: Sequence[DataFrame], keys: Sequence[str] = ("origin", "chunk_id")) -> DataFrame:
    """Results of several methods as one row a chunk: ``metrics`` in the order of the methods, ``arrival`` the first place it came at.

    Each result has the keys, ``metrics`` and ``arrival`` (its place there).
    """
    tagged = [r.withColumn("__method", F.lit(i)) for i, r in enumerate(results)]
    bag = tagged[0]
    for r in tagged[1:]:
        bag = bag.unionByName(r)
    rest = [c for c in bag.columns if c not in (*keys, "metrics", "arrival", "__method")]
    came = F.struct("__method", "arrival")
    lists = F.array_sort(F.collect_list(F.struct("__method", "arrival", "metrics")))
    out = bag.groupBy(*keys).agg(
        F.flatten(F.transform(lists, lambda x: x["metrics"])).alias("metrics"), F.min(came).alias("__came"), *(F.min_by(c, came).alias(c) for c in rest)
    )
    return out.withColumn("arrival", F.col("__came.__method") * F.lit(1_000_000_000) + F.col("__came.arrival")).drop("__came")


def deoverlap(df: DataFrame, attributes: Sequence[str] = (), *, key: str = "origin") -> DataFrame:
    """Chunks of an origin that overlap as one: rows (key, start_index, end_index, char_count, context, text, chunk_ids, metrics, attributes..., arrival).

    Those that merely touch stay apart. Ids are distinct in order, metrics follow one another, the context is the first one's,
    attributes are lists with a value for each chunk. Text is the first one's, lengthened by what later ones add. Rows have ``text``,
    ``chunk_ids``, ``metrics`` and ``arrival``; retrieved chunks of one origin are few, and all work is in windows and aggregates.
    """
    before = Window.partitionBy(key).orderBy("start_index", "arrival").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(key).orderBy("start_index", "arrival").rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("__end", F.max("end_index").over(before))
    apart = F.col("__end").isNull() | (F.col("start_index") >= F.col("__end"))
    rows = rows.withColumn("__island", F.sum(apart.cast("int")).over(upto))
    added = F.when(apart, F.col("text")).otherwise(F.substring("text", F.col("__end") - F.col("start_index") + 1, F.greatest(F.col("end_index") - F.col("__end"), F.lit(0))))
    rows = rows.withColumn("__added", added)
    fields = ["start_index", "arrival", "end_index", "context", "__added", "chunk_ids", "metrics", *attributes]
    group = F.array_sort(F.collect_list(F.struct(*fields)))
    merged = rows.groupBy(key, "__island").agg(group.alias("g"))
    pick = lambda name: F.transform("g", lambda x: x[name])
    start, end = F.col("g")[0]["start_index"], F.array_max(pick("end_index"))
    return merged.select(
        key, start.alias("start_index"), end.alias("end_index"), (end - start).alias("char_count"), F.col("g")[0]["context"].alias("context"),
        F.array_join(pick("__added"), "").alias("text"), ordered_distinct(pick("chunk_ids")).alias("chunk_ids"), F.flatten(pick("metrics")).alias("metrics"),
        *(pick(a).alias(a) for a in attributes), F.array_min(pick("arrival")).alias("arrival"),
    )


def deoverlap_with(df: DataFrame, merge: Callable[[pd.DataFrame], dict], schema: str, *, key: str = "origin") -> DataFrame:
    """As :func:`deoverlap`, each island of two and more rows merged by ``merge`` to a row of ``schema``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start_index", "arrival"], kind="stable")
        far = pdf["end_index"].cummax().shift()
        island = (far.isna() | (pdf["start_index"] >= far)).cumsum()
        return pd.DataFrame([merge(part) for _, part in pdf.groupby(island)])

    return df.groupBy(key).applyInPandas(run, schema)


def tool_json(df: DataFrame) -> DataFrame:
    """The chunks, in order of arrival, as one JSON text of context and text for a tool call."""
    rows = F.array_sort(F.collect_list(F.struct("arrival", "context", "text")))
    return df.agg(F.to_json(F.transform(rows, lambda x: F.struct(x["context"].alias("context"), x["text"].alias("text")))).alias("json"))
