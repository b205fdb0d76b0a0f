"""The canonical rows of the engine, and what turns other data into them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from enum import StrEnum
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT = T.StructType([T.StructField("origin", T.StringType()), T.StructField("content", T.StringType())])
CHUNK = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("start_index", T.IntegerType()), T.StructField("end_index", T.IntegerType()),
    T.StructField("char_count", T.IntegerType()), T.StructField("context", T.StringType()), T.StructField("origin", T.StringType()),
])
METRIC = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.DoubleType())])
RETRIEVED = T.StructType([*CHUNK.fields, T.StructField("metrics", T.ArrayType(METRIC)), T.StructField("chunk_ids", T.ArrayType(T.LongType()))])


class VectorMethod(StrEnum):
    COSINE_DISTANCE = "cosine_distance"
    EUCLIDEAN_DISTANCE = "euclidean_distance"
    NEGATIVE_INNER_PRODUCT = "negative_inner_product"


class IndexType(StrEnum):
    BM25 = "bm25"
    VSS = "vss"


@runtime_checkable
class IntoFrame(Protocol):
    """Data that knows how to become a DataFrame."""

    def to_df(self) -> DataFrame: ...


def _conform(df: DataFrame, schema: T.StructType, needed: Iterable[str], names: Mapping[str, str] | None) -> DataFrame:
    given = {v: k for k, v in (names or {}).items()}
    source = lambda f: given.get(f.name, f.name)
    if missing := [n for n in needed if given.get(n, n) not in df.columns]:
        raise TypeError(f"columns are missing: {missing}")
    known = [(F.col(source(f)) if source(f) in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    rest = [c for c in df.columns if c not in {source(f) for f in schema} and c not in schema.names]
    return df.select(*known, *rest)


def _frame(spark: SparkSession, data: Any, fields: list[str], method: str) -> DataFrame:
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, IntoFrame):
        out = data.to_df()
        if not isinstance(out, DataFrame):
            raise TypeError(f"to_df() must give a DataFrame, not {type(out).__name__}")
        return out
    if isinstance(data, (str, bytes, Mapping)) or not isinstance(data, Iterable):
        raise TypeError(f"neither a DataFrame nor a list of objects: {type(data).__name__}")
    rows = []
    for x in data:
        x = getattr(x, method)() if callable(getattr(x, method, None)) else x
        get = x.get if isinstance(x, Mapping) else lambda n, x=x: getattr(x, n, None)
        if get(fields[0]) is None:
            raise TypeError(f"{type(x).__name__} has no {fields[0]}")
        rows.append(tuple(get(n) for n in fields))
    kinds = {"start_index": T.IntegerType(), "end_index": T.IntegerType(), "char_count": T.IntegerType()}
    return spark.createDataFrame(rows, T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in fields]))


def documents(spark: SparkSession, data: Any, names: Mapping[str, str] | None = None) -> DataFrame:
    """Rows (origin, content, other columns) of a DataFrame, of something with to_df(), or of objects or mappings in a list.

    An object with to_document() is asked first. ``names`` renames columns (theirs to ours). Chunked documents keep their chunks
    column only as any other; content must be there.
    """
    return _conform(_frame(spark, data, ["content", "origin"], "to_document"), DOCUMENT, ["content"], names)


def chunks(spark: SparkSession, data: Any, names: Mapping[str, str] | None = None) -> DataFrame:
    """Rows as :data:`CHUNK` and other columns; text and its span must be there, char_count is the text's length where it isn't given."""
    df = _conform(_frame(spark, data, [f.name for f in CHUNK], "to_chunk"), CHUNK, ["text", "start_index", "end_index"], names)
    return df.withColumn("char_count", F.coalesce("char_count", F.length("text")))


def chunked(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Documents with their chunks of a table as an array, in order of their spans: what a store takes."""
    own = F.struct("start_index", "end_index", "char_count", "context", "text", F.col("origin").alias("chunk_origin"))
    lists = rows.groupBy("origin").agg(F.array_sort(F.collect_list(own)).alias("chunks"))
    return docs.join(lists, "origin", "left")


def show(df: DataFrame, n: int = 20) -> None:
    """Rows one field a line."""
    df.show(n, truncate=False, vertical=True)
