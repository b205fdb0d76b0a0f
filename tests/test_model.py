from dataclasses import dataclass

import pytest

from tidemark import model
from tidemark.store import Store


@dataclass
class Piece:
    text: str
    start_index: int
    end_index: int
    context: str | None = None
    origin: str | None = "o"


class Wrapped:
    def to_chunk(self):
        return Piece("beta", 5, 9)


def test_documents(spark):
    df = spark.createDataFrame([("u", "text", 1)], "url string, body string, n int")
    out = model.documents(spark, df, {"url": "origin", "body": "content"})
    assert out.columns == ["origin", "content", "n"] and out.collect()[0][:] == ("u", "text", 1)

    class Holder:
        def to_df(self):
            return df.withColumnRenamed("body", "content")

    assert model.documents(spark, Holder()).collect()[0].origin is None
    assert model.documents(spark, [{"content": "x", "origin": "o"}]).collect()[0][:] == ("o", "x")
    for bad in ("text", 5, {"content": "x"}, [{"origin": "o"}], df):
        with pytest.raises(TypeError):
            model.documents(spark, bad)


def test_chunks_into_a_store(spark, tmp_path):
    rows = model.chunks(spark, [Piece("alpha", 0, 5, "# A"), Wrapped()])
    assert [r.char_count for r in rows.collect()] == [5, 4]
    docs = model.chunked(model.documents(spark, [{"content": "alphabeta", "origin": "o"}]), rows)
    s = Store.create(spark, str(tmp_path / "s"))
    assert [r.action for r in s.upsert(docs).collect()] == ["inserted"]
    assert [(r.text, r.context) for r in s.chunks.orderBy("start_index").collect()] == [("alpha", "# A"), ("beta", None)]
    with pytest.raises(TypeError):
        model.chunks(spark, spark.createDataFrame([("x",)], "text string"))


def test_names():
    assert model.VectorMethod("cosine_distance") == "cosine_distance" and model.IndexType.BM25 == "bm25" and model.RETRIEVED.names[-2:] == ["metrics", "chunk_ids"]
