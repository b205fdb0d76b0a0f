from typing import Annotated

import pytest
from pyspark.sql import functions as F

from tidemark.embed import HashingEmbedding
from tidemark.operators.chunking import MarkdownChunker, chunk_documents
from tidemark.store import IngestSummary, Store
from tidemark.store import attributes as A
from tidemark.store.store import allocate_ids, latest_versions

DOCS = [
    ("mars", "# Mars\n\nMars is the red planet. It has two moons.", "t1", 1), ("saturn", "# Saturn\n\nSaturn is the planet with the largest rings.", "t2", 2),
    ("jupiter", "# Jupiter\n\nJupiter is the largest planet.", "t1", None),
]


def prepare(df):
    return chunk_documents(df, MarkdownChunker(40, 0.5))


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "origin string, content string, tenant string, priority int")


@pytest.fixture
def made(spark, tmp_path, docs):
    s = Store.create(spark, str(tmp_path / "s"), embed=HashingEmbedding(32), attributes={"tenant": str, "priority": int | None, "topic": (str | None, "general")}, buckets=4)
    assert s.ingest(docs, prepare) == IngestSummary(3, 0, 0)
    return s


def test_life_of_a_store(spark, made, docs):
    assert made.ingest(docs, prepare) == IngestSummary(0, 0, 3)
    s = Store.connect(spark, made.files.root)
    assert s.size() == 3 and s.manifest["version"] == 1 and s.document("mars").collect()[0].text.startswith("# Mars")
    ids = [r[0] for r in s.embeddings.select("chunk_id").orderBy("chunk_id").collect()]
    assert ids == list(range(1, len(ids) + 1))
    for c in s.chunks.collect():
        text = next(t for o, t, *_ in DOCS if o == c.origin)
        assert c.text == text[c.start_index : c.end_index] and c.topic == "general" and len(c.embedding) == 32
    changed = docs.where("origin = 'mars'").withColumn("content", F.concat("content", F.lit(" More.")))
    assert s.ingest(changed, prepare) == IngestSummary(0, 1, 0)
    assert min(r[0] for r in s.embeddings.where("origin = 'mars'").select("chunk_id").collect()) > max(ids)
    assert s.ingest(docs.where("origin = 'saturn'").withColumn("tenant", F.lit("t3")), prepare) == IngestSummary(0, 1, 0)
    assert s.ingest(docs.where("origin = 'jupiter'"), prepare, skip_if_unchanged=False) == IngestSummary(0, 1, 0)
    s.vacuum()
    (snap,) = s.snapshot("saturn").collect()
    assert snap.tenant == "t3" and [c.start_index for c in snap.chunks] == sorted(c.start_index for c in snap.chunks) and s.size() == 3


def test_search_and_freshness(made, docs):
    with pytest.raises(RuntimeError, match=r'build_index\("bm25"\) or build_index\(\)'):
        made.retrieve_bm25("rings")
    made.build_index("bm25")
    top = made.retrieve_bm25("Which planet has the largest rings?", 2).collect()
    assert top[0].origin == "saturn" and top[0].metrics[0].name == "bm25" and top[0].metric_value > top[1].metric_value
    tail = made.retrieve_bm25("rings", 50).collect()
    assert len(tail) == made.embeddings.count() and tail[-1].metric_value is None
    assert {r.origin for r in made.retrieve_bm25("planet", 50, attributes_filter="tenant = 't1'").collect()} <= {"mars", "jupiter"}
    assert made.retrieve_bm25("red rings", 50, conjunctive=True).count() == 0
    near = made.retrieve_vss("largest rings", 2).collect()
    assert near[0].origin == "saturn" and near[0].metric_value <= near[1].metric_value
    fts = made.retrieve_fts("Largest planet", 5, attributes_filter="tenant = 't1'").collect()
    assert {r.origin for r in fts} == {"jupiter"} and fts[0].metrics[0].name == "ts_rank" and fts[0].metric_value > 0
    assert [r.chunk_id for r in made.retrieve_vss("largest rings", 2, method="l2_distance").collect()] == [r.chunk_id for r in made.retrieve_vss("largest rings", 2, method="euclidean_distance").collect()]
    seen = [r.chunk_id for r in near]
    more = made.retrieve_vss("largest rings", 2, attributes_filter={"type": "nin", "key": "chunk_id", "value": seen}).collect()
    assert not set(seen) & {r.chunk_id for r in more}
    assert made.retrieve_vss("x", 3, attributes_filter="priority IS NULL").select("origin").distinct().collect()[0][0] == "jupiter"
    both = made.retrieve("largest rings", 2, deoverlap=False).collect()
    assert any({m.name for m in r.metrics} == {"cosine_distance", "bm25"} for r in both)
    one = made.retrieve("largest rings", 3).collect()
    assert len(one) <= len(both) + 2 and all(isinstance(r.tenant, list) for r in one)
    with pytest.raises(ValueError, match="Unknown attribute"):
        made.retrieve_vss("x", attributes_filter="text = 'y'")
    made.ingest(docs.limit(1).withColumn("content", F.lit("new words")), prepare)
    with pytest.raises(RuntimeError):
        made.retrieve_bm25("rings")
    with pytest.raises(ValueError):
        made.build_index("hnsw")


def test_checks_before_writing(spark, made, docs):
    before = made.files.read("manifest.json")
    bad = [
        docs.union(docs), docs.withColumn("origin", F.lit("")), docs.withColumn("content", F.lit(None).cast("string")),
        docs.drop("tenant"), docs.withColumn("tenant", F.lit(None).cast("string")),
    ]
    for d in bad:
        with pytest.raises(ValueError):
            made.ingest(d, prepare)
    chunk = "array<struct<start_index:int,end_index:int,char_count:int,context:string,text:string,chunk_origin:string,attributes:struct<priority:int>>>"
    rows = lambda *c: spark.createDataFrame([("n", "alphabeta", "t", list(c))], f"origin string, content string, tenant string, chunks {chunk}")
    for c in ((0, 20, None, None, None, None, None), (5, 2, 0, None, None, None, None), (0, 5, 5, None, "wrong", None, None), (0, 5, 5, None, None, "other", None)):
        with pytest.raises(ValueError):
            made.upsert(rows(c))
    assert made.files.read("manifest.json") == before and not made.files.exists("writer.lock")
    made.upsert(rows((0, 5, None, None, "alpha", "n", (7,)), (5, 9, 4, "h", None, None, None)))
    got = {(r.text, r.priority, r.char_count) for r in made.chunks.where("origin = 'n'").collect()}
    assert got == {("alpha", 7, 5), ("beta", None, 4)}


def test_create_connect_and_lock(spark, tmp_path):
    at = str(tmp_path / "s")
    with pytest.raises(FileNotFoundError):
        Store.connect(spark, at)
    s = Store.create(spark, at, title="T")
    assert s.size() == 0 and s.chunks.count() == 0 and s.manifest["name"] == "s"
    with pytest.raises(ValueError, match="provider"):
        s.retrieve_vss("x")
    with pytest.raises(RuntimeError, match=r'build_index\("bm25"\)$'):
        s.retrieve_bm25("x")
    with pytest.raises(FileExistsError):
        Store.create(spark, at)
    Store.create(spark, at, overwrite=True)
    (tmp_path / "other").mkdir()
    with pytest.raises(ValueError):
        Store.create(spark, str(tmp_path / "other"), overwrite=True)
    s._lock()
    with pytest.raises(RuntimeError, match="writer"):
        s.build_index()


def test_declarations():
    class Own:
        tenant: str
        score: float = 0.5
        vec: Annotated[list[float], 3] | None

    made = A.declare(Own)
    assert made["score"].default == 0.5 and made["vec"].nullable and made["vec"].default is None and made["tenant"].required
    nested = A.declare({"details": {"source": str, "flags": {"on": bool}}, "n": (int, 0), **{"v": Annotated[list[float], 2]}})
    assert A.from_json(A.to_json(nested)) == nested and A.to_json(nested)["v"]["type"] == "float_vector[2]"
    assert A.filterable(nested)[-3:] == ["details.source", "details.flags.on", "n"]
    for bad in ({"text": str}, {"and": str}, {"1x": str}, {"a": (int, True)}, {"a": (float, 1)}, {"a": list}, {"a": {}}, {"a": {"b": int | None}}, {"a": (str, None)}, {"a": int | str}):
        with pytest.raises((TypeError, ValueError)):
            A.declare(bad)
    with pytest.raises(ValueError):
        A.check_value("d", nested["details"], {"source": "x"})
    assert A.check_value("v", nested["v"], [1, 2.5]) == [1.0, 2.5]
    for profile in ("flat", "files"):
        with pytest.raises(ValueError):
            A.check_profile(nested, profile)
    A.check_profile(A.declare({"a": str}), "files")


def test_ids_and_versions(spark):
    df = spark.createDataFrame([(f"o{i % 7}", i, i + 1) for i in range(100)], "origin string, start_index int, end_index int")
    got = allocate_ids(df, 10)
    assert sorted(r.chunk_id for r in got.collect()) == list(range(11, 111)) and got.columns == ["origin", "start_index", "end_index", "chunk_id"]
    v = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, at int, v string")
    assert {tuple(r) for r in latest_versions(v, "k", ["at"]).collect()} == {("a", 2, "y"), ("b", 1, None)}


def test_stream_ingest(spark, tmp_path, docs):
    from tidemark.streaming.ingest import duplicate_origins, stream_duplicates, stream_ingest

    s = Store.create(spark, str(tmp_path / "s"))
    src = str(tmp_path / "in")
    docs.select("origin", "content").write.parquet(src)
    stream = lambda: spark.readStream.schema("origin string, content string").option("maxFilesPerTrigger", 1).parquet(src)
    seen = []
    for run in ("a", "b"):
        q = stream_ingest(stream(), s, str(tmp_path / run), prepare, seen.append)
        q.awaitTermination(180)
    total = sum(seen, IngestSummary())
    assert total == IngestSummary(3, 0, 3) and s.refresh().size() == 3
    assert [tuple(r) for r in duplicate_origins(docs.union(docs.where("origin = 'mars'"))).collect()] == [("mars", 2)] and duplicate_origins(docs).count() == 0
    out = []
    docs.select("origin", "content").limit(1).write.mode("append").parquet(src)
    q = stream_duplicates(stream()).writeStream.outputMode("update").foreachBatch(lambda d, _: out.extend(map(tuple, d.collect()))).option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert len(out) == 1 and out[0][1] == 2


def test_index_of_vectors(spark, tmp_path, monkeypatch):
    import numpy as np

    from tidemark.store import vectors

    monkeypatch.setattr(vectors, "CELL_ROWS", 40)
    words = [f"w{i}" for i in range(120)]
    r = np.random.default_rng(2)
    rows = [(f"d{i}", " ".join(r.choice(words[10 * (i % 12) : 10 * (i % 12) + 14], 12)), f"t{i % 3}") for i in range(600)]
    docs = spark.createDataFrame(rows, "origin string, content string, tenant string")
    s = Store.create(spark, str(tmp_path / "v"), embed=HashingEmbedding(32), attributes={"tenant": str}, buckets=2)
    s.ingest(docs, lambda d: chunk_documents(d, MarkdownChunker(400, 0.5)))
    s.build_index("vss")
    index = s.manifest["vectors"]
    assert index["cells"] == 15 and all(v >= 0.95 for v in index["recall"].values()) and all(1 <= p <= 15 for p in index["probes"].values())
    hit = total = 0
    for q in (rows[i][1] for i in range(0, 600, 60)):
        for method in ("cosine_distance", "l2_distance"):
            want = [x.metric_value for x in s.retrieve_vss(q, 5, method=method, exact=True).collect()]
            got = [x.metric_value for x in s.retrieve_vss(q, 5, method=method).collect()]
            hit, total = hit + sum(abs(a - b) < 1e-9 for a, b in zip(got, want)), total + len(want)
            assert got == sorted(got) and len(got) == 5
    assert hit / total >= 0.9
    few = s.retrieve_vss(rows[0][1], 150, attributes_filter="tenant = 't1'", probes=1).collect()
    assert len(few) == 150 and {x.tenant for x in few} == {"t1"}  # more than a cell holds: all are read
    s.build_index("bm25")
    s.vacuum()
    assert len(s.retrieve("w1 w2", 3).collect()) >= 3
    s.ingest(docs.limit(1).withColumn("content", F.lit("w1 w2 w3")), lambda d: chunk_documents(d, MarkdownChunker(400, 0.5)))
    assert s.retrieve_vss("w1 w2 w3", 1).collect()[0].metric_value < 1e-6  # an index of an older version isn't used
