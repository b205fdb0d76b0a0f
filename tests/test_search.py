import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.text import analyse, stem
from tidemark.operators import search


def test_distances_agree(spark):
    r = np.random.default_rng(0)
    rows = [(i, r.standard_normal(5).tolist()) for i in range(40)] + [(98, [0.0] * 5), (99, [1.0]), (100, None)]
    df = spark.createDataFrame(rows, "chunk_id int, embedding array<float>")
    q = r.standard_normal(5).tolist()
    for method in search.METRICS:
        got = [x.chunk_id for x in search.vector_top(df, q, 5, method=method).collect()]
        jvm = df.where("chunk_id < 98").withColumn("v", search.distance(F.col("embedding"), F.array(*map(F.lit, q)), method)).orderBy("v").limit(5)
        assert got == [x.chunk_id for x in jvm.collect()]
    assert [x.chunk_id for x in search.vector_top(df, q, 50).collect()][-1] == 98  # NaN comes last
    assert {x.chunk_id for x in search.vector_top(df, q, 3, where=F.col("chunk_id") > 30).collect()} <= set(range(31, 99))
    with pytest.raises(ValueError):
        search.distance_to(q, "manhattan")
    asked = df.where("chunk_id in (1, 2, 3)").select(F.col("chunk_id").alias("q"), F.col("embedding").alias("v"))
    batch = search.vector_top_batch(df.where("chunk_id < 98"), asked, 4, vec_col="embedding", id_col="chunk_id", query_id="q", query_vec="v").collect()
    for i in (1, 2, 3):
        one = [x.chunk_id for x in search.vector_top(df.where("chunk_id < 98"), rows[i][1], 4).collect()]
        assert [x.chunk_id for x in sorted((b for b in batch if b.q == i), key=lambda b: b.rank)] == one and one[0] == i


def test_bm25_by_hand(spark):
    texts = {1: "mars is the red planet", 2: "saturn has rings, rings of ice", 3: "jupiter is the largest planet", 4: None, 5: ""}
    df = spark.createDataFrame(list(texts.items()), "chunk_id int, text string")
    post, size = search.postings(df, "chunk_id", F.col("text")), search.lengths(df, "chunk_id", F.col("text"))
    words = {i: (t or "").replace(",", "").split() for i, t in texts.items()}
    avg = sum(map(len, words.values())) / 5

    def score(i, q, k=1.2, b=0.75):
        out = 0
        for t in q:
            n, tf = sum(t in w for w in words.values()), words[i].count(t)
            out += math.log10((5 - n + 0.5) / (n + 0.5) + 1) * tf * (k + 1) / (tf + k * (1 - b + b * len(words[i]) / avg))
        return out

    got = {r.id: r.score for r in search.bm25(post, size, "Largest planet! rings rings").collect()}
    assert set(got) == {1, 2, 3} and all(abs(v - score(i, ["largest", "planet", "rings"])) < 1e-9 for i, v in got.items())
    assert [r.id for r in search.bm25(post, size, "largest planet", conjunctive=True).collect()] == [3]
    assert search.bm25(post, size, " ?! ").count() == 0
    top = search.bm25_top(df, search.bm25(post, size, "rings"), 3).collect()
    assert [r.chunk_id for r in top] == [2, 1, 3] and top[1].metric_value is None
    assert search.bm25_top(df, search.bm25(post, size, "rings"), 3, drop_unmatched=True).count() == 1


def test_stems():
    pairs = "caresses:caress ponies:poni agreed:agre plastered:plaster motoring:motor sized:size hopping:hop falling:fall happy:happi relational:relat vietnamization:vietnam formality:formal hopeful:hope allowance:allow adoption:adopt rate:rate roll:roll sky:sky"
    assert all(stem(a) == b for a, b in (p.split(":") for p in pairs.split()))
    assert analyse("The Largest RINGS, of été!") == ["largest", "ring", "et"]
    assert analyse(None) == []


def test_match_all(spark):
    df = spark.createDataFrame([(1, "The red fox"), (2, "red dog"), (3, None)], "id int, text string")
    assert [r.id for r in df.where(search.matches_all(F.col("text"), "Red, the")).collect()] == [1]
    assert df.where(search.matches_all(F.col("text"), "...")).count() == 0
    ranks = df.where("id < 3").select(search.rank_all(F.col("text"), "red fox").alias("r")).collect()
    assert ranks[0].r > ranks[1].r > 0


CHUNK = "origin string, start_index int, end_index int, text string, chunk_ids array<int>, metrics array<struct<name string, value double>>, context string, tenant string, arrival long"


def chunk(o, s, t, i, tenant=None, context=None, arrival=None):
    return (o, s, s + len(t), t, [i], [("m", float(i))], context, tenant, i if arrival is None else arrival)


def merged(spark, rows, attributes=()):
    return sorted(search.deoverlap(spark.createDataFrame(rows, CHUNK), attributes).collect(), key=lambda r: (r.origin, r.start_index))


def test_deoverlap(spark):
    rows = [chunk("a", 6, "6789X", 3), chunk("a", 0, "01234", 1, "docs", "h1"), chunk("a", 3, "34567", 2, None, "h2")]
    (r,) = merged(spark, rows, ["tenant"])
    assert (r.start_index, r.end_index, r.char_count, r.text, r.chunk_ids, r.context) == (0, 11, 11, "0123456789X", [1, 2, 3], "h1")
    assert [m.value for m in r.metrics] == [1.0, 2.0, 3.0] and r.tenant == ["docs", None, None]
    assert len(merged(spark, [chunk("a", 0, "01234", 1), chunk("a", 5, "56789", 2)])) == 2
    (r,) = merged(spark, [chunk("a", 0, "0123456789X", 1), chunk("a", 3, "34567", 2)])
    assert (r.text, r.end_index, len(r.metrics)) == ("0123456789X", 11, 2)
    assert len(merged(spark, [chunk("a", 0, "01234", 1), chunk("b", 2, "23456", 2)])) == 2
    again = search.deoverlap(search.deoverlap(spark.createDataFrame(rows, CHUNK)).withColumn("tenant", F.lit(None).cast("string")))
    assert again.count() == 1 and merged(spark, []) == []


def test_own_merge(spark):
    rows = spark.createDataFrame([chunk("a", 0, "01234", 1), chunk("a", 3, "34567", 2), chunk("a", 20, "x", 3)], CHUNK)
    out = search.deoverlap_with(rows, lambda p: {"origin": p["origin"].iloc[0], "n": len(p)}, "origin string, n long").collect()
    assert sorted(r.n for r in out) == [1, 2]


def test_fusion_order(spark):
    make = lambda rows: spark.createDataFrame(rows, "origin string, chunk_id int, metrics array<struct<name string, value double>>, arrival int")
    a, b = make([("x", 1, [("v", 0.1)], 1), ("x", 2, [("v", 0.2)], 2)]), make([("x", 2, [("k", 9.0)], 1), ("y", 7, [("k", 8.0)], 2)])
    out = search.fuse_methods([a, b]).orderBy("arrival").collect()
    assert [r.chunk_id for r in out] == [1, 2, 7] and [m.name for m in out[1].metrics] == ["v", "k"]


def test_tool_json(spark):
    df = spark.createDataFrame([(2, "h", "two"), (1, None, "one")], "arrival int, context string, text string")
    assert search.tool_json(df).collect()[0].json == '[{"text":"one"},{"context":"h","text":"two"}]'


def test_batch_asks_any_number_of_queries(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "id int, v array<double>")
    ask = dict(vec_col="v", id_col="id", query_id="q", query_vec="v")
    queries = df.withColumnRenamed("id", "q")
    rows = [{tuple(r) for r in search.vector_top_batch(df, queries, 3, **ask, max_queries=n).collect()} for n in (40, 7)]
    assert rows[0] == rows[1] and len(rows[0]) == 120


def test_scores_without_an_index_equal_those_of_postings(spark):
    rows = [(i, " ".join(("ring ice moon red of" .split() * 3)[i % 4 : i % 4 + 1 + i % 7])) for i in range(40)] + [(90, None), (91, ""), (92, "Ring, RING; ring!")]
    df = spark.createDataFrame(rows, "chunk_id int, text string")
    post, size = search.postings(df, "chunk_id", F.col("text")), search.lengths(df, "chunk_id", F.col("text"))
    for q, both in (("Ring moon", False), ("ring ice", True), ("absent", False)):
        want = {r.id: round(r.score, 9) for r in search.bm25(post, size, q, conjunctive=both).collect()}
        assert {r.id: round(r.score, 9) for r in search.bm25_scan(df, "chunk_id", F.col("text"), q, conjunctive=both).collect()} == want
    assert search.bm25_scan(df, "chunk_id", F.col("text"), " ?!").count() == 0 == search.bm25_scan(df.limit(0), "chunk_id", F.col("text"), "ring").count()
