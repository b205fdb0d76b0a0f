import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators.intervals import IntervalMap, merge_intervals
from tidemark.plans.prefix import magnitude_bucket, running_sum

SCHEMA = "origin string, start_index int, end_index int, key string, s int, block int"


def brute(rows):
    by = {}
    for o, s, e in {r[:3] for r in rows}:
        if o is not None and s is not None and e is not None and 0 <= s < e:
            by.setdefault(o, []).append((s, e))
    out = set()
    for o, spans in by.items():
        periods = []
        for s, e in sorted(spans):
            if periods and s < periods[-1][1]:
                periods[-1][1] = max(periods[-1][1], e)
            else:
                periods.append([s, e])
        out |= {(o, "period", s, e) for s, e in periods}
        out |= {(o, "gap", a[1], b[0]) for a, b in zip(periods, periods[1:]) if b[0] > a[1]}
    return out


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 12)), max_size=30))
@settings(max_examples=200, deadline=None)
def test_map_equals_sorting(spans):
    m = IntervalMap()
    for s, n in spans:
        m.add(s, s + n)
    want = brute([("o", s, s + n) for s, n in spans])
    assert {("o", "period", s, e) for s, e in m} | {("o", "gap", s, e) for s, e in m.gaps()} == want


def test_dirty_spans_hot_entity_and_blocks(spark):
    r = random.Random(3)
    rows = [("hot", s := r.randrange(5000), s + r.randrange(1, 9), "x", 1, 2) for _ in range(900)]
    rows += [(f"o{r.randrange(20)}", s := r.randrange(300), s + r.randrange(-3, 60), "x", 1, 2) for _ in range(900)]
    rows += rows[:50] + [(None, 1, 5, None, None, None), ("n", None, 5, None, None, None), ("n", 2, None, None, None, None), ("n", -1, 4, None, None, None), ("t", 0, 5, None, None, None), ("t", 5, 9, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for block in (1 << 16, 64, 7):
        got = {tuple(x) for x in merge_intervals(df, "origin", "start_index", "end_index", block=block).collect()}
        assert got == brute(rows)
    assert ("t", "period", 0, 5) in got and ("t", "period", 5, 9) in got


def test_empty_table(spark):
    assert merge_intervals(spark.createDataFrame([], SCHEMA), "origin", "start_index", "end_index").count() == 0


def test_running_sum_spreads_a_hot_key(spark):
    rows = [("hot", float(i % 97), i, 1) for i in range(500)] + [(None, 1.0, 0, None), ("a", -2.0, 1, 5), ("a", 3.0, 2, 7)]
    df = spark.createDataFrame(rows, "k string, v double, id int, n int")
    out = running_sum(df, ["k"], magnitude_bucket(F.col("v")), [F.col("v"), F.col("id")], F.col("n"), "upto").collect()
    assert len(out) == len(rows)
    hot = sorted(((r.v, r.id), r.upto) for r in out if r.k == "hot")
    assert [u for _, u in hot] == list(range(1, 501))
    assert {r.upto for r in out if r.k == "a"} == {5, 12} and [r.upto for r in out if r.k is None] == [0]


def test_stream_of_intervals(spark, tmp_path):
    from tidemark.streaming.intervals import stream_intervals

    schema = "origin string, start_index int, end_index int"
    spark.createDataFrame([("a", 0, 5), ("a", 3, 9), ("a", 20, 25), (None, 1, 2), ("b", 4, 1)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    query = (
        stream_intervals(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "origin", "start_index", "end_index")
        .writeStream.outputMode("update").foreachBatch(lambda d, _: seen.extend(map(tuple, d.collect())))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert set(seen) == {("a", "period", 0, 9), ("a", "period", 20, 25), ("a", "gap", 9, 20)}


def test_salted_join_equals_a_join(spark):
    from tidemark.plans.skew import salted_join

    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)] + [(None, "hot"), (1, None)], "id int, k string")
    few = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), (None, 4)], "k string, v int")
    for salts in (1, 16):
        assert sorted(map(str, salted_join(rows, few, ["k"], "id", salts).collect())) == sorted(map(str, rows.join(few, "k").select("k", "id", "v").collect()))
