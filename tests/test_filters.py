import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import filters as f

ROWS = [(1, "docs", 1, True), (2, "docs", 3, False), (3, "blog", 5, True), (4, None, None, None), (5, "it's", -2, True)]


@pytest.fixture(scope="module")
def df(spark):
    d = spark.createDataFrame(ROWS, "chunk_id int, tenant string, priority int, is_public boolean")
    return d.withColumn("details", F.struct(F.col("tenant").alias("source"), F.struct(F.col("is_public").alias("on")).alias("flags")))


def ids(df, given):
    return sorted(r[0] for r in df.where(f.to_column(f.parse(given))).select("chunk_id").collect())


@pytest.mark.parametrize(
    "given, want",
    [
        ("tenant = 'docs'", [1, 2]), ("tenant != 'docs'", [3, 5]), ("priority >= 3 or tenant = 'it''s'", [2, 3, 5]),
        ("tenant = 'docs' AND (priority >= 2 OR is_public = TRUE)", [1, 2]), ("tenant in ('blog', 'x')", [3]), ("priority not in (1, 3)", [3, 5]),
        ("tenant IS NULL", [4]), ("tenant is not null and priority < 0", [5]), ("details.source = 'blog'", [3]), ("details.flags.on = false", [2]), ("priority > -2.5", [1, 2, 3, 5]),
        ({"type": "or", "filters": [{"type": "eq", "key": "tenant", "value": None}, {"type": "nin", "key": "priority", "value": [1, 3, 5]}]}, [4, 5]),
        ({"type": "ne", "key": "tenant", "value": None}, [1, 2, 3, 5]),
    ],
)
def test_rows(df, given, want):
    assert ids(df, given) == want


def test_emitters():
    t = f.parse("tenant = 'docs' AND (priority >= 2 OR is_public = TRUE)")
    assert f.to_sql(t) == '("tenant" = \'docs\' AND ("priority" >= 2 OR "is_public" = TRUE))'
    assert f.to_where(t) == {"$and": [{"tenant": {"$eq": "docs"}}, {"$or": [{"priority": {"$gte": 2}}, {"is_public": {"$eq": True}}]}]}
    assert f.to_typed(f.parse("n IN (1, 9007199254740993)")) == {"type": "in", "key": "n", "value": [1, 9007199254740993]}
    assert f.to_sql(f.parse("a.b.c IS NOT NULL")) == "struct_extract(struct_extract(\"a\", 'b'), 'c') IS NOT NULL"
    assert f.to_sql(f.parse("a.b != 'x'"), lambda p: f.sql_path(p, json=True)) == "\"a\"->>'b' != 'x'"
    with pytest.raises(TypeError):
        f.to_typed(f.parse("n in (TRUE)"))
    for emit in (f.to_where, f.to_typed):
        with pytest.raises(ValueError):
            emit(f.parse("n IS NULL"))


@pytest.mark.parametrize(
    "bad",
    ["tenant = NULL", "tenant > NULL", "tenant IN ()", "tenant IN ('a', NULL)", "NOT tenant = 'a'", "tenant <> 'a'", "tenant = 'a' extra", "tenant =", "(a = 1", "a = 'open", "a = 1e5", '"a" = 1', "a LIKE 'x'",
     {"type": "gt", "key": "a", "value": None}, {"type": "xx", "key": "a", "value": 1}, {"type": "in", "key": "a", "value": []}, {"type": "and", "filters": []}, {"key": "a"}, {}],
)
def test_errors(bad):
    with pytest.raises(ValueError):
        f.parse(bad)


def test_no_filter_and_unknown_columns():
    assert f.parse(None) is None and f.parse("  ") is None and f.to_column(None) is None
    with pytest.raises(ValueError, match="text"):
        f.parse("text = 'x'", f.BUILT_IN)
    with pytest.raises(TypeError):
        f.parse(5)


@given(st.text(max_size=20))
def test_strings_round_trip(value):
    quoted = "'" + value.replace("'", "''") + "'"
    assert f.parse(f"a = {quoted}") == f.Test("a", "eq", value)
