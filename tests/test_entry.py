"""The driver's contract."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

ROOT = Path(__file__).resolve().parent.parent


def test_smoke_query(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "start_index", "end_index", "text", "metric_value"}


def test_names():
    known, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(known) and "p4_found" in known and len(sql) > 50


def test_import_needs_no_session():
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120, check=True).stdout


def test_nothing_outside_imports_the_training_data_operators():
    for path in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in path.parts:
            assert "tidemark.llm" not in path.read_text(), path


@pytest.mark.parametrize("name", ["filter_in", "chunk_snap_sentence_line_word", "bm25_topk", "deoverlap_islands", "upsert_actions", "canonical_urls", "crawl_bfs", "p4_found"])
def test_queries_equal_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "stored_chunks", "retrieved_chunks", "fetched_sources", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert got == sorted(map(repr, want))
