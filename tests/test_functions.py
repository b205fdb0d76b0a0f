import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import urls
from tidemark.functions.arrays import nearest, offsets


def column(spark, values, expr, *types):
    df = spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], ", ".join(f"c{i} {t}" for i, t in enumerate(types or ["string"])))
    return [r[0] for r in df.select(expr(*(F.col(f"c{i}") for i in range(len(types or [1]))))).collect()]


def test_finish_markdown(spark):
    got = column(spark, [("  a\fb \n", "T"), ("# T\n\nx", "T"), ("x", None)], X.finish_markdown, "string", "string")
    assert got == ["# T\n\na\n\n---\n\nb", "# T\n\nx", "x"]


def test_types(spark):
    assert column(spark, ["Text/HTML; charset=x", None, ""], X.content_type) == ["text/html", None, ""]
    rows = [("/a/b.MD", None), ("http://x/y", "text/html;q"), ("/a/.md", None), ("/a.b/c", "x/y"), ("n.ipynb", "text/html")]
    assert column(spark, rows, X.type_label, "string", "string") == ["markdown", "html", None, None, "jupyter-notebook"]
    assert column(spark, rows, X.body_suffix, "string", "string") == [".md", ".html", ".bin", ".bin", ".html"]
    assert column(spark, [" tar.GZ ", ".HTML", "..", "", None, "a b!"], X.extension) == [".tar.gz", ".html", None, None, None, ".ab"]


def test_cache_key(spark):
    long = "http://h/" + "a" * 400
    got = column(spark, ["http://a.com/x y?q=1", "", "CON.txt", "///", long], X.cache_key)
    assert got[0].startswith("http__a.com_x_y_q_1--") and got[0].endswith(hashlib.sha256(b"http://a.com/x y?q=1").hexdigest()[:12])
    assert got[1].startswith("entry--") and got[2].startswith("_CON.txt--") and got[3].startswith("entry--") or got[3].startswith("_")
    assert len(got[4]) == 180 + 2 + 12 and ".." in got[4]


def test_seconds_and_prompts(spark):
    got = column(spark, ["1m0.612s", "350ms", "2h", "nonsense", "6s", None], X.seconds)
    assert [round(x, 3) if x is not None else None for x in got] == [60.612, 0.35, 7200.0, None, 6.0, None]
    assert column(spark, ["x"], lambda c: X.prompted("query: ", c)) == ["query: x"]


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTP://Example.COM:80/", "http://example.com"), ("https://Example.com:443/a?b=1#c", "https://example.com/a?b=1"), ("https://u:P@h:8443/", "https://u:P@h:8443"),
        ("ftp://x/", None), ("http:///x", None), ("http://h:99999/", None), ("", None), (None, None), ("http://h/A%20b", "http://h/A%20b"),
    ],
)
def test_canonical(spark, url, want):
    assert urls.canonical_url(url) == want
    if url and url.startswith("http") and "99999" not in url:
        assert column(spark, [url], urls.canonical_absolute) == [want]


def test_relative_addresses():
    assert urls.canonical_url("../c?x#y", "http://a.com/b/d") == "http://a.com/c?x"
    assert urls.file_path("file:///C:/a%20b") == "C:/a b" and urls.file_path("file:///tmp/x") == "/tmp/x" and urls.file_uri("/tmp/x") == "file:///tmp/x"
    assert urls.find_target("file:///tmp/x#y") == "/tmp/x"


def test_scopes(spark):
    rows = [("https://a.com/x", "https://a.com"), ("https://b.a.com", "https://a.com"), ("http://a.com", "https://a.com"), ("https://xa.com", "https://a.com"), ("https://a.com:443/y", "https://a.com")]
    assert column(spark, rows, urls.in_scope, "string", "string") == [True, False, False, False, True]
    assert column(spark, rows, lambda a, b: urls.in_scope(a, b, subdomains=True), "string", "string") == [True, True, False, False, True]
    assert all(column(spark, rows, lambda a, b: urls.in_scope(a, b, external=True), "string", "string"))
    assert column(spark, ["https://www.A.com/x"], urls.redirect_host) == ["a.com"]


@pytest.mark.parametrize(
    "pattern, url, want",
    [
        ("https://a.com/docs/**", "https://a.com/docs", True), ("https://a.com/docs/**", "https://a.com/docs/x/y", True), ("https://a.com/docs/**", "https://a.com/docsx", False),
        ("https://a.com/*", "https://a.com/x", True), ("https://a.com/*", "https://a.com/x/y", False), ("**/x", "https://a.com/b/x", True), ("a.c", "abc", False), ("*.pdf", "f.pdf", True),
    ],
)
def test_globs(spark, pattern, url, want):
    assert bool(re.fullmatch(urls.glob_regex(pattern), url)) is want
    assert column(spark, [url], lambda c: urls.matches(c, [pattern])) == [want]


def test_patterns_and_labels(spark):
    assert column(spark, ["a/x", "a/y", "b"], lambda c: urls.matches(c, ["a/*"], [re.compile("y$")])) == [True, False, False]
    assert column(spark, ["a", "b"], lambda c: urls.matches(c)) == [True, True]
    assert column(spark, ["html", "PDF", None], lambda c: urls.matches_types(c, ["html", "pdf"], ["pdf"])) == [True, False, False]
    assert column(spark, ["html", None], lambda c: urls.matches_types(c, (), ["html"])) == [False, True]


def test_arrays(spark):
    values = [[3, 1, 2] * 100, [], [5]]
    got = column(spark, [(v,) for v in values], offsets, "array<int>")
    assert got == [[sum(v[:i]) for i in range(len(v))] for v in values]
    assert column(spark, [(10, [8, 12, 30]), (10, [1]), (10, [])], lambda x, c: nearest(x, c, 2), "int", "array<int>") == [8, None, None]
