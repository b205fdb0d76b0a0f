import re

import pytest
from pyspark.sql import functions as F

from tidemark.embed import QUERY, HashingEmbedding, embed_column, provider_from_config
from tidemark.embed import remote
from tidemark.sources import crawl as C
from tidemark.sources import html as H

PAGE = """<html><head><title>The  page</title><style>x</style></head><body><nav><a href="/nav">n</a></nav><main>
<h1>Head <em>one</em></h1><p>Text with <a href=" /b#x ">a link</a>, <b>bold</b> and <code>code</code>.<br>Next</p>
<ul><li>one</li><li>two<ol><li>in</li></ol></li></ul><pre class="sourceCode r"><code>f(x)
</code></pre><blockquote><p>said</p></blockquote><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2|3</td></tr></table></main><aside>side</aside></body></html>"""


def test_html_to_markdown(spark):
    md = H.read_html(PAGE)
    assert md.startswith("# The page\n\n# Head *one*") and "side" not in md and "[n]" not in md
    assert "[a link](/b#x), **bold** and `code`.\nNext" in md and "* two" in md and "  1. in" in md and "```r\nf(x)\n```" in md
    assert "> said" in md and "| a | b |\n| --- | --- |\n| 1 | 2\\|3 |" in md
    assert "side" in H.read_html(PAGE, extract=[], zap=["nav"]) and "side" not in H.read_html(PAGE, extract=["#none"], zap=["aside", "nav"])
    assert H.read_html("a\fb", [], []) == "a b" and H.read_html("<pre>a\fb</pre>", [], []) == "```\na\n\n---\n\nb\n```"
    got = spark.createDataFrame([(PAGE,), (None,), ("",)], "h string").select(H.markdown_column(F.col("h")).alias("m")).collect()
    assert [r.m for r in got] == [md, None, ""]


def test_fences():
    assert H.widen_fence("```\n```{r}\nfoo\n```\n```") == "````\n```{r}\nfoo\n```\n````" and H.widen_fence("```\nx\n```") == "```\nx\n```"
    assert H.widen_fence("```\n````\n```\n```\n").startswith("`````\n")
    assert H.add_info("```\nx\n```", ["py", "x"]) == "```py x\nx\n```" and H.add_info("```py\nx", ["py"]) == "```py\nx"
    assert H.add_info("text", ["py"]) == "text" and H.add_info("```\nx", ["a", "sourceCode", "r", "b"]) == "```r\nx"


def test_links(spark):
    site = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> http://a.com/1 </loc></url></urlset>'
    assert H.page_links(PAGE) == ["/b#x", "/nav"] and H.page_links(site) == ["http://a.com/1"] and H.page_links(None) == []
    df = spark.createDataFrame([(PAGE, "[a](/x) ![i](y.png) [b](z w)")], "h string, m string")
    r = df.select(H.href_column(F.col("h")), H.markdown_links(F.col("m"))).collect()[0]
    assert r[0] == ["/b#x", "/nav"] and r[1] == ["/x", "y.png"]


PAGES = [
    ("http://a.com", '<a href="/b">b</a><a href="/c#f">c</a><a href="http://x.org/">x</a><a href="mailto:y@z">m</a>', None), ("http://a.com/b", '<a href="/d">', None),
    ("http://a.com/c", '<a href="/b"><a href="/e.md">', None), ("http://a.com/d", "", None), ("http://a.com/e.md", '<a href="/">', None),
    ("http://x.org", '<a href="/q">', None), ("http://x.org/q", "", None), ("http://sub.a.com", "", None), ("http://r.com", '<a href="/z"><a href="http://r.com/y">', "http://new.com/"), ("http://new.com/z", "", None),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "origin string, body string, resolved_origin string")


def found(spark, pages, *roots, **k):
    return [r.origin for r in C.crawl(spark, C.Scope(roots, **k), C.fetch_from(pages)).select("origin").collect()]


def test_crawl(spark, pages):
    a = "http://a.com"
    assert found(spark, pages, a + "/") == [a, a + "/b", a + "/c", a + "/d", a + "/e.md"]
    assert found(spark, pages, a, depth=0) == [a] and found(spark, pages, a, depth=1, limit=2) == [a, a + "/b"] and found(spark, pages, a, limit=0) == []
    assert found(spark, pages, a, exclude_patterns=["**/c"]) == [a, a + "/b", a + "/d"]
    assert found(spark, pages, a, include_patterns=["**/d"]) == [a + "/d"]  # what isn't reported is still followed
    assert found(spark, pages, a, include_types=["markdown"]) == [a + "/e.md"]
    assert "http://x.org/q" in found(spark, pages, a, include_external_links=True)
    assert found(spark, pages, "http://r.com") == ["http://r.com", "http://new.com/z"]  # the scope follows a redirect
    with pytest.raises(ValueError):
        found(spark, pages, "/local")


def test_find_links(spark, pages):
    get = lambda *a, **k: sorted(r.origin for r in C.find_links(spark, *a, **k).collect())
    fetch = C.fetch_from(pages)
    assert get("http://a.com", fetch) == ["http://a.com", "http://a.com/b", "http://a.com/c", "http://x.org"]
    assert get("http://a.com", fetch, depth=1, children_only=True) == ["http://a.com", "http://a.com/b", "http://a.com/c", "http://a.com/d", "http://a.com/e.md"]
    assert get("http://a.com", fetch, keep=lambda c: ~c.contains("x.org"), known=pages.where("origin <> 'http://a.com/c'")) == ["http://a.com", "http://a.com/b"]
    status = spark.createDataFrame([("http://a.com", 200), ("http://a.com/b", 404)], "origin string, status_code int")
    assert C.valid_targets(pages, status).count() == 1


def test_breadth_first(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 1), (3, 4)], "src long, dst long")
    roots = spark.createDataFrame([(1,)], "node long")
    assert {tuple(r) for r in C.bfs(edges, roots, 5).collect()} == {(1, 0), (2, 1), (3, 1), (4, 2)} and C.bfs(edges, roots, 1).count() == 3


def test_documents_in_order(spark, pages):
    rows = C.markdown_documents(spark, C.Scope(["http://a.com"]), C.fetch_from(pages.withColumn("content_type", F.lit("text/html; x")))).collect()
    assert [r.origin for r in rows][:2] == ["http://a.com", "http://a.com/b"] and "[b](/b)" in rows[0].content


def test_directories(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, body in (("a.md", "# A"), ("b.html", "<p>x</p>"), ("sub/c.txt", "t"), ("sub/d.pdf", "%PDF")):
        (tmp_path / name).write_text(body)
    root = str(tmp_path)
    rows = C.directory_sources(spark, root).collect()
    assert [r.origin.removeprefix(root) for r in rows] == ["/a.md", "/b.html", "/sub/c.txt", "/sub/d.pdf"] and rows[0].size == 3
    got = lambda **k: [r.origin.removeprefix(root) for r in C.directory_sources(spark, root, C.Scope([root], **k)).collect()]
    assert got(depth=0) == ["/a.md", "/b.html"] and got(include_types=["text"]) == ["/sub/c.txt"] and got(exclude_patterns=["**.html"], limit=2) == ["/a.md", "/sub/c.txt"]
    docs = {r.origin.removeprefix(root): r.content for r in C.read_as_markdown(spark, root).collect()}
    assert docs == {"/a.md": "# A", "/b.html": "x", "/sub/c.txt": "t", "/sub/d.pdf": None}


def test_cache(spark, pages, tmp_path):
    cache = C.SourceCache(spark, str(tmp_path / "c"))
    calls = []

    def fetch(origins):
        calls.append(origins.count())
        return C.fetch_from(pages)(origins)

    at = lambda s: F.timestamp_seconds(F.lit(s))
    some = pages.select("origin").limit(3)
    assert C.cached_fetch(cache, fetch, at(1000), "1 day")(some).count() == 3
    assert C.cached_fetch(cache, fetch, at(2000), "1 day")(pages.select("origin")).count() == len(PAGES)
    assert calls == [3, len(PAGES) - 3]
    same = lambda o: o.select("origin", F.lit(304).alias("status_code"))
    assert C.cached_fetch(cache, fetch, at(500_000), "1 day", same)(some).count() == 3 and calls[-1] == 0
    assert C.cached_fetch(cache, fetch, at(500_100), "1 day")(some).count() == 3 and calls[-1] == 0
    cache.delete(some)
    assert cache.entries().count() == len(PAGES) - 3
    df = spark.createDataFrame([(None, None)], "a timestamp, b timestamp")
    assert df.select(C.is_fresh(F.col("a"), F.col("b"), at(0), "1 day"), C.is_fresh(F.col("a"), F.col("b"), at(0), None)).collect()[0][:] == (False, True)


def test_remote_crawl():
    asked, states = [], iter(["running", "completed"])
    pages = {None: ([{"url": "http://a.com/x/", "status": "completed"}, {"url": "http://a.com/y", "status": "errored"}], "2"), "2": ([{"url": "http://a.com/skip", "status": "completed"}], None)}
    out = C.remote_crawl(lambda body: asked.append(body) or "job", lambda _: next(states), lambda _, c: pages[c], C.Scope(["http://a.com"], include_patterns=[re.compile("a.com")], exclude_patterns=["**/skip"]))
    assert [r["url"] for r in out] == ["http://a.com/x/"] and asked[0]["includePatterns"] == [] and asked[0]["excludePatterns"] == ["**/skip"]
    with pytest.raises(RuntimeError):
        C.remote_crawl(lambda b: "j", lambda _: "errored", lambda *_: ([], None), C.Scope(["http://a.com"]))
    with pytest.raises(TimeoutError):
        C.remote_crawl(lambda b: "j", lambda _: "running", lambda *_: ([], None), C.Scope(["http://a.com"]), polls=2)


def test_embeddings(spark):
    p = HashingEmbedding(16)
    a, b = p.embed(["one two", "two one"])
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-6 and p.embed([]) == [] and p.dimension() == 16
    with pytest.raises(TypeError):
        p.embed("text")
    with pytest.raises(ValueError, match=r"\[1, 2\]"):
        p.embed(["x", "", " "])
    assert provider_from_config(p.config()).dim == 16 and provider_from_config(None) is None
    with pytest.raises(ValueError, match="hashing"):
        provider_from_config({"type": "unknown"})
    got = spark.createDataFrame([("one two",), (None,)], "t string").select(embed_column(F.col("t"), p, QUERY).alias("v")).collect()
    assert [round(x, 6) for x in got[0].v] == [round(x, 6) for x in a] and got[1].v is None


def test_remote_embeddings(monkeypatch):
    import io
    import urllib.error

    sent, fail = [], [2]

    def post(url, body, headers, timeout=60):
        sent.append((url, body))
        if fail[0]:
            fail[0] -= 1
            raise urllib.error.HTTPError(url, 429, "slow", {"x-ratelimit-reset-requests": "8s"}, io.BytesIO(b""))
        return {"data": [{"index": i, "embedding": [float(i)]} for i in reversed(range(len(body["input"])))]}

    waits = []
    monkeypatch.setattr(remote, "post", post)
    patient = remote.patiently
    monkeypatch.setattr(remote, "patiently", lambda call, wait: patient(call, wait, sleep=waits.append))
    p = provider_from_config({"type": "ollama", "prompts": {"query": "q: "}, "batch_size": 2})
    assert p.embed(["a", "b", "c"], QUERY) == [[0.0], [1.0], [0.0]] and waits == [2.0, 2.0]
    assert sent[-1][1]["input"] == ["q: c"] and "key" not in str(p.config()).lower()
    assert remote.duration_seconds("1m0.612s") == pytest.approx(60.612) and remote.duration_seconds("x") is None
    assert remote.rate_limit_wait({}, "Please try again in 20ms.") == 0.1 and remote.rate_limit_wait({}, "") == 1.0
    c = provider_from_config({"type": "cohere"})
    assert c.body(["x"], QUERY)["input_type"] == "search_query" and c.batch_size == 96 and c.wait(9, {}, "") == 60.0
    assert provider_from_config({"type": "nvidia"}).body(["x"], "document")["input_type"] == "passage"


def test_cache_of_many_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "MOST_PARTS", 3)
    cache = C.SourceCache(spark, str(tmp_path / "parts"))
    for n in range(5):
        cache.upsert(spark.createDataFrame([("a", f"a{n}"), (f"b{n}", "b")], "origin string, body string"))
        if n == 1:
            cache.delete(spark.createDataFrame([("b0",)], "origin string"))
    assert {r.origin: r.body for r in cache.entries().collect()} == {"a": "a4", "b1": "b", "b2": "b", "b3": "b", "b4": "b"}
    assert len(cache._parts()) < 3
