"""Registered queries of the store, of conversion and of crawls, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.embed.length import LengthEmbedding
from tidemark.functions.text import content_hash
from tidemark.operators import chunking
from tidemark.plans.durable import shared_folder
from tidemark.queries import _FIRST_D, _LATEST_D, _first, _latest, _table, query
from tidemark.sources import crawl, html
from tidemark.store import Store, store

ATTRIBUTES = {"tenant": str | None, "priority": int | None, "topic": str | None}
SIZE, STEP = 1600, 800

# ---------------------------------------------------------------------- store


def _chunked(versions: DataFrame) -> DataFrame:
    """Versions of documents (origin, text, tenant, priority, topic) with chunks at fixed strides, as a store takes them."""
    d = versions.where("text is not null and length(trim(text)) > 0").select("origin", F.col("text").alias("content"), *ATTRIBUTES)
    spans = chunking.target_spans(d, "origin", "content", SIZE, 0.5)
    one = F.struct("start_index", "end_index", (F.col("end_index") - F.col("start_index")).alias("char_count"), F.lit(None).cast("string").alias("context"))
    return d.join(spans.groupBy("origin").agg(F.collect_list(one).alias("chunks")), "origin")


def _stored(spark: SparkSession, folder: str, embed: bool = False) -> Store:
    """A new store of the latest version of every document."""
    made = Store.create(spark, shared_folder(spark, "store"), attributes=ATTRIBUTES, embed=LengthEmbedding() if embed else None)
    made.upsert(_chunked(_latest(spark, folder)))
    return made


_DOCS = f"d AS (SELECT origin, text, tenant, priority, topic, length(text) AS n FROM {_LATEST_D} WHERE text IS NOT NULL AND length(trim(text, ' ')) > 0)"
_CHUNKS = _DOCS + f""",
t AS (SELECT *, unnest(CASE WHEN n <= {SIZE} THEN [0::BIGINT] ELSE list_distinct(list_concat(range(0, n - {SIZE}, {STEP}), [n - {SIZE}])) END) AS s FROM d),
c AS (SELECT origin, tenant, priority, topic, s, CASE WHEN n <= {SIZE} THEN n ELSE s + {SIZE} END AS e, text FROM t),
k AS (SELECT origin, tenant, priority, topic, s, e, text[s + 1:e] AS chunk FROM c)
"""


@query(f"WITH {_DOCS} SELECT origin, sha256(text) AS hash FROM d")
def store_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Create a store, write the latest versions, read the documents back."""
    return _stored(spark, folder).documents.select("origin", content_hash(F.col("text")).alias("hash"))


@query(f"WITH {_CHUNKS} SELECT origin, CAST(s AS INTEGER) AS start_index, CAST(e AS INTEGER) AS end_index, CAST(e - s AS INTEGER) AS char_count, tenant, priority, topic, sha256(chunk) AS hash FROM k")
def store_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of a store with their attributes and the texts sliced for them."""
    c = _stored(spark, folder).chunks
    return c.select("origin", "start_index", "end_index", "char_count", *ATTRIBUTES, content_hash(F.col("text")).alias("hash"))


@query(f"WITH {_DOCS} SELECT count(*) AS documents FROM d")
def store_size(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame([(_stored(spark, folder).size(),)], "documents long")


@query(f"WITH {_CHUNKS} SELECT min(1) AS first_id, count(*) AS last_id, count(*) AS ids FROM k")
def store_ids(spark: SparkSession, folder: str) -> DataFrame:
    e = _stored(spark, folder).embeddings
    return e.agg(F.min("chunk_id").alias("first_id"), F.max("chunk_id").alias("last_id"), F.count_distinct("chunk_id").alias("ids"))


@query(f"""
WITH {_CHUNKS}
SELECT origin, any_value(tenant) AS tenant, any_value(priority) AS priority, any_value(topic) AS topic, array_to_string(list(s || '-' || e ORDER BY s, e), ' ') AS spans FROM k GROUP BY origin
""")
def store_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as it can be rebuilt: attributes, and spans in order."""
    s = _stored(spark, folder).snapshot()
    return s.select("origin", *ATTRIBUTES, F.array_join(F.transform("chunks", lambda c: F.concat_ws("-", c["start_index"], c["end_index"])), " ").alias("spans"))


_SECOND = f"""
WITH {_DOCS},
f AS (SELECT origin, text, tenant, priority, topic FROM {_FIRST_D} WHERE text IS NOT NULL AND length(trim(text, ' ')) > 0),
a AS (SELECT f.origin, CASE WHEN d.origin IS NULL THEN 'inserted' WHEN f.text <> d.text OR f.tenant IS DISTINCT FROM d.tenant OR f.priority IS DISTINCT FROM d.priority
      OR f.topic IS DISTINCT FROM d.topic THEN 'replaced' ELSE 'skipped' END AS action FROM f LEFT JOIN d ON f.origin = d.origin)
"""


@query(_SECOND + "SELECT origin, action FROM a")
def store_second_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Write the latest versions, then the first ones: what becomes of each document."""
    return _stored(spark, folder).upsert(_chunked(_first(spark, folder)))


@query(_SECOND + "SELECT count(*) FILTER (action = 'inserted') AS inserted, count(*) FILTER (action = 'replaced') AS replaced, count(*) FILTER (action = 'skipped') AS skipped FROM a")
def store_second_ingest(spark: SparkSession, folder: str) -> DataFrame:
    s = _stored(spark, folder).ingest(_first(spark, folder), _chunked)
    return spark.createDataFrame([(s.inserted, s.replaced, s.skipped)], "inserted long, replaced long, skipped long")


@query(_SECOND + ", r AS (SELECT origin FROM a WHERE action <> 'skipped') SELECT origin, sha256(text) AS hash FROM f SEMI JOIN r USING (origin) UNION ALL SELECT origin, sha256(text) FROM d ANTI JOIN r USING (origin)")
def store_after_replacing(spark: SparkSession, folder: str) -> DataFrame:
    """What a store holds after some of its documents were replaced."""
    s = _stored(spark, folder)
    s.upsert(_chunked(_first(spark, folder)))
    return s.documents.select("origin", content_hash(F.col("text")).alias("hash"))


@query(f"""
WITH {_CHUNKS}, v AS (SELECT abs(length(chunk) - 1234.0)::DOUBLE AS v FROM k WHERE priority >= 2 AND topic IS NOT NULL)
SELECT CAST(row_number() OVER (ORDER BY v) AS INTEGER) AS arrival, v AS metric_value FROM v ORDER BY v LIMIT 25
""")
def store_retrieve_vss(spark: SparkSession, folder: str) -> DataFrame:
    """The 25 chunks nearest to a vector under a filter; vectors are lengths, so SQL can tell the distances."""
    found = _stored(spark, folder, embed=True).retrieve_vss([1234.0], 25, method="euclidean_distance", attributes_filter="priority >= 2 AND topic IS NOT NULL")
    return found.select("arrival", "metric_value")


@query(f"""
WITH {_CHUNKS}, v AS (SELECT abs(length(chunk) - 700.0)::DOUBLE AS v FROM k)
SELECT CAST(row_number() OVER (ORDER BY v) AS INTEGER) AS arrival, v AS metric_value FROM v ORDER BY v LIMIT 15
""")
def store_retrieve_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """The 15 chunks nearest to a vector by the index of vectors: only the cells around it are read."""
    s = _stored(spark, folder, embed=True)
    s.build_index("vss")
    return s.retrieve_vss([700.0], 15, method="euclidean_distance").select("arrival", "metric_value")


@query(f"""
WITH {_CHUNKS}, w AS (SELECT origin, s, list_distinct(regexp_split_to_array(lower(chunk), '[^a-z0-9]+')) AS w FROM k WHERE tenant = 'museum')
SELECT origin, CAST(s AS INTEGER) AS start_index FROM w WHERE list_has_all(w, ['the', 'decoder', 'which'])
""")
def store_retrieve_fts(spark: SparkSession, folder: str) -> DataFrame:
    """All chunks of a tenant that hold every word."""
    found = _stored(spark, folder).retrieve_fts("The decoder, which", 1_000_000, attributes_filter="tenant = 'museum'")
    return found.select("origin", "start_index")


@query(f"""
WITH {_CHUNKS}, w AS (SELECT regexp_split_to_array(lower(strip_accents(chunk)), '[^a-z0-9]+') AS w FROM k),
n AS (SELECT count(*) AS n, count(*) FILTER (list_contains(w, 'lantern') OR list_contains(w, 'lanterns')) AS df FROM w)
SELECT df AS scored, n - df AS unscored FROM n
""")
def store_retrieve_bm25(spark: SparkSession, folder: str) -> DataFrame:
    """Stemmed keyword search for all chunks: those with the word in any number are scored, the others follow without a score."""
    s = _stored(spark, folder)
    s.build_index("bm25")
    found = s.retrieve_bm25("Lanterns", 10_000_000)
    return found.agg(F.count("metric_value").alias("scored"), F.count_if(F.col("metric_value").isNull()).alias("unscored"))


# ------------------------------------------------------------ pages and links


def _html(title, number, lang) -> F.Column:
    return F.concat(
        F.lit("<!doctype html><html><head><title>"), title, F.lit("</title><style>p { color: red }</style></head><body><nav><a href='/'>Home</a></nav><main><h1>Page "), number,
        F.lit("</h1>\n<p>Written in <b>"), lang, F.lit("</b> &amp; <a href='/about'>kept</a>.</p><ul><li>one</li><li>two</li></ul><pre class='sourceCode python'>x = "), number,
        F.lit("</pre><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table></main><aside>gone</aside></body></html>"),
    )


@query("""
WITH d AS (SELECT doc_id, coalesce(trim(topic), 'untitled') AS title, coalesce(nullif(trim(lang), ''), 'none') AS lang FROM documents)
SELECT doc_id, '# ' || title || chr(10) || chr(10) || '# Page ' || doc_id || chr(10) || chr(10) || 'Written in **' || lang || '** & [kept](/about).' || chr(10) || chr(10) || '* one' || chr(10) || '* two'
    || chr(10) || chr(10) || '```python' || chr(10) || 'x = ' || doc_id || chr(10) || '```' || chr(10) || chr(10) || '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | 2 |' AS content FROM d
""")
def html_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """A page made of each document's fields, as Markdown: main part only, without navigation, headed by its title."""
    d = _table(spark, folder, "documents")
    page = _html(F.coalesce(F.trim("topic"), F.lit("untitled")), F.col("doc_id").cast("string"), F.coalesce(F.nullif(F.trim("lang"), F.lit("")), F.lit("none")))
    return d.select("doc_id", html.markdown_column(page).alias("content"))


@query(r"""
WITH l AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '\[[^\]\n]*\]\(([^()\s]+)\)', 1))) AS links FROM documents)
SELECT doc_id, unnest(links) AS link FROM l
""")
def page_links(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's links, written as anchors of a page and found there again, each once."""
    d = _table(spark, folder, "documents").select("doc_id", html.markdown_links(F.col("text")).alias("links"))
    quoted = F.transform("links", lambda x: F.concat(F.lit('<a class="x" href=" '), F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit('">y</a>')))
    body = F.concat(F.lit("<p>"), F.array_join(quoted, " "), F.lit("</p><a name='z'>no link</a>"))
    return d.select("doc_id", F.explode(html.links_column(body)).alias("link"))


_PLAIN = "^https://[a-z0-9.-]+/[A-Za-z0-9._/-]*[A-Za-z0-9._-]$"


def _site_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages (origin, host, r, body) of the addresses among the documents; page r of a host, in order of address, links to pages 2r + 1 and 2r + 2, and out of the site."""
    from pyspark.sql import Window

    o = _table(spark, folder, "documents").select("origin").distinct().where(F.col("origin").rlike(_PLAIN)).withColumn("host", F.regexp_extract("origin", "^https://([^/]+)/", 1))
    o = o.withColumn("r", F.row_number().over(Window.partitionBy("host").orderBy("origin")) - 1)
    up = o.where("r > 0").select("host", F.floor((F.col("r") - 1) / 2).cast("int").alias("r"), F.concat(F.lit("<a href='"), "origin", F.lit("#top'>x</a>")).alias("a"))
    links = up.groupBy("host", "r").agg(F.array_join(F.collect_list("a"), "").alias("links"))
    body = F.concat(F.lit("<html><body><a href='https://elsewhere.example/'>out</a>"), F.coalesce("links", F.lit("")), F.lit("</body></html>"))
    return o.join(links, ["host", "r"], "left").select("origin", "host", "r", body.alias("body"), F.lit("text/html").alias("content_type"))


_PAGES = f"""
WITH o AS (SELECT DISTINCT origin, regexp_extract(origin, '^https://([^/]+)/', 1) AS host FROM documents WHERE regexp_matches(origin, '{_PLAIN}')),
r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY origin) - 1 AS r FROM o)
"""


@query(_PAGES + "SELECT origin, CAST(floor(log2(r + 1) + 1e-9) AS INTEGER) AS depth FROM r")
def crawl_sites(spark: SparkSession, folder: str) -> DataFrame:
    """Crawl every site from its first page, breadth first, within the site."""
    pages = _site_pages(spark, folder)
    roots = [x[0] for x in pages.where("r = 0").select("origin").orderBy("origin").collect()]  # one a site
    return crawl.crawl(spark, crawl.Scope(roots), crawl.fetch_from(pages.drop("host", "r"))).select("origin", "depth")


@query(_PAGES + "SELECT origin FROM r WHERE r < 7")
def find_site_links(spark: SparkSession, folder: str) -> DataFrame:
    """The pages that lie two links deep in each site: links found at depth 1 are reported, not followed."""
    pages = _site_pages(spark, folder)
    starts = [x[0] for x in pages.where("r = 0").select("origin").collect()]  # one a site
    found = crawl.find_links(spark, starts, crawl.fetch_from(pages.drop("host", "r")), depth=1)
    return found.where(~F.startswith("origin", F.lit("https://elsewhere.example")))


@query("""
WITH s AS (SELECT DISTINCT origin FROM documents WHERE origin IS NOT NULL),
k AS (SELECT DISTINCT origin FROM fetched_sources WHERE coalesce(status_code, 200) < 400)
SELECT origin FROM s SEMI JOIN k USING (origin)
""")
def valid_links(spark: SparkSession, folder: str) -> DataFrame:
    """The documents' addresses that were fetched without an error at least once."""
    o = _table(spark, folder, "documents").select("origin").where("origin is not null").distinct()
    return crawl.valid_targets(o, _table(spark, folder, "fetched_sources"))
