"""The registered queries of the engine over whole tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import urls
from tidemark.operators import chunking, filters, search
from tidemark.operators.intervals import merge_intervals
from tidemark.plans.durable import cut
from tidemark.sources import crawl, html
from tidemark.store import store
from tidemark.streaming.ingest import duplicate_origins

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The search that the keyword queries ask, and the vector that the vector queries ask with.
WORDS, PROBE = "rare lantern of the decoder", 7
SPACE = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# ------------------------------------------------------------------ intervals


@query("""
WITH s AS (SELECT DISTINCT origin, start_index s, end_index e FROM stored_chunks
           WHERE origin IS NOT NULL AND start_index >= 0 AND start_index < end_index),
m AS (SELECT *, max(e) OVER (PARTITION BY origin ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pe FROM s),
i AS (SELECT *, sum(CASE WHEN pe IS NULL OR s >= pe THEN 1 ELSE 0 END) OVER (PARTITION BY origin ORDER BY s, e) k FROM m),
p AS (SELECT origin, min(s) s, max(e) e FROM i GROUP BY origin, k),
g AS (SELECT origin, lag(e) OVER (PARTITION BY origin ORDER BY s) pe, s FROM p)
SELECT origin, 'period' AS kind, CAST(s AS INTEGER) AS range_start, CAST(e AS INTEGER) AS range_end FROM p
UNION ALL
SELECT origin, 'gap', CAST(pe AS INTEGER), CAST(s AS INTEGER) FROM g WHERE pe < s
""")
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return merge_intervals(_table(spark, folder, "stored_chunks"), "origin", "start_index", "end_index")


# ---------------------------------------------------------- scans and filters


@query("SELECT doc_id, origin, lang, n_chars FROM documents")
def doc_scan_project(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "documents").select("doc_id", "origin", "lang", "n_chars")


@query("SELECT doc_id, origin, text FROM documents WHERE doc_id = 42")
def doc_point_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "documents").where("doc_id = 42").select("doc_id", "origin", "text")


def _filtered(given: str | dict, columns: list[str]) -> Query:
    allowed = ["doc_id", "tenant", "priority", "topic", "lang", "n_chars"]

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _table(spark, folder, "documents").where(filters.to_column(filters.parse(given, allowed))).select(*columns)

    return run


for _name, _given, _where in (
    ("filter_eq_and_or", "tenant = 'museum' AND (priority >= 2 OR topic = 'index')", "tenant = 'museum' AND (priority >= 2 OR topic = 'index')"),
    ("filter_ne_null", "lang != 'en' AND topic != 'it''s'", "lang <> 'en' AND topic <> 'it''s'"),
    ("filter_in", "lang IN ('de', 'fr') OR priority IN (1, 5)", "lang = 'de' OR lang = 'fr' OR priority = 1 OR priority = 5"),
    ("filter_nin", {"type": "nin", "key": "lang", "value": ["en", "de"]}, "lang <> 'en' AND lang <> 'de'"),
    ("filter_is_null", "topic IS NULL OR lang IS NULL", "coalesce(topic, lang) IS NULL OR topic IS NULL OR lang IS NULL"),
    ("filter_is_not_null", "topic IS NOT NULL AND lang IS NOT NULL", "NOT (topic IS NULL OR lang IS NULL)"),
    ("filter_range", "n_chars > 1000 AND n_chars <= 3000 AND priority < 4", "n_chars BETWEEN 1001 AND 3000 AND NOT priority >= 4"),
    ("filter_precedence", "lang = 'en' OR lang = 'de' AND priority = 1", "lang = 'en' OR (lang = 'de' AND priority = 1)"),
):
    QUERIES[_name] = _filtered(_given, ["doc_id", "lang", "topic", "priority"])
    SQL[_name] = f"SELECT doc_id, lang, topic, priority FROM documents WHERE {_where}"


@query("""
WITH d AS (SELECT doc_id, {'place': tenant, 'flags': {'is_long': n_chars > 2000}} AS details FROM documents)
SELECT doc_id FROM d WHERE struct_extract(details, 'place') = 'museum' AND struct_extract(struct_extract(details, 'flags'), 'is_long') = TRUE
""")
def filter_struct_path(spark: SparkSession, folder: str) -> DataFrame:
    flags = F.struct((F.col("n_chars") > 2000).alias("is_long")).alias("flags")
    d = _table(spark, folder, "documents").select("doc_id", F.struct(F.col("tenant").alias("place"), flags).alias("details"))
    tree = filters.parse("details.place = 'museum' AND details.flags.is_long = TRUE", ["details.place", "details.flags.is_long"])
    return d.where(filters.to_column(tree)).select("doc_id")


@query("SELECT chunk_id, origin, start_index FROM stored_chunks WHERE start_index >= 500 AND char_count < 1000 AND context IS NOT NULL AND is_public = TRUE")
def filter_builtin_cols(spark: SparkSession, folder: str) -> DataFrame:
    tree = filters.parse("start_index >= 500 AND char_count < 1000 AND context IS NOT NULL AND is_public = TRUE", [*filters.BUILT_IN, "is_public"])
    return _table(spark, folder, "stored_chunks").where(filters.to_column(tree)).select("chunk_id", "origin", "start_index")


# ------------------------------------------------------------------- chunking

_TARGETS = """
WITH d AS (SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(s AS INTEGER) AS start_index, CAST(CASE WHEN n <= {size} THEN n ELSE s + {size} END AS INTEGER) AS end_index
FROM (SELECT doc_id, n, unnest(CASE WHEN n <= {size} THEN [0::BIGINT] ELSE list_distinct(list_concat(range(0, n - {size}, {step}), [n - {size}])) END) AS s FROM d)
"""


@query(_TARGETS.format(size=1600, step=800))
def chunk_targets(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.target_spans(_table(spark, folder, "documents"), "doc_id", "text", 1600, 0.5)


@query(_TARGETS.format(size=500, step=500))
def chunk_targets_overlap0(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.target_spans(_table(spark, folder, "documents"), "doc_id", "text", 500, 0.0)


@query("""
WITH d AS (SELECT doc_id, length(text) AS n, CAST(length(text) // 3 AS BIGINT) AS b FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, unnest([[0, b], [b, n]]) AS g FROM d),
t AS (SELECT doc_id, g[1] AS a, g[2] AS b FROM g)
SELECT doc_id, CAST(s AS INTEGER) AS start_index, CAST(CASE WHEN b - a <= 400 THEN b ELSE s + 400 END AS INTEGER) AS end_index
FROM (SELECT doc_id, a, b, unnest(CASE WHEN b - a <= 400 THEN [a] ELSE list_distinct(list_concat(range(a, b - 400, 200), [b - 400])) END) AS s FROM t)
""")
def chunk_targets_segmented(spark: SparkSession, folder: str) -> DataFrame:
    third = F.array(F.floor(F.length("text") / 3).cast("int"))
    return chunking.target_spans(_table(spark, folder, "documents"), "doc_id", "text", 400, 0.5, third)


_STARTS = """
WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '{pattern}'), lambda x: length(x)) AS l FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(l) AS n, unnest(range(len(l))) AS i FROM d)
SELECT doc_id, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS start_index FROM u
"""


def _starts(kind: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return chunking.boundary_starts(_table(spark, folder, "documents"), "doc_id", "text", kind)

    return run


QUERIES |= {"line_starts": _starts("line"), "sentence_starts": _starts("sentence"), "word_starts": _starts("word")}
SQL |= {
    "line_starts": _STARTS.format(pattern=r"(?s).*?(?:\r\n|\n|\r)") + " UNION ALL SELECT doc_id, 0 FROM documents WHERE text IS NOT NULL",
    "sentence_starts": _STARTS.format(pattern=rf"(?s).*?[.!?]{SPACE}+"),
    "word_starts": _STARTS.format(pattern=rf"(?s).*?{SPACE}+"),
}


@query(rf"""
WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, n, s, CASE WHEN n <= 600 THEN n ELSE s + 600 END AS e FROM
      (SELECT doc_id, n, unnest(CASE WHEN n <= 600 THEN [0::BIGINT] ELSE list_distinct(list_concat(range(0, n - 600, 480), [n - 600])) END) AS s FROM d)),
p AS (SELECT doc_id, n, s AS x FROM t UNION SELECT doc_id, n, e FROM t UNION SELECT doc_id, n, 0 FROM d UNION SELECT doc_id, n, n FROM d),
l AS (SELECT doc_id, 1 AS kind, list_transform(regexp_extract_all(text, '(?s).*?[.!?]{SPACE}+'), lambda x: length(x)) AS l FROM d
      UNION ALL SELECT doc_id, 3, list_transform(regexp_extract_all(text, '(?s).*?{SPACE}+'), lambda x: length(x)) FROM d
      UNION ALL SELECT doc_id, 2, list_transform(regexp_extract_all(text, '(?s).*?(?:\r\n|\n|\r)'), lambda x: length(x)) FROM d),
u AS (SELECT doc_id, kind, unnest(l) AS m, unnest(range(len(l))) AS i FROM l),
c AS (SELECT doc_id, kind, sum(m) OVER (PARTITION BY doc_id, kind ORDER BY i) AS c FROM u UNION ALL SELECT doc_id, 2, 0 FROM d),
near AS (SELECT p.doc_id, p.x, arg_min(c.c, kind * 1e9 + abs(c.c - p.x) * 1e3 + CASE WHEN c.c > p.x THEN 1 ELSE 0 END) AS y
         FROM p JOIN c ON p.doc_id = c.doc_id AND c.c BETWEEN p.x - 20 AND p.x + 20 WHERE p.x <> 0 AND p.x <> p.n GROUP BY ALL),
m AS (SELECT p.doc_id, p.x, coalesce(near.y, p.x) AS y FROM p LEFT JOIN near USING (doc_id, x)),
k AS (SELECT t.doc_id, a.y AS s, CASE WHEN a.y >= b.y THEN coalesce((SELECT min(y) FROM m WHERE m.doc_id = t.doc_id AND m.y > a.y), b.y) ELSE b.y END AS e
      FROM t JOIN m a ON a.doc_id = t.doc_id AND a.x = t.s JOIN m b ON b.doc_id = t.doc_id AND b.x = t.e),
w AS (SELECT doc_id, s, max(e) AS e FROM k GROUP BY ALL)
SELECT doc_id, CAST(min(s) AS INTEGER) AS start_index, CAST(e AS INTEGER) AS end_index FROM w GROUP BY doc_id, e
""")
def chunk_snap_sentence_line_word(spark: SparkSession, folder: str) -> DataFrame:
    c = chunking.MarkdownChunker(600, 0.2, boundaries=("sentence", "line", "word"))
    chunks = chunking.chunk_documents(_table(spark, folder, "documents").select("doc_id", "text"), c, "doc_id", "text")
    return chunks.select("doc_id", F.explode("chunks").alias("c")).select("doc_id", "c.start_index", "c.end_index")


def _latest(spark: SparkSession, folder: str) -> DataFrame:
    """The version of each origin that was fetched last."""
    d = _table(spark, folder, "documents").where(F.col("origin").isNotNull()).select("origin", "doc_id", "text", "tenant", "priority", "topic", "lang", "fetched_at")
    return store.latest_versions(d, "origin", ["fetched_at", "doc_id"])


_LATEST_D = "(SELECT d.* FROM documents d JOIN (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY origin ORDER BY fetched_at DESC NULLS LAST, doc_id DESC) r FROM documents WHERE origin IS NOT NULL) WHERE r = 1) USING (doc_id))"


def _first(spark: SparkSession, folder: str) -> DataFrame:
    """The version of each origin that was fetched first."""
    d = _table(spark, folder, "documents").where(F.col("origin").isNotNull()).select("origin", "doc_id", "text", "tenant", "priority", "topic", "fetched_at")
    age = -F.unix_micros(F.coalesce("fetched_at", F.timestamp_micros(F.lit(0))))
    return store.latest_versions(d.withColumn("age", age).withColumn("back", -F.col("doc_id")), "origin", ["age", "back"])


_FIRST_D = "(SELECT d.* FROM documents d JOIN (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY origin ORDER BY epoch_us(coalesce(fetched_at, TIMESTAMP '1970-01-01')), doc_id) r FROM documents WHERE origin IS NOT NULL) WHERE r = 1) USING (doc_id))"


@query(f"SELECT origin, doc_id FROM {_FIRST_D}")
def first_version(spark: SparkSession, folder: str) -> DataFrame:
    return _first(spark, folder).select("origin", "doc_id")


@query(f"SELECT origin, doc_id FROM {_LATEST_D}")
def latest_version(spark: SparkSession, folder: str) -> DataFrame:
    return _latest(spark, folder).select("origin", "doc_id")


@query(f"""
SELECT DISTINCT c.origin, c.chunk_id, c.start_index, c.end_index, d.text[c.start_index + 1:c.end_index] AS chunk_text
FROM stored_chunks c JOIN {_LATEST_D} d USING (origin) WHERE c.start_index >= 0 AND c.start_index < c.end_index
""")
def chunk_view_slice(spark: SparkSession, folder: str) -> DataFrame:
    c = _table(spark, folder, "stored_chunks").where("start_index >= 0 and start_index < end_index").select("origin", "chunk_id", "start_index", "end_index").distinct()
    joined = c.join(_latest(spark, folder).select("origin", "text"), "origin")
    return joined.select(*c.columns, chunking.slice_text(F.col("text"), F.col("start_index"), F.col("end_index")).alias("chunk_text"))


@query(f"""
WITH p AS (SELECT c.origin, CASE WHEN c.origin IS NULL OR c.origin = '' THEN 'origin' WHEN d.text IS NULL THEN 'document'
    WHEN NOT coalesce(start_index >= 0 AND start_index <= end_index AND end_index <= length(d.text), FALSE) THEN 'span'
    WHEN c.priority >= 4 THEN 'text' END AS problem
    FROM stored_chunks c LEFT JOIN {_LATEST_D} d ON c.origin = d.origin)
SELECT origin, problem, count(*) AS chunks FROM p WHERE problem IS NOT NULL GROUP BY origin, problem
""")
def chunk_validate(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with the stored chunks; those of a high priority come with a text that isn't their slice."""
    docs = _latest(spark, folder).select("origin", "text")
    c = _table(spark, folder, "stored_chunks").select("origin", "start_index", "end_index", "priority").join(docs.withColumnRenamed("text", "whole"), "origin", "left")
    own = chunking.slice_text(F.col("whole"), F.col("start_index"), F.col("end_index"))
    return chunking.check_chunks(c.withColumn("text", F.when(F.col("priority") >= 4, F.concat(F.lit("x"), own)).otherwise(own)).drop("whole"), docs)


@query()
def chunk_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """All texts by the full chunker, with headings and paragraphs; tested on fixtures."""
    return chunking.explode_chunks(chunking.chunk_documents(_table(spark, folder, "documents").select("doc_id", "text"), None, "doc_id", "text").drop("text"))


_MADE = """SELECT doc_id, '# Page ' || doc_id || chr(10) || chr(10) || repeat('word ', 30) || chr(10) || chr(10) AS head, 'Part ' || coalesce(priority, 0) || chr(10) || '----' || chr(10) || chr(10) AS part,
    '```' || chr(10) || '# no heading' || chr(10) || '```' || chr(10) || chr(10) || repeat('next ', 20) || chr(10) || chr(10) AS code, '### Deep' || chr(10) || chr(10) || repeat('last ', 25) AS deep FROM documents"""


@query(f"""
WITH m AS ({_MADE}), n AS (SELECT *, length(head) AS a, length(head) + length(part) + length(code) AS b, length(head) + length(part) + length(code) + length(deep) AS c FROM m),
t AS (SELECT doc_id, 0 AS s, a AS e, NULL AS context FROM n UNION ALL SELECT doc_id, a, b, rtrim(split_part(head, chr(10), 1)) FROM n
      UNION ALL SELECT doc_id, b, c, split_part(head, chr(10), 1) || chr(10) || split_part(part, chr(10), 1) || chr(10) || '----' FROM n)
SELECT doc_id, CAST(s AS INTEGER) AS start_index, CAST(e AS INTEGER) AS end_index, context FROM t
""")
def chunk_context(spark: SparkSession, folder: str) -> DataFrame:
    """A page made of each document's fields, cut at its headings, ATX and underlined but none in code, with the headings that each chunk stands under."""
    d = _table(spark, folder, "documents")
    text = F.concat(
        F.lit("# Page "), F.col("doc_id").cast("string"), F.lit("\n\n" + "word " * 30 + "\n\nPart "), F.coalesce("priority", F.lit(0)).cast("string"),
        F.lit("\n----\n\n```\n# no heading\n```\n\n" + "next " * 20 + "\n\n### Deep\n\n" + "last " * 25),
    )
    c = chunking.MarkdownChunker(1000, 0.5, segment_by_heading_levels=(1, 2, 3))
    chunks = chunking.chunk_documents(d.select("doc_id", text.alias("text")), c, "doc_id", "text")
    return chunking.explode_chunks(chunks.select("doc_id", "chunks")).select("doc_id", "start_index", "end_index", "context")


@query("SELECT doc_id, text IS NOT NULL AS chunked FROM documents")
def chunk_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the full chunker's chunks, in order, cover each text without a hole, from its first to its last place, and equal their slices."""
    d = chunking.chunk_documents(_table(spark, folder, "documents").select("doc_id", "text"), None, "doc_id", "text")
    n = F.size("chunks")
    pairs = F.zip_with(F.slice("chunks", F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice("chunks", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: (a["start_index"] < b["start_index"]) & (b["start_index"] <= a["end_index"]))
    equal = F.forall("chunks", lambda c: c["text"] == chunking.slice_text(F.col("text"), c["start_index"], c["end_index"]))
    ends = (F.col("chunks")[0]["start_index"] == 0) & (F.array_max(F.transform("chunks", lambda c: c["end_index"])) == F.length("text"))
    return d.select("doc_id", F.coalesce(ends & equal & F.forall(pairs, lambda x: x), F.lit(False)).alias("chunked"))


# ------------------------------------------------------------- vector search


def _probe(spark: SparkSession, folder: str) -> list[float]:
    return _table(spark, folder, "embeddings").where(F.col("vec_id") == PROBE).select("embedding").first()[0]


_VSS = """
WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7),
d AS (SELECT vec_id, label, {expr} AS v FROM embeddings, q {where})
SELECT vec_id, round(v, 6) AS metric_value FROM d ORDER BY v, vec_id LIMIT 10
"""


def _vss(method: str, where: Column | None = None) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        e = _table(spark, folder, "embeddings")
        best = search.vector_top(e, _probe(spark, folder), 10, id_col="vec_id", method=method, where=where)
        return best.select("vec_id", F.round("metric_value", 6).alias("metric_value"))

    return run


QUERIES |= {
    "vss_cosine": _vss("cosine_distance"), "vss_l2": _vss("euclidean_distance"), "vss_neg_ip": _vss("negative_inner_product"),
    "vss_filtered": lambda spark, folder: _vss("cosine_distance", F.col("label").isin(1, 2, 3))(spark, folder),
}
SQL |= {
    "vss_cosine": _VSS.format(expr="1 - list_cosine_similarity(embedding::DOUBLE[], q)", where=""),
    "vss_l2": _VSS.format(expr="list_distance(embedding::DOUBLE[], q)", where=""),
    "vss_neg_ip": _VSS.format(expr="-list_inner_product(embedding::DOUBLE[], q)", where=""),
    "vss_filtered": _VSS.format(expr="1 - list_cosine_similarity(embedding::DOUBLE[], q)", where="WHERE label IN (1, 2, 3)"),
}


@query("""
SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 6) AS metric_value FROM embeddings
""")
def vss_distances_jvm(spark: SparkSession, folder: str) -> DataFrame:
    """All distances by array functions alone, without Python."""
    probe = F.array(*map(F.lit, _probe(spark, folder)))
    return _table(spark, folder, "embeddings").select("vec_id", F.round(search.distance(F.col("embedding"), probe), 6).alias("metric_value"))


@query("""
WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, 1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS v
           FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(v, 12), vec_id) AS rank FROM p)
SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, round(v, 6) AS metric_value FROM r WHERE rank <= 5
""")
def vss_batch_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector whose id is divisible by 20 asks all vectors."""
    e = _table(spark, folder, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    top = search.vector_top_batch(e, asked, 5, vec_col="embedding", id_col="vec_id", query_id="query_id", query_vec="q")
    return top.withColumn("metric_value", F.round("metric_value", 6))


# ------------------------------------------------------------ keyword search


def _index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = _table(spark, folder, "documents")
    return d, search.postings(d, "doc_id", F.col("text")), search.lengths(d, "doc_id", F.col("text"))


_BM25_OF = """
WITH t AS (SELECT {id}, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM {table}),
c AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
p AS (SELECT {id}, term, len(any_value(w)) AS dl, count(*) AS tf FROM (SELECT {id}, w, unnest(w) AS term FROM t) WHERE term IN ({terms}) GROUP BY {id}, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT {id}, count(*) AS k, sum(log10((n - df + 0.5) / (df + 0.5) + 1) * tf * ({k} + 1) / (tf + {k} * (1 - {b} + {b} * dl / avgdl))) AS v
      FROM p JOIN f USING (term), c GROUP BY {id})
"""
_TERMS = "'rare', 'lantern', 'of', 'the', 'decoder'"
_BM25 = _BM25_OF.format(id="doc_id", table="documents", terms=_TERMS, k=1.2, b=0.75)


def _bm25(n: int | None, where: Column | None = None, drop: bool = False, words: str = WORDS, **options) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        d = _table(spark, folder, "documents")
        scores = search.bm25_scan(d, "doc_id", F.col("text"), words, **options)
        best = search.bm25_top((d if where is None else d.where(where)).select("doc_id"), scores, n, id_col="doc_id", drop_unmatched=drop)
        return best.select("doc_id", F.round("metric_value", 6).alias("metric_value"))

    return run


_TOP = "SELECT doc_id, round(v, 6) AS metric_value FROM s ORDER BY v DESC, doc_id LIMIT 10"
QUERIES |= {
    "bm25_topk": _bm25(10, drop=True), "bm25_params": _bm25(10, drop=True, k=2.0, b=0.3), "bm25_conjunctive": _bm25(10, drop=True, words="Which decoder, the", conjunctive=True),
    "bm25_filtered": lambda spark, folder: _bm25(10, F.col("lang") == "en", True)(spark, folder), "bm25_null_tail": _bm25(None),
}
SQL |= {
    "bm25_topk": _BM25 + _TOP,
    "bm25_params": _BM25_OF.format(id="doc_id", table="documents", terms=_TERMS, k=2.0, b=0.3) + _TOP,
    "bm25_conjunctive": _BM25_OF.format(id="doc_id", table="documents", terms="'which', 'decoder', 'the'", k=1.2, b=0.75)
    + "SELECT doc_id, round(v, 6) AS metric_value FROM s WHERE k = 3 ORDER BY v DESC, doc_id LIMIT 10",
    "bm25_filtered": _BM25 + "SELECT doc_id, round(v, 6) AS metric_value FROM s JOIN documents USING (doc_id) WHERE lang = 'en' ORDER BY v DESC, doc_id LIMIT 10",
    "bm25_null_tail": _BM25 + "SELECT doc_id, round(v, 6) AS metric_value FROM documents LEFT JOIN s USING (doc_id)",
}


@query(_BM25 + _TOP)
def bm25_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """The same search by postings and lengths."""
    d, post, sizes = _index(spark, folder)
    best = search.bm25_top(d.select("doc_id"), search.bm25(post, sizes, WORDS), 10, id_col="doc_id", drop_unmatched=True)
    return best.select("doc_id", F.round("metric_value", 6).alias("metric_value"))


@query("""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest(w) AS term FROM t) GROUP BY term
""")
def bm25_index_stats(spark: SparkSession, folder: str) -> DataFrame:
    post = _index(spark, folder)[1]
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("""
SELECT doc_id FROM (SELECT doc_id, list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS w FROM documents WHERE text IS NOT NULL)
WHERE list_has_all(w, ['the', 'decoder', 'which'])
""")
def fts_match_all(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "documents").where(search.matches_all(F.col("text"), "The decoder, which")).select("doc_id")


@query("""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'the' OR x = 'decoder')) AS h FROM t WHERE list_contains(w, 'the') AND list_contains(w, 'decoder'))
SELECT doc_id, round(h / (h + 1.0) / (1 + ln(1.0 + n)), 6) AS metric_value FROM h
""")
def fts_rank(spark: SparkSession, folder: str) -> DataFrame:
    d = _table(spark, folder, "documents").where(search.matches_all(F.col("text"), "the decoder"))
    return d.select("doc_id", F.round(search.rank_all(F.col("text"), "the decoder"), 6).alias("metric_value"))


# --------------------------------------------------- fusion, merging, reading


_CHUNK_TEXTS = f"""(SELECT c.chunk_id, any_value(c.embedding) AS embedding, any_value(d.text[c.start_index + 1:c.end_index]) AS text FROM stored_chunks c JOIN {_LATEST_D} d USING (origin)
    WHERE c.chunk_id IS NOT NULL AND c.start_index >= 0 AND c.start_index < c.end_index AND len(c.embedding) = 64 AND len(list_filter(c.embedding, lambda x: x IS NULL OR isnan(x))) = 0
      AND len(list_filter(c.embedding, lambda x: x <> 0)) > 0 GROUP BY c.chunk_id)"""


@query(_BM25_OF.format(id="chunk_id", table=_CHUNK_TEXTS, terms=_TERMS, k=1.2, b=0.75) + f""",
e AS (SELECT chunk_id, embedding::DOUBLE[] AS e FROM {_CHUNK_TEXTS}),
q AS (SELECT arg_min(e, chunk_id) AS q FROM e),
l AS (SELECT chunk_id, v FROM s ORDER BY v DESC, chunk_id LIMIT 20),
r AS (SELECT chunk_id, 1 - list_cosine_similarity(e, q) AS v FROM e, q ORDER BY round(v, 9), chunk_id LIMIT 20),
b AS (SELECT chunk_id, 0 AS m, 'cosine_distance' AS name, v FROM r UNION ALL SELECT chunk_id, 1, 'bm25', v FROM l)
SELECT chunk_id, array_to_string(list(name ORDER BY m), ',') AS names, round(sum(v), 5) AS total FROM b GROUP BY chunk_id
""")
def hybrid_fuse(spark: SparkSession, folder: str) -> DataFrame:
    """Vector and keyword search over chunks, fused by chunk: the metrics of both, in the order of the methods. The smallest chunk's vector asks."""
    c = _table(spark, folder, "stored_chunks").where("chunk_id is not null and start_index >= 0 and start_index < end_index and size(embedding) = 64")
    c = c.where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)) & F.exists("embedding", lambda x: x != 0))
    c = c.join(_latest(spark, folder).select("origin", "text"), "origin").withColumn("text", chunking.slice_text(F.col("text"), F.col("start_index"), F.col("end_index")))
    c = cut(c.select("chunk_id", "embedding", "text").dropDuplicates(["chunk_id"]))
    near = search.vector_top(c, c.orderBy("chunk_id").first()["embedding"], 20)
    best = search.bm25_top(c.select("chunk_id"), search.bm25_scan(c, "chunk_id", F.col("text"), WORDS), 20, drop_unmatched=True)
    as_result = lambda r, n: r.select("chunk_id", F.lit(0).alias("arrival"), search.metric(n, F.col("metric_value")).alias("metrics"))
    fused = search.fuse_methods([as_result(near, "cosine_distance"), as_result(best, "bm25")], ("chunk_id",))
    total = F.aggregate("metrics", F.lit(0.0), lambda acc, m: acc + m["value"])
    return fused.select("chunk_id", F.array_join(F.transform("metrics", lambda m: m["name"]), ",").alias("names"), F.round(total, 5).alias("total"))


_SPANS = """
WITH r AS (SELECT query_id, origin, start_index, min(end_index) AS end_index, chunk_id, min(context) AS context, sum(len(metrics)) AS n_metrics,
                  max(list_max(list_transform(list_filter(metrics, lambda m: m.name IS NOT NULL AND m.value IS NOT NULL AND NOT isnan(m.value)), lambda m: m.value))) AS best FROM retrieved_chunks
           WHERE query_id IS NOT NULL AND origin IS NOT NULL AND chunk_id IS NOT NULL AND start_index >= 0 AND start_index < end_index GROUP BY query_id, origin, start_index, chunk_id),
m AS (SELECT *, max(end_index) OVER w AS pe FROM r WINDOW w AS (PARTITION BY query_id, origin ORDER BY start_index, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, sum(CASE WHEN pe IS NULL OR start_index >= pe THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, origin ORDER BY start_index, chunk_id) AS k FROM m)
"""


def _retrieved(spark: SparkSession, folder: str) -> DataFrame:
    """Each chunk a query retrieved, once, as a row that can be merged: with the text of its slice, where the document is known, and all its metrics."""
    r = _table(spark, folder, "retrieved_chunks").where("query_id is not null and origin is not null and chunk_id is not null and start_index >= 0 and start_index < end_index")
    lists = F.flatten(F.collect_list(F.coalesce("metrics", F.array().cast(search.METRIC_LIST))))
    r = r.groupBy("query_id", "origin", "start_index", "chunk_id").agg(F.min("end_index").alias("end_index"), F.min("context").alias("context"), lists.alias("metrics"))
    r = r.join(_latest(spark, folder).select("origin", "text"), "origin", "left")
    return r.select(
        F.struct("query_id", "origin").alias("place"), "start_index", "end_index", "context",
        F.coalesce(chunking.slice_text(F.col("text"), F.col("start_index"), F.col("end_index")), F.lit("")).alias("text"), F.array("chunk_id").alias("chunk_ids"),
        F.col("metrics").cast(search.METRIC_LIST).alias("metrics"), F.col("chunk_id").alias("arrival"), F.col("chunk_id").alias("rank"),
    )


@query(_SPANS + f""", g AS (SELECT query_id, origin, min(start_index) AS s, max(end_index) AS e, sum(n_metrics) AS n, max(best) AS best, arg_min(context, (start_index, chunk_id)) FILTER (context IS NOT NULL) AS context
                            FROM i GROUP BY query_id, origin, k)
SELECT g.query_id, g.origin, CAST(s AS INTEGER) AS start_index, sha256(coalesce(d.text[s + 1:e], '')) AS hash, CAST(coalesce(n, 0) AS BIGINT) AS n_metrics, best
FROM g LEFT JOIN {_LATEST_D} d ON g.origin = d.origin
""")
def deoverlap_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of merged chunks, put together from what each adds, and how many metrics they have, with the greatest value."""
    out = search.deoverlap(_retrieved(spark, folder), key="place")
    values = F.transform(F.filter("metrics", lambda m: m["name"].isNotNull() & ~F.isnan(m["value"])), lambda m: m["value"])
    return out.select("place.query_id", "place.origin", "start_index", X.content_hash(F.col("text")).alias("hash"), F.size("metrics").cast("long").alias("n_metrics"), F.array_max(values).alias("best"))


@query(_SPANS + """
SELECT query_id, origin, min(start_index) AS start_index, max(end_index) AS end_index, count(DISTINCT chunk_id) AS chunks, max(end_index) - min(start_index) AS char_count
FROM i GROUP BY query_id, origin, k
""")
def deoverlap_islands(spark: SparkSession, folder: str) -> DataFrame:
    out = search.deoverlap(_retrieved(spark, folder), key="place")
    return out.select("place.query_id", "place.origin", "start_index", "end_index", F.size("chunk_ids").cast("long").alias("chunks"), "char_count")


@query(_SPANS + """
SELECT query_id, origin, min(start_index) AS start_index, array_to_string(list(chunk_id ORDER BY start_index, chunk_id), ',') AS ranks
FROM i GROUP BY query_id, origin, k
""")
def deoverlap_attr_lists(spark: SparkSession, folder: str) -> DataFrame:
    out = search.deoverlap(_retrieved(spark, folder), ["rank"], key="place")
    return out.select("place.query_id", "place.origin", "start_index", F.array_join(F.col("rank").cast("array<string>"), ",").alias("ranks"))


@query(_BM25 + """,
a AS (SELECT doc_id FROM s ORDER BY v DESC, doc_id LIMIT 10)
SELECT doc_id, round(v, 6) AS metric_value FROM s WHERE doc_id NOT IN (SELECT doc_id FROM a) ORDER BY v DESC, doc_id LIMIT 10
""")
def seen_exclusion(spark: SparkSession, folder: str) -> DataFrame:
    """The next page of results: what was seen is filtered out before."""
    d = _table(spark, folder, "documents")
    scores = search.bm25_scan(d, "doc_id", F.col("text"), WORDS)
    first = search.bm25_top(d.select("doc_id"), scores, 10, id_col="doc_id", drop_unmatched=True).select("doc_id")
    rest = d.select("doc_id").join(F.broadcast(first), "doc_id", "left_anti")  # ten rows
    return search.bm25_top(rest, scores, 10, id_col="doc_id", drop_unmatched=True).select("doc_id", F.round("metric_value", 6).alias("metric_value"))


@query(_BM25 + """,
a AS (SELECT doc_id FROM s ORDER BY v DESC, doc_id LIMIT 5)
SELECT sha256(string_agg(coalesce(lang, '-') || ':' || coalesce(topic, '-'), '|' ORDER BY doc_id)) AS hash, count(*) AS chunks FROM documents SEMI JOIN a USING (doc_id)
""")
def tool_json(spark: SparkSession, folder: str) -> DataFrame:
    """The five best documents as one JSON text for a tool call, read back from it."""
    d = _table(spark, folder, "documents")
    best = search.bm25_top(d.select("doc_id", "lang", "topic"), search.bm25_scan(d, "doc_id", F.col("text"), WORDS), 5, id_col="doc_id", drop_unmatched=True)
    told = search.tool_json(best.select(F.coalesce("lang", F.lit("-")).alias("context"), F.coalesce("topic", F.lit("-")).alias("text"), F.col("doc_id").alias("arrival")))
    back = F.from_json("json", "array<struct<context:string,text:string>>")
    return told.select(F.sha2(F.array_join(F.transform(back, lambda x: F.concat(x["context"], F.lit(":"), x["text"])), "|"), 256).alias("hash"), F.size(back).cast("long").alias("chunks"))


# -------------------------------------------------------------------- writing


def _stored_and_incoming(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """As stored: the first version of each document that has a text. As incoming: the latest. The layout is that of one chunk under the topic."""

    def laid_out(d: DataFrame) -> DataFrame:
        d = d.where(F.col("text").isNotNull()).select("origin", "text", "topic")
        n = F.length("text")
        chunk = d.select("origin", F.lit(0).alias("start_index"), n.alias("end_index"), n.alias("char_count"), F.col("topic").alias("context"))
        return d.select("origin", "text").join(chunk.groupBy("origin").agg(store.layout_signature().alias("layout")), "origin")

    return laid_out(_first(spark, folder)), laid_out(_latest(spark, folder))


_ACTIONS = f"""
WITH n AS (SELECT origin, text, topic FROM {_LATEST_D} WHERE text IS NOT NULL), o AS (SELECT origin, text, topic FROM {_FIRST_D} WHERE text IS NOT NULL),
a AS (SELECT n.origin, CASE WHEN o.origin IS NULL THEN 'inserted' WHEN n.text <> o.text OR {{also}} THEN 'replaced' ELSE 'skipped' END AS action FROM n LEFT JOIN o ON n.origin = o.origin)
"""
_LAYOUT = "n.topic IS DISTINCT FROM o.topic"


@query(_ACTIONS.format(also=_LAYOUT) + "SELECT origin, action FROM a")
def upsert_actions(spark: SparkSession, folder: str) -> DataFrame:
    stored, incoming = _stored_and_incoming(spark, folder)
    return store.upsert_actions(incoming, stored)


@query(_ACTIONS.format(also=_LAYOUT) + "SELECT action, count(*) AS documents FROM a GROUP BY action")
def ingest_summary(spark: SparkSession, folder: str) -> DataFrame:
    stored, incoming = _stored_and_incoming(spark, folder)
    return store.upsert_actions(incoming, stored).groupBy("action").agg(F.count("*").alias("documents"))


@query(_ACTIONS.format(also="FALSE") + "SELECT origin, action FROM a")
def upsert_actions_text_only(spark: SparkSession, folder: str) -> DataFrame:
    stored, incoming = _stored_and_incoming(spark, folder)
    return store.upsert_actions(incoming, stored, skip_on="text")


@query("SELECT origin, count(*) AS times FROM documents WHERE origin IS NOT NULL GROUP BY origin HAVING count(*) > 1")
def duplicate_origins_in_batch(spark: SparkSession, folder: str) -> DataFrame:
    return duplicate_origins(_table(spark, folder, "documents"))


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    c = _table(spark, folder, "stored_chunks").where("origin is not null and start_index >= 0 and start_index < end_index")
    return c.groupBy("origin", "start_index", "end_index").agg(F.min("context").alias("context"), F.max("priority").alias("priority"))


_KEPT = """
WITH c AS (SELECT origin, start_index, end_index, min(context) AS context, max(priority) AS priority FROM stored_chunks
           WHERE origin IS NOT NULL AND start_index >= 0 AND start_index < end_index GROUP BY ALL)
"""


@query(_KEPT + """
SELECT origin, array_to_string(list(start_index || '-' || end_index ORDER BY start_index, end_index), ' ') AS layout,
       arg_min(priority, (start_index, end_index)) FILTER (priority IS NOT NULL) AS priority FROM c GROUP BY origin
""")
def snapshot_rebuild(spark: SparkSession, folder: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("start_index", "end_index", "priority")))
    g = _spans(spark, folder).groupBy("origin").agg(ordered.alias("c"))
    layout = F.array_join(F.transform("c", lambda x: F.concat_ws("-", x["start_index"], x["end_index"])), " ")
    first = F.get(F.filter(F.transform("c", lambda x: x["priority"]), lambda p: p.isNotNull()), F.lit(0))
    return g.select("origin", layout.alias("layout"), first.alias("priority"))


@query(_KEPT + "SELECT count(*) AS chunks, count(*) AS ids, CAST(101 AS BIGINT) AS first_id, count(*) + 100 AS last_id FROM c")
def chunk_id_alloc(spark: SparkSession, folder: str) -> DataFrame:
    """New chunks get consecutive ids after the last one given."""
    given = store.allocate_ids(_spans(spark, folder), 100)
    return given.agg(F.count("*").alias("chunks"), F.count_distinct("chunk_id").alias("ids"), F.min("chunk_id").alias("first_id"), F.max("chunk_id").alias("last_id"))


@query("""
SELECT chunk_id FROM (SELECT DISTINCT chunk_id FROM stored_chunks WHERE chunk_id IS NOT NULL) WHERE chunk_id NOT IN (SELECT chunk_id FROM retrieved_chunks WHERE chunk_id IS NOT NULL)
""")
def stale_ids(spark: SparkSession, folder: str) -> DataFrame:
    return store.stale_ids(_table(spark, folder, "stored_chunks"), _table(spark, folder, "retrieved_chunks"))


# ----------------------------------------------------------- scalar functions


@query("SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents")
def content_hash(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "documents").select("doc_id", X.content_hash(F.col("text")).alias("hash"))


@query(r"""
WITH k AS (SELECT DISTINCT origin, trim(regexp_replace(regexp_replace(replace(origin, '://', '__'), '[\\/]', '_', 'g'), '[^A-Za-z0-9._-]+', '_', 'g'), ' ._') AS v
           FROM fetched_sources WHERE origin IS NOT NULL),
s AS (SELECT origin, CASE WHEN v = '' THEN 'entry' WHEN length(v) > 180 THEN v[1:88] || '..' || v[-90:] ELSE v END AS v FROM k)
SELECT origin, v || '--' || sha256(origin)[1:12] AS key FROM s
""")
def cache_key(spark: SparkSession, folder: str) -> DataFrame:
    o = _table(spark, folder, "fetched_sources").select("origin").where("origin is not null").distinct()
    return o.select("origin", X.cache_key(F.col("origin")).alias("key"))


@query(rf"""
WITH d AS (SELECT doc_id, topic, regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g') AS b FROM documents)
SELECT doc_id, replace(CASE WHEN topic IS NULL OR starts_with(b, '# ' || topic) THEN b ELSE '# ' || topic || chr(10) || chr(10) || b END, chr(12), chr(10) || chr(10) || '---' || chr(10) || chr(10)) AS content FROM d
""")
def title_prefix(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "documents").select("doc_id", X.finish_markdown(F.col("text"), F.col("topic")).alias("content"))


@query("""
SELECT DISTINCT content_type, lower(trim(split_part(content_type, ';', 1))) AS plain FROM fetched_sources WHERE content_type IS NOT NULL
""")
def content_types(spark: SparkSession, folder: str) -> DataFrame:
    c = _table(spark, folder, "fetched_sources").select("content_type").where("content_type is not null").distinct()
    return c.select("content_type", X.content_type(F.col("content_type")).alias("plain"))


def _case(column: str, table: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


_TYPED = """WITH s AS (SELECT DISTINCT origin, content_type, lower(trim(split_part(content_type, ';', 1))) AS kind,
    lower(nullif(regexp_extract(origin, '[^/](\\.[^./]+)$', 1), '')) AS suffix FROM fetched_sources WHERE origin IS NOT NULL)
"""


@query(_TYPED + f"SELECT origin, content_type, coalesce({_case('suffix', X.SUFFIX_LABELS)}, {_case('kind', X.CONTENT_TYPE_LABELS)}) AS label FROM s")
def type_label(spark: SparkSession, folder: str) -> DataFrame:
    s = _table(spark, folder, "fetched_sources").select("origin", "content_type").where("origin is not null").distinct()
    return s.select("*", X.type_label(F.col("origin"), F.col("content_type")).alias("label"))


@query(_TYPED + f"SELECT origin, content_type, coalesce({_case('kind', X.CONTENT_TYPE_SUFFIXES)}, suffix, '.bin') AS ext FROM s")
def body_suffix(spark: SparkSession, folder: str) -> DataFrame:
    s = _table(spark, folder, "fetched_sources").select("origin", "content_type").where("origin is not null").distinct()
    return s.select("*", X.body_suffix(F.col("origin"), F.col("content_type")).alias("ext"))


# ------------------------------------------------------------ links and crawls


@query(r"SELECT doc_id, unnest(regexp_extract_all(text, '\[[^\]\n]*\]\(([^()\s]+)\)', 1)) AS link FROM documents")
def extract_links(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "documents").select("doc_id", F.explode(html.markdown_links(F.col("text"))).alias("link"))


_URL = """WITH o AS (SELECT DISTINCT origin AS url FROM fetched_sources WHERE origin LIKE 'http%'
                 UNION SELECT resolved_origin FROM fetched_sources WHERE resolved_origin LIKE 'http%')
"""


def _urls(spark: SparkSession, folder: str) -> DataFrame:
    f = _table(spark, folder, "fetched_sources")
    return f.select(F.explode(F.array("origin", "resolved_origin")).alias("url")).where("url like 'http%'").distinct()


@query(_URL + r""", p AS (SELECT url, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS s, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS h,
    regexp_extract(regexp_replace(url, '#.*$', ''), '^[A-Za-z]+://[^/?]*(.*)$', 1) AS r FROM o)
SELECT url, s || '://' || CASE WHEN s = 'http' THEN regexp_replace(h, ':80$', '') ELSE regexp_replace(h, ':443$', '') END || CASE WHEN r = '/' THEN '' ELSE r END AS canonical
FROM p WHERE h <> ''""")
def canonical_urls(spark: SparkSession, folder: str) -> DataFrame:
    return _urls(spark, folder).select("url", urls.canonical_absolute(F.col("url")).alias("canonical")).where("canonical is not null")


@query(_URL + r"SELECT url FROM o WHERE regexp_full_match(url, 'https?://[^/]*/guides(?:/.*)?|https://[^/]*/.*\.html') AND NOT regexp_full_match(url, '.*/[^/]*lantern[^/]*') AND NOT regexp_matches(url, 'archive\.')")
def glob_filter(spark: SparkSession, folder: str) -> DataFrame:
    import re

    keep = urls.matches(F.col("url"), [re.compile(r"^https?://[^/]*/guides(?:/.*)?$"), "https://*/**.html"], ["**/*lantern*", re.compile(r"archive\.")])
    return _urls(spark, folder).where(keep)


@query(_URL + """, h AS (SELECT url, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS s, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS h FROM o),
r AS (SELECT min(regexp_replace(h, '^[^.]+[.]', '')) AS r FROM h)
SELECT url FROM h, r WHERE s = 'https' AND (h = r OR ends_with(h, '.' || r))
""")
def scope_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The addresses on a host or its subdomains: the host is the first of all hosts, less its first label."""
    u = _urls(spark, folder)
    host = urls.origin_key(F.col("url"))["host"]
    root = u.agg(F.min(F.regexp_replace(host, r"^[^.]+[.]", "")).alias("root"))  # one row
    joined = u.crossJoin(F.broadcast(root))
    return joined.where(urls.in_scope(F.col("url"), F.concat(F.lit("https://"), F.col("root")), subdomains=True)).select("url")


@query("""
WITH RECURSIVE n AS (SELECT count(*) AS n FROM documents),
e AS (SELECT doc_id AS src, (7 * doc_id + 1) % n AS dst FROM documents, n UNION SELECT doc_id, (3 * doc_id + 2) % n FROM documents, n),
b AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON b.node = e.src WHERE b.depth < 6)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM b GROUP BY node
""")
def crawl_bfs(spark: SparkSession, folder: str) -> DataFrame:
    """Breadth first over made-up links: p to (7p + 1) mod n and (3p + 2) mod n."""
    d = _table(spark, folder, "documents")
    n = d.count()
    both = d.select(F.col("doc_id").alias("src"), F.explode(F.array((7 * F.col("doc_id") + 1) % n, (3 * F.col("doc_id") + 2) % n)).alias("dst"))
    return crawl.bfs(cut(both.distinct()), spark.sql("SELECT CAST(1 AS BIGINT) AS node"), 6)


@query("""
SELECT origin, fetched_at, revalidated_at, coalesce(TIMESTAMPTZ '2024-05-01 00:00:00+00' - greatest(fetched_at, revalidated_at) <= INTERVAL 14 DAY, FALSE) AS fresh
FROM fetched_sources
""")
def cache_freshness(spark: SparkSession, folder: str) -> DataFrame:
    s = _table(spark, folder, "fetched_sources").select("origin", "fetched_at", "revalidated_at")
    now = F.timestamp_micros(F.lit(1714521600_000_000))
    return s.withColumn("fresh", crawl.is_fresh(F.col("fetched_at"), F.col("revalidated_at"), now, "14 days"))


# ---------------------------------------------------------------- smoke query


def entry(spark: SparkSession, folder: str) -> DataFrame:
    """Chunk the documents at fixed strides, keep the English ones, and give the ten best chunks for a query with their texts."""
    d = _table(spark, folder, "documents").where(filters.to_column(filters.parse("lang = 'en'", ["lang"])))
    spans = chunking.target_spans(d, "doc_id", "text", 1600, 0.5)
    chunks = d.select("doc_id", "text").join(spans, "doc_id").withColumn("chunk_id", F.xxhash64("doc_id", "start_index"))
    chunks = cut(chunks.select("doc_id", "chunk_id", "start_index", "end_index", chunking.slice_text(F.col("text"), F.col("start_index"), F.col("end_index")).alias("text")))
    scores = search.bm25(search.postings(chunks, "chunk_id", F.col("text")), search.lengths(chunks, "chunk_id", F.col("text")), WORDS)
    return search.bm25_top(chunks, scores, 10, drop_unmatched=True).select("doc_id", "start_index", "end_index", "text", F.round("metric_value", 6).alias("metric_value"))
