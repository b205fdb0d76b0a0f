"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import boilerplate, mixing, near_duplicates, neighbours, ranking, shared_spans, site_lines, splitting, tokens

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = neighbours.similar_pairs(_table(spark, folder, "stored_chunks"), "chunk_id", "embedding", k=5, min_cosine=0.9, dim=64)
    return pairs.select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def p1_similar(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk whose id is divisible by 20 asks all chunks."""
    chunks = _table(spark, folder, "stored_chunks").select("chunk_id", "embedding")
    return neighbours.most_similar(chunks, chunks.where("chunk_id % 20 = 0"), "chunk_id", "embedding").withColumn("cosine", F.round("cosine", 4))


def _duplicates(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates.near_duplicates(_table(spark, folder, "documents"), threshold=0.6, width=3)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.expand(*_duplicates(spark, folder))


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    groups = near_duplicates.classes(*near_duplicates.near_duplicates(_table(spark, folder, "documents")))
    return groups.withColumnRenamed("id", "doc_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.furniture_lines(_table(spark, folder, "documents"))


def p3_body(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.main_body(_table(spark, folder, "documents"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return site_lines.repeated_occurrences(_table(spark, folder, "documents")).select("doc_id", "line_no")


def p5_boilerplate(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of ten different texts that were first seen on ten different dates: a republished article is one text, and a day's reprints one date."""
    return site_lines.repeated_occurrences(_table(spark, folder, "documents"), min_clusters=10, min_days=10)


def p5_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return site_lines.remove_repeated(_table(spark, folder, "documents"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.top(_table(spark, folder, "retrieved_chunks"), 3).select("query_id", "chunk_id")


def p6_order(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.fuse(_table(spark, folder, "retrieved_chunks"))


def p6_loadings(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.component(_table(spark, folder, "retrieved_chunks")).select("name", F.round("loading", 6).alias("loading"), F.round("weight", 6).alias("weight"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.found(_table(spark, folder, "documents"), 1600)


def p7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_oversized(_table(spark, folder, "documents"), limit=1600, overlap=200)


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_corpus(_table(spark, folder, "documents"))


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(_table(spark, folder, "documents"), _table(spark, folder, "mix_targets"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.starved(_table(spark, folder, "documents"), _table(spark, folder, "mix_targets"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[1]


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans.shared_spans(_table(spark, folder, "documents"), least=300)


def p10_shared(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans.shared_part(_table(spark, folder, "documents"), least=300)


def queries() -> dict[str, Query]:
    own = (
        p1_found, p1_similar, p2_found, p2_groups, p3_found, p3_body, p5_found, p5_boilerplate, p5_cleaned, p6_found, p6_order, p6_loadings, p7_found, p7_pieces, p8_ids,
        p9_found, p9_mix, p9_shares, p10_found, p10_shared,
    )
    return {q.__name__: q for q in own}


_KEY = r"""regexp_replace(trim(regexp_replace(lower(line), '[ \t\r\x{00A0}]+', ' ', 'g'), ' '), '[0-9]+', '0', 'g')"""

P5_SQL = f"""
WITH d AS (SELECT doc_id, lower(trim(source)) AS source, string_split(text, chr(10)) AS lines FROM documents
           WHERE text IS NOT NULL AND trim(source) <> ''),
l AS (SELECT doc_id, source, unnest(lines) AS line, unnest(range(len(lines))) AS line_no FROM d),
k AS (SELECT doc_id, source, line_no, {_KEY} AS key FROM l),
n AS (SELECT source, key FROM k WHERE length(key) >= 20 GROUP BY source, key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no FROM k JOIN n USING (source, key)
"""

P5_BOILERPLATE_SQL = f"""
WITH d AS (SELECT doc_id, lower(trim(source)) AS source, text, CAST(fetched_at AS DATE) AS day FROM documents WHERE text IS NOT NULL AND trim(source) <> ''),
c AS (SELECT source, text, min(day) AS day FROM d GROUP BY source, text),
l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM d),
k AS (SELECT doc_id, source, text, line_no, {_KEY} AS key FROM l),
n AS (SELECT k.source, key, count(DISTINCT doc_id) AS documents, count(DISTINCT k.text) AS clusters, count(DISTINCT c.day) AS days
      FROM k JOIN c ON k.source = c.source AND k.text = c.text WHERE length(key) >= 20 GROUP BY k.source, key)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(documents AS BIGINT) AS documents, clusters, CAST(days AS INTEGER) AS days
FROM k JOIN n USING (source, key) WHERE documents >= 10 AND clusters >= 10 AND days >= 10
"""

#: SQL patterns know ASCII white space only; the other kinds are listed.
P7_SQL = r"""
SELECT doc_id, 'over' AS kind FROM documents WHERE length(text) > 1600
UNION ALL
SELECT doc_id, 'forced' FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}.!?。！？…]+')) AS part
    FROM documents WHERE length(text) > 1600) GROUP BY doc_id HAVING max(length(part)) > 1600
"""

P6_SQL = """
WITH m AS (SELECT query_id, chunk_id, unnest(metrics) AS m FROM retrieved_chunks),
v AS (SELECT query_id, chunk_id, replace(lower(trim(m.name)), '-', '_') AS name, m.value AS v FROM m
      WHERE m.name IS NOT NULL AND m.value IS NOT NULL AND NOT isnan(m.value)),
g AS (SELECT query_id, chunk_id, name, max(CASE WHEN name IN ('cosine_distance', 'negative_inner_product') THEN -v ELSE v END) AS g
      FROM v GROUP BY ALL),
w AS (SELECT query_id, name, min(g) AS worst FROM g GROUP BY ALL),
c AS (SELECT DISTINCT query_id, chunk_id FROM retrieved_chunks WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL),
f AS (SELECT c.query_id, c.chunk_id, w.name, coalesce(g.g, w.worst) AS g FROM c JOIN w USING (query_id) LEFT JOIN g USING (query_id, chunk_id, name)),
r AS (SELECT *, rank() OVER (PARTITION BY query_id, name ORDER BY g) + (count(*) OVER (PARTITION BY query_id, name, g) - 1) / 2.0 AS k,
             count(*) OVER (PARTITION BY query_id, name) AS n FROM f),
s AS (SELECT query_id, chunk_id, round(sum(CASE WHEN n > 1 THEN (k - 1) / (n - 1) ELSE 0.5 END), 9) AS s FROM r GROUP BY ALL),
o AS (SELECT c.query_id, c.chunk_id, row_number() OVER (PARTITION BY c.query_id ORDER BY coalesce(s.s, 0) DESC, c.chunk_id) AS place
      FROM c LEFT JOIN s USING (query_id, chunk_id))
SELECT query_id, chunk_id FROM o WHERE place <= 3
"""


P5_CLEANED_SQL = f"""
WITH hits AS ({P5_SQL}),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, array_to_string(list(line ORDER BY line_no), chr(10)) AS kept FROM l ANTI JOIN hits USING (doc_id, line_no) GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text FROM documents LEFT JOIN k USING (doc_id)
"""

_UNIT = """
WITH u AS (SELECT chunk_id, min(embedding) AS e FROM stored_chunks
           WHERE chunk_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY chunk_id),
v AS (SELECT chunk_id, list_transform(e, lambda x: x::DOUBLE / sqrt(list_inner_product(e::DOUBLE[], e::DOUBLE[]))) AS e FROM u),
"""

#: Cosines of copies differ by rounding alone; equal ones go by id.
P1_SQL = _UNIT + """
p AS (SELECT a.chunk_id AS a, b.chunk_id AS b, round(list_inner_product(a.e, b.e), 6) AS c FROM v a JOIN v b ON a.chunk_id <> b.chunk_id
      WHERE list_inner_product(a.e, b.e) >= 0.9),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS k FROM p)
SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM r WHERE k <= 5
"""

P1_SIMILAR_SQL = _UNIT + """
p AS (SELECT a.chunk_id AS a, b.chunk_id AS b, list_inner_product(a.e, b.e) AS c FROM v a JOIN v b ON a.chunk_id <> b.chunk_id WHERE a.chunk_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(c, 9) DESC, b) AS k FROM p)
SELECT a::BIGINT AS query_id, b::BIGINT AS neighbour_id, round(c, 4) AS cosine, k::INTEGER AS rank FROM r WHERE k <= 5
"""

#: The cases are the same for any tokenizer; here bytes are the tokens.
P9_SQL = """
WITH t AS (SELECT lower(trim(source)) AS key, min(source) AS name, max(target_share) AS share, max(max_repeats) AS cap FROM mix_targets WHERE trim(source) <> '' GROUP BY 1),
s AS (SELECT t.*, coalesce(sum(strlen(d.text)), 0) AS size FROM t LEFT JOIN documents d ON lower(trim(d.source)) = t.key GROUP BY ALL)
SELECT name AS source FROM s WHERE share > 0 AND (size = 0 OR size * cap < share * (SELECT sum(size) FROM s))
"""

P2_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT doc_a, doc_b FROM c JOIN n x ON x.doc_id = doc_a JOIN n y ON y.doc_id = doc_b WHERE k >= 0.6 * (x.n + y.n - k)
"""

P2_GROUPS_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
k AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS k FROM s GROUP BY doc_id),
r AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY k) AS rep, count(*) OVER (PARTITION BY k) AS copies FROM k),
t AS (SELECT s.doc_id, g, n FROM s JOIN r ON s.doc_id = r.doc_id AND r.rep = r.doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c WHERE k >= 0.8 * (na + nb - k)),
m AS (SELECT rep AS v, rep AS c FROM r WHERE rep = doc_id UNION SELECT e.b, m.c FROM m JOIN e ON m.v = e.a),
l AS (SELECT a, count(*) AS links FROM e GROUP BY a),
x AS (SELECT v, min(c) AS c FROM m GROUP BY v)
SELECT doc_id, x.c AS class_id, copies, coalesce(links, 0) AS links FROM r JOIN x ON x.v = r.rep LEFT JOIN l ON l.a = r.rep
"""

_SPANS = """
WITH g AS (SELECT doc_id, i, hash(text[i:i + 299]) AS h FROM
           (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300)),
m AS (SELECT h FROM g GROUP BY h HAVING min(doc_id) <> max(doc_id)),
s AS (SELECT doc_id, i - 1 AS s FROM g SEMI JOIN m USING (h)),
b AS (SELECT *, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 300 THEN 1 ELSE 0 END AS f FROM s),
k AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM b),
p AS (SELECT doc_id, CAST(min(s) AS BIGINT) AS span_start, CAST(max(s) + 300 AS BIGINT) AS span_end FROM k GROUP BY doc_id, k)
"""

P10_SQL = _SPANS + "SELECT doc_id, span_start, span_end FROM p"

P10_SHARED_SQL = _SPANS + """, t AS (SELECT doc_id, CAST(sum(span_end - span_start) AS BIGINT) AS c FROM p GROUP BY doc_id)
SELECT doc_id, coalesce(length(text), 0) AS n_chars, coalesce(c, 0) AS shared_chars,
       CASE WHEN coalesce(length(text), 0) > 0 THEN coalesce(c, 0) / length(text)::DOUBLE ELSE 0.0 END AS shared
FROM documents LEFT JOIN t USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """For the queries that SQL answers on whole tables; the others are tested against brute force or round trips."""
    return {
        "p1_found": P1_SQL, "p1_similar": P1_SIMILAR_SQL, "p2_found": P2_SQL, "p2_groups": P2_GROUPS_SQL, "p9_found": P9_SQL, "p5_found": P5_SQL, "p5_boilerplate": P5_BOILERPLATE_SQL, "p5_cleaned": P5_CLEANED_SQL, "p6_found": P6_SQL, "p7_found": P7_SQL,
        "p10_found": P10_SQL, "p10_shared": P10_SHARED_SQL,
    }
