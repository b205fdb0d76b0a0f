"""Lines repeated across one source's documents (problem 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.durable import BROADCAST_ROWS, cut
from tidemark.plans.skew import salted_join


def line_key(line: Column) -> Column:
    """What is compared: lower case, blanks run together and trimmed, runs of the digits 0-9 as one 0."""
    flat = F.regexp_replace(F.lower(line), "[ \\t\\r ]+", " ")
    return F.regexp_replace(F.trim(flat), "[0-9]+", "0")


def source_key(source: Column) -> Column:
    """Sources are compared trimmed and lower-cased; null and blank belong to no source."""
    name = F.lower(F.trim(source))
    return F.when(name != "", name)


_CLUSTER = ["src", "c1", "c2"]
_LINE = ["src", "k1", "k2"]


def _clusters(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents by cluster of copies, rows (src, c1, c2, doc_id, day); and of each cluster (src, c1, c2, rep, documents, day).

    A cluster is the documents of one source with the same text, known by 128 bits; its smallest document stands for it.
    """
    text = (F.xxhash64("text").alias("c1"), F.xxhash64("text", F.lit(1)).alias("c2"))
    rows = df.select("doc_id", source_key(F.col("source")).alias("source"), "text", F.to_date("fetched_at").alias("day"))
    rows = rows.where(F.col("source").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.xxhash64("source").alias("src"), *text, "day")
    members = cut(rows.groupBy(*_CLUSTER, "doc_id").agg(F.min("day").alias("day")))
    return members, cut(members.groupBy(*_CLUSTER).agg(F.min("doc_id").alias("rep"), F.count("*").alias("documents"), F.min("day").alias("day")))


def _lines(df: DataFrame, members: DataFrame, clusters: DataFrame, shortest: int) -> DataFrame:
    """Rows (src, rep, line_no, k1, k2): each line long enough of the documents that stand for clusters; 128 bits stand for a line's key."""
    copies = members.join(clusters.select(*_CLUSTER, "rep"), _CLUSTER).where(F.col("doc_id") != F.col("rep")).select("doc_id", "src")
    copies = cut(copies)
    docs = df.select("doc_id", source_key(F.col("source")).alias("source"), "text").where(F.col("source").isNotNull() & F.col("text").isNotNull())
    docs = docs.select("doc_id", F.xxhash64("source").alias("src"), "text")
    docs = docs.join(F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies, ["doc_id", "src"], "left_anti")
    lines = docs.select("src", F.col("doc_id").alias("rep"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.where(F.length("line") >= shortest // 2).withColumn("key", line_key(F.col("line"))).where(F.length("key") >= shortest)
    return lines.select("src", "rep", F.col("line_no").cast("long").alias("line_no"), F.xxhash64("key").alias("k1"), F.xxhash64("key", F.lit(1)).alias("k2"))


def _repeated(lines: DataFrame, clusters: DataFrame, least: int, min_clusters: int, min_days: int) -> DataFrame:
    """Rows (src, k1, k2, documents, clusters, days) of the lines that repeat within their source."""
    once = lines.groupBy(*_LINE, "rep").agg(F.lit(1).alias("one"))
    # The cluster of a line by its representative: sources have as many rows there as different texts, so a hot one is many tasks.
    sized = once.join(clusters.select("src", "rep", "documents", "day"), ["src", "rep"])
    counts = sized.groupBy(*_LINE).agg(F.sum("documents").alias("documents"), F.count("*").alias("clusters"), F.size(F.collect_set("day")).alias("days"))
    return counts.where((F.col("documents") >= least) & (F.col("clusters") >= min_clusters) & (F.col("days") >= min_days))


def repeated_occurrences(df: DataFrame, *, least: int = 10, shortest: int = 20, min_clusters: int = 1, min_days: int = 0) -> DataFrame:
    """Rows (doc_id, line_no, documents, clusters, days): every occurrence of a line found in ``least`` documents of its source.

    ``df`` has doc_id, source, text and fetched_at. Lines are numbered from 0 between newline characters. Documents
    without a source or text have no rows; null dates count as no day; a repeated row of a document counts as one
    document; an empty table gives no rows.

    Copies of one text within a source collapse first, to the smallest of their documents, and only its lines are looked at. A line
    counts once for each cluster of copies, however often it stands there. ``documents`` adds up what its clusters stand for;
    ``clusters`` and ``days``, the different dates on which clusters first appeared, tell an article published again and again from
    boilerplate: ``min_clusters`` and ``min_days`` ask for that many. Occurrences in the representatives are handed to all members at the
    end. Aggregates combine before they shuffle, joins on lines and clusters that may be hot are salted.
    """
    members, clusters = _clusters(df)
    lines = cut(_lines(df, members, clusters, shortest))
    hot = cut(_repeated(lines, clusters, least, min_clusters, min_days))
    if hot.count() <= BROADCAST_ROWS // 4:  # rows of about 64 bytes
        hits = lines.join(F.broadcast(hot), _LINE)
    else:  # a line may hold a third of the occurrences
        hits = salted_join(lines, hot, _LINE, "rep")
    own = hits.select(F.col("rep").alias("doc_id"), "line_no", "documents", "clusters", "days")
    copied = clusters.where("documents > 1").select(*_CLUSTER, "rep")
    others = salted_join(members.select(*_CLUSTER, "doc_id"), copied, _CLUSTER, "doc_id", 4).where(F.col("doc_id") != F.col("rep"))
    more = salted_join(others.select("src", "rep", "doc_id"), hits.join(copied.select("src", "rep"), ["src", "rep"]), ["src", "rep"], "doc_id", 4)
    return own.unionByName(more.select("doc_id", "line_no", "documents", "clusters", "days"))


def remove_repeated(df: DataFrame, **options) -> DataFrame:
    """Rows (doc_id, text) of all documents, their texts without the lines of :func:`repeated_occurrences`.

    Null texts stay null. A text all of whose lines repeat becomes empty. Options are those of that function.
    """
    drop = repeated_occurrences(df, **options).groupBy("doc_id").agg(F.collect_set("line_no").alias("drop"))
    joined = df.select("doc_id", "text").join(drop, "doc_id", "left")
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("drop", i.cast("long")))
    return joined.select("doc_id", F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
