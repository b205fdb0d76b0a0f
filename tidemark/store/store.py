"""A store of documents and chunks as versioned Parquet: create, connect, upsert, ingest, index, retrieve."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.embed import QUERY, EmbeddingProvider, embed_column, provider_from_config
from tidemark.operators import filters, search
from tidemark.operators.chunking import explode_chunks, slice_text
from tidemark.plans.durable import cut, parts_for
from tidemark.plans.prefix import running_sum
from tidemark.store import attributes as A
from tidemark.store import vectors
from tidemark.store.files import Files

MANIFEST, LOCK, FORMAT = "manifest.json", "writer.lock", 2
#: Files that a bucket is written as, each by its own task.
WRITERS = 8
#: Seconds after which a writer's lock counts as left behind.
STALE_LOCK = 6 * 3600

DOCUMENTS = [T.StructField("origin", T.StringType()), T.StructField("text", T.StringType()), T.StructField("layout", T.StringType())]
SPANS = [
    T.StructField("origin", T.StringType()), T.StructField("chunk_id", T.LongType()), T.StructField("start_index", T.IntegerType()),
    T.StructField("end_index", T.IntegerType()), T.StructField("char_count", T.IntegerType()), T.StructField("context", T.StringType()),
]


@dataclass(frozen=True)
class IngestSummary:
    inserted: int = 0
    replaced: int = 0
    skipped: int = 0

    def __add__(self, other: IngestSummary) -> IngestSummary:
        return IngestSummary(self.inserted + other.inserted, self.replaced + other.replaced, self.skipped + other.skipped)


def layout_signature(attributes: Sequence[str] = ()) -> Column:
    """One hash of a document's chunk rows: spans, contexts and attributes in order of the spans."""
    own = F.struct("start_index", "end_index", "char_count", "context", *attributes)
    return F.sha2(F.to_json(F.array_sort(F.collect_list(own)), {"ignoreNullFields": "false"}), 256)


def upsert_actions(incoming: DataFrame, stored: DataFrame, skip_if_unchanged: bool = True, skip_on: str = "layout") -> DataFrame:
    """Rows (origin, action): inserted, replaced or skipped. Both sides have origin, text, layout.

    A document is unchanged if its text and, unless ``skip_on`` is "text", its layout are.
    """
    old = stored.select("origin", F.sha2(F.coalesce("text", F.lit("")), 256).alias("__t"), F.col("layout").alias("__l"), F.lit(True).alias("__known"))
    same = F.col("__t") == F.sha2(F.coalesce("text", F.lit("")), 256)
    if skip_on == "layout":
        same = same & F.col("__l").eqNullSafe(F.col("layout"))
    action = F.when(F.col("__known").isNull(), "inserted").when(same & F.lit(skip_if_unchanged), "skipped").otherwise("replaced")
    return incoming.join(old, "origin", "left").select("origin", action.alias("action"))


def stale_ids(stored: DataFrame, current: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows (key): the different ids stored that are no longer current."""
    return stored.select(key).where(F.col(key).isNotNull()).distinct().join(current.select(key), key, "left_anti")


def latest_versions(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row of each key: what a store keeps where several versions were written."""
    best = F.struct(*order)
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), best).alias("__r")).select(key, "__r.*")


def allocate_ids(df: DataFrame, after: int, order: Sequence[str] = ("origin", "start_index", "end_index"), buckets: int = 1 << 16) -> DataFrame:
    """``df`` with chunk_id, 64 bits wide: after + 1, after + 2 ... by hash bucket and ``order``. No task sees all rows."""
    b = F.pmod(F.xxhash64(order[0]), F.lit(buckets))
    one = running_sum(df.withColumn("__all", F.lit(0)).withColumn("__b", b), ["__all"], F.col("__b"), [F.col(c) for c in order], F.lit(1), "__n")
    return one.withColumn("chunk_id", (F.col("__n") + after).cast("long")).drop("__all", "__b", "__n")


class Store:
    """Documents (origin, text) and chunks without text, in hash buckets of the origin.

    A manifest names the folder of each bucket. A write puts the buckets it touches into new folders and then swaps the manifest,
    so readers see one version or the next, never a part; old folders stay until :meth:`vacuum`. One writer at a
    time holds a lock file. Results are DataFrames; orders have chunk ids as last key.
    """

    def __init__(self, spark: SparkSession, files: Files, manifest: dict):
        self.spark, self.files, self.manifest = spark, files, manifest
        self.attributes = A.from_json(manifest["attributes"])
        self._centroids: tuple | None = None

    # ------------------------------------------------------------------ open

    @classmethod
    def create(
        cls, spark: SparkSession, location: str, *, embed: EmbeddingProvider | None = None, overwrite: bool = False, name: str | None = None,
        title: str | None = None, attributes: Mapping | type | None = None, profile: str = "full", buckets: int = 16,
    ) -> Store:
        """A new, empty store. An existing one is an error unless ``overwrite``; something else there always is."""
        files = Files(spark, location)
        declared = A.declare(attributes)
        A.check_profile(declared, profile)
        if files.exists():
            if not overwrite:
                raise FileExistsError(location)
            if not files.exists(MANIFEST):
                raise ValueError(f"{location} is no store; it stays as it is")
            files.delete()
        manifest = {
            "format": FORMAT, "name": name or location.rstrip("/").rsplit("/", 1)[-1], "title": title, "profile": profile,
            "embed": embed.config() if embed else None, "dimension": embed.dimension() if embed else None, "attributes": A.to_json(declared),
            "bucket_count": buckets, "buckets": {}, "version": 0, "next_id": 0, "index": None, "vectors": None,
        }
        files.create(MANIFEST, manifest)
        return cls(spark, files, manifest)

    @classmethod
    def connect(cls, spark: SparkSession, location: str) -> Store:
        files = Files(spark, location)
        if not files.exists(MANIFEST):
            raise FileNotFoundError(f"no store at {location}")
        manifest = files.read(MANIFEST)
        missing = {"attributes", "buckets", "version", "next_id", "bucket_count"} - set(manifest)
        if manifest.get("format") != FORMAT or missing:
            raise ValueError(f"store format {manifest.get('format')} isn't {FORMAT}, or its manifest lacks {sorted(missing)}")
        return cls(spark, files, manifest)

    def refresh(self) -> Store:
        return type(self).connect(self.spark, self.files.root)

    @property
    def provider(self) -> EmbeddingProvider | None:
        return provider_from_config(self.manifest["embed"])

    # ---------------------------------------------------------------- tables

    def _schema(self, table: str) -> T.StructType:
        if table == "documents":
            return T.StructType(DOCUMENTS)
        vector = [T.StructField("embedding", T.ArrayType(T.FloatType()))] if self.manifest["embed"] else []
        return T.StructType([*SPANS, *A.fields(self.attributes), *vector])

    def _read(self, table: str, buckets: Sequence[str] | None = None) -> DataFrame:
        held = self.manifest["buckets"]
        paths = [self.files.path(f"{held[b]}/{table}/bucket={b}") for b in sorted(held if buckets is None else set(buckets) & set(held))]
        schema = self._schema(table)
        paths = [p for p in paths if self.files._fs.exists(self.files._path(p))]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @property
    def documents(self) -> DataFrame:
        return self._read("documents").select("origin", "text")

    @property
    def embeddings(self) -> DataFrame:
        return self._read("embeddings")

    @property
    def chunks(self) -> DataFrame:
        """Chunks with their texts, sliced from the documents."""
        return self._with_text(self.embeddings)

    def _with_text(self, chunks: DataFrame) -> DataFrame:
        d = self.documents.withColumnRenamed("text", "__text")
        return chunks.join(d, "origin").withColumn("text", slice_text(F.col("__text"), F.col("start_index"), F.col("end_index"))).drop("__text")

    def size(self) -> int:
        """How many documents there are."""
        return self._read("documents").select("origin").distinct().count()

    def document(self, origin: str) -> DataFrame:
        """The document of an origin: only its bucket is read."""
        return self._read("documents", [self._bucket_of(origin)]).select("origin", "text").where(F.col("origin") == origin)

    def _bucket_of(self, origin: str) -> str:
        row = self.spark.range(1).select(self._bucket(F.lit(origin)).cast("string")).collect()[0]
        return row[0]

    def _bucket(self, origin: Column) -> Column:
        return F.pmod(F.xxhash64(origin), F.lit(self.manifest["bucket_count"]))

    def snapshot(self, origin: str | None = None) -> DataFrame:
        """Rows (origin, text, attributes..., chunks): chunks in order of their spans, a document's attribute the first that isn't null."""
        buckets = None if origin is None else [self._bucket_of(origin)]
        rows, docs = self._read("embeddings", buckets), self._read("documents", buckets).select("origin", "text")
        if origin is not None:
            rows, docs = rows.where(F.col("origin") == origin), docs.where(F.col("origin") == origin)
        names = list(self.attributes)
        ordered = F.array_sort(F.collect_list(F.struct("start_index", "end_index", "chunk_id", "char_count", "context", *names)))
        grouped = rows.groupBy("origin").agg(ordered.alias("chunks"))
        first = lambda n: F.get(F.filter(F.transform("chunks", lambda c: c[n]), lambda v: v.isNotNull()), F.lit(0)).alias(n)
        return docs.join(grouped, "origin", "left").select("origin", "text", *map(first, names), "chunks")

    # ----------------------------------------------------------------- write

    def _lock(self) -> None:
        try:
            self.files.create(LOCK, {"since": time.time()})
        except Exception as e:
            if "exist" not in str(e).lower():
                raise
            try:
                since = self.files.read(LOCK).get("since", 0)
            except Exception:
                since = time.time()
            if time.time() - since < STALE_LOCK:
                raise RuntimeError("another writer holds this store's lock") from None
            self.files.delete(LOCK)
            self.files.create(LOCK, {"since": time.time()})

    def _rows(self, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(documents with layout, chunk rows with attributes) of chunked documents, checked."""
        names = list(self.attributes)
        cols = [n for n in names if n in documents.columns]
        flat = explode_chunks(documents.select("origin", F.col("content").alias("__content"), *cols, "chunks"))
        resolved = A.resolve(flat, self.attributes, "attributes")
        origin_ok = F.col("chunk_origin").isNull() | (F.col("chunk_origin") == F.col("origin")) if "chunk_origin" in flat.columns else F.lit(True)
        text_ok = F.col("text").isNull() | (F.col("text") == slice_text(F.col("__content"), F.col("start_index"), F.col("end_index"))) if "text" in flat.columns else F.lit(True)
        span_ok = (F.col("start_index") >= 0) & (F.col("start_index") <= F.col("end_index")) & (F.col("end_index") <= F.length("__content"))
        flat = flat.select(
            "origin", "start_index", "end_index", F.coalesce("char_count", F.col("end_index") - F.col("start_index")).alias("char_count"), "context",
            *(c.alias(n) for n, c in resolved.items()), F.coalesce(span_ok, F.lit(False)).alias("__span"), text_ok.alias("__text_ok"), origin_ok.alias("__origin_ok"),
            slice_text(F.col("__content"), F.col("start_index"), F.col("end_index")).alias("__slice"),
        )
        flat = cut(flat)
        bad = flat.agg(
            F.count_if(~F.col("__span")).alias("spans outside their text"), F.count_if(~F.col("__text_ok")).alias("texts other than their slice"),
            F.count_if(~F.col("__origin_ok")).alias("chunks of another origin"), F.count_if(A.violations(self.attributes) > 0).alias("attributes that don't fit"),
        ).collect()[0].asDict()
        if any(bad.values()):
            raise ValueError("; ".join(f"{n} {what}" for what, n in bad.items() if n))
        layouts = flat.groupBy("origin").agg(layout_signature(names).alias("layout"))
        docs = documents.select("origin", F.col("content").alias("text")).join(layouts, "origin")
        return docs, flat

    def upsert(self, documents: DataFrame, skip_if_unchanged: bool = True, skip_on: str = "layout") -> DataFrame:
        """Write chunked documents; rows (origin, action).

        ``documents`` has origin, content, chunks (array of structs with start_index, end_index, char_count, context, and perhaps text,
        chunk_origin and a struct ``attributes``) and columns of the declared attributes. Everything is checked first: origins are given
        and different, each document has a chunk, spans lie in the text, texts equal their slices, attributes fit. Only new and
        changed documents are embedded. A replaced document's chunks get new ids. An error leaves the store as it was.
        """
        wrong = documents.agg(
            F.count_if(F.col("origin").isNull() | (F.col("origin") == "")).alias("documents without origin"),
            F.count_if(F.col("content").isNull()).alias("documents without content"),
            F.count_if(F.coalesce(F.size("chunks"), F.lit(-1)) < 1).alias("documents without chunks"),
        ).collect()[0].asDict()
        wrong["origins given twice"] = documents.groupBy("origin").count().where("count > 1").limit(1000).count()
        if any(wrong.values()):
            raise ValueError("; ".join(f"{n} {what}" for what, n in wrong.items() if n))
        docs, rows = self._rows(documents)
        self._lock()
        try:
            self.manifest = self.files.read(MANIFEST)
            docs = cut(docs.withColumn("bucket", self._bucket(F.col("origin")).cast("string")))
            touched = [r[0] for r in docs.select("bucket").distinct().collect()]  # at most bucket_count
            old = self._read("documents", touched)
            actions = cut(upsert_actions(docs, old, skip_if_unchanged, skip_on))
            changed = actions.where("action <> 'skipped'").select("origin")
            hit = [r[0] for r in docs.join(changed, "origin").select("bucket").distinct().collect()]
            if hit:
                self._commit(docs, rows, changed, hit)
            return actions
        finally:
            self.files.delete(LOCK)

    def _commit(self, docs: DataFrame, rows: DataFrame, changed: DataFrame, hit: list[str]) -> None:
        fresh = allocate_ids(rows.join(changed, "origin"), self.manifest["next_id"])
        if provider := self.provider:
            fresh = fresh.withColumn("embedding", embed_column(F.col("__slice"), provider))
        names = self._schema("embeddings").names
        fresh = cut(fresh.select(*names))
        if provider and fresh.where(F.coalesce(F.size("embedding"), F.lit(-1)) != self.manifest["dimension"]).limit(1).count():
            raise ValueError("a chunk has no vector of the store's dimension")
        added = fresh.agg(F.max("chunk_id")).collect()[0][0] or self.manifest["next_id"]
        folder = f"v{self.manifest['version'] + 1}-{uuid.uuid4().hex[:8]}"
        for table, new in (("documents", docs.join(changed, "origin").select("origin", "text", "layout")), ("embeddings", fresh)):
            kept = self._read(table, hit).join(changed, "origin", "left_anti").select(*new.columns)
            whole = kept.unionByName(new).withColumn("bucket", self._bucket(F.col("origin")).cast("string"))
            whole.repartition(parts_for(self.spark), "bucket", F.pmod(F.xxhash64("origin", F.lit(1)), F.lit(WRITERS))).write.partitionBy("bucket").parquet(self.files.path(f"{folder}/{table}"))
        self._swap(buckets=self.manifest["buckets"] | {b: folder for b in hit}, version=self.manifest["version"] + 1, next_id=int(added))

    def _swap(self, **changes) -> None:
        new = self.manifest | changes
        self.files.swap(MANIFEST, new)
        self.manifest = new

    def ingest(self, documents: DataFrame, prepare: Callable[[DataFrame], DataFrame] | None = None, **options) -> IngestSummary:
        """Prepare (chunk) and upsert documents; how many were inserted, replaced and skipped."""
        actions = self.upsert(prepare(documents) if prepare else documents, **options)
        n = {r["action"]: r["count"] for r in actions.groupBy("action").count().collect()}
        return IngestSummary(n.get("inserted", 0), n.get("replaced", 0), n.get("skipped", 0))

    def vacuum(self) -> None:
        """Delete the folders that the manifest no longer names. Readers of older versions must be done."""
        held = {*self.manifest["buckets"].values(), *(i["folder"] for i in (self.manifest["index"], self.manifest["vectors"]) if i)}
        for s in self.files._fs.listStatus(self.files._path(self.files.root)):
            name = s.getPath().getName()
            if s.isDirectory() and name not in held:
                self.files.delete(name)

    # ----------------------------------------------------------------- index

    def build_index(self, kind: str | Sequence[str] | None = None) -> None:
        """Build the keyword index over contexts and texts ("bm25"), the index of the vectors ("vss", :mod:`tidemark.store.vectors`), or both."""
        kinds = {"bm25", *(["vss"] if self.manifest["embed"] else [])} if kind is None else {kind} if isinstance(kind, str) else set(kind)
        if unknown := kinds - {"bm25", "vss"}:
            raise ValueError(f"unknown index {sorted(unknown)}")
        if "vss" in kinds and not self.manifest["embed"]:
            raise ValueError("this store has no vectors")
        self._lock()
        try:
            self.manifest = self.files.read(MANIFEST)
            version = self.manifest["version"]
            if "bm25" in kinds:
                folder = f"i{version}-{uuid.uuid4().hex[:8]}"
                text = F.concat_ws(" ", "context", "text")
                chunks = self.chunks
                post = search.postings(chunks, "chunk_id", text, stemmed=True)
                post.repartitionByRange("term").sortWithinPartitions("term", "id").write.parquet(self.files.path(f"{folder}/postings"))
                n, mean = search.lengths(chunks, "chunk_id", text, stemmed=True).agg(F.count("*"), F.avg("dl")).collect()[0]
                self._swap(index={"folder": folder, "version": version, "chunks": n, "mean_length": mean or 0.0})
            if "vss" in kinds:
                folder = f"v{version}-index-{uuid.uuid4().hex[:8]}"
                self._swap(vectors={"folder": folder, "version": version, **vectors.build(self.embeddings, self.files.path(folder))})
        finally:
            self.files.delete(LOCK)

    # ------------------------------------------------------------- retrieval

    def _filter(self, given: str | Mapping | None) -> Column | None:
        return filters.to_column(filters.parse(given, A.filterable(self.attributes)))

    def retrieve_vss(
        self, query: str | Sequence[float], top_k: int = 3, *, method: str = "cosine_distance", attributes_filter=None, exact: bool = False, probes: int | None = None
    ) -> DataFrame:
        """The chunks nearest to a text or vector: filtered first, the best joined with their texts last.

        With a current vector index only the cells nearest to the query are read: as many as ``build_index`` found to hold 0.95 of the nearest, or
        ``probes``. All vectors are read if there is no such index, if ``exact``, or if the cells hold fewer than ``top_k`` chunks that pass the filter.
        """
        if isinstance(query, str):
            if (provider := self.provider) is None:
                raise ValueError("this store has no embedding provider; ask with a vector")
            query = provider.embed([query], QUERY)[0]
        where, index = self._filter(attributes_filter), self.manifest["vectors"]
        if not exact and index and index["version"] == self.manifest["version"] and index["cells"]:
            path = self.files.path(index["folder"])
            if self._centroids is None or self._centroids[0] != path:
                self._centroids = path, vectors.read_centroids(self.spark, path)
            near = vectors.candidates(self.spark, path, self._centroids[1], index, query, method, probes).select(*self._schema("embeddings").names)
            best = cut(search.vector_top(near, query, top_k, method=method, where=where))
            if best.count() == top_k:
                return self._result(best, method)
        return self._result(search.vector_top(self.embeddings, query, top_k, method=method, where=where), method)

    def retrieve_bm25(self, query: str, top_k: int = 3, *, k: float = 1.2, b: float = 0.75, conjunctive: bool = False, attributes_filter=None) -> DataFrame:
        """The chunks of the best BM25 scores. Without a filter, chunks without a match fill up the ``top_k``, with a null score."""
        index = self.manifest["index"]
        if index is None or index["version"] != self.manifest["version"]:
            also = " or build_index()" if self.manifest["embed"] else ""
            raise RuntimeError(f'the keyword index is not current; call build_index("bm25"){also}')
        post = self.spark.read.parquet(self.files.path(f"{index['folder']}/postings"))
        scores = search.bm25(post, (index["chunks"], index["mean_length"]), query, k=k, b=b, conjunctive=conjunctive, stemmed=True)
        where = self._filter(attributes_filter)
        rows = self.embeddings if where is None else self.embeddings.where(where)
        best = cut(search.bm25_top(rows, scores, top_k, drop_unmatched=True))
        if where is None and not conjunctive and (lacking := top_k - best.count()) > 0:  # the first of those without a match
            rest = rows.join(F.broadcast(best.select("chunk_id")), "chunk_id", "left_anti").orderBy("chunk_id").limit(lacking)
            best = best.unionByName(rest.withColumn("metric_value", F.lit(None).cast("double")))
        return self._result(best, "bm25")

    def retrieve_fts(self, query: str, top_k: int = 3, *, attributes_filter=None) -> DataFrame:
        """The chunks whose texts hold every term of the query, without stemming or index, by a rank above 0; contexts aren't searched."""
        where = self._filter(attributes_filter)
        rows = self._with_text(self.embeddings if where is None else self.embeddings.where(where))
        hits = rows.where(search.matches_all(F.col("text"), query)).withColumn("metric_value", search.rank_all(F.col("text"), query))
        best = hits.drop("text").orderBy(F.desc("metric_value"), "chunk_id").limit(top_k)
        return self._result(best, "ts_rank")

    def _result(self, best: DataFrame, name: str) -> DataFrame:
        """At most top_k rows: their place, texts, and the metric as a list."""
        best = cut(best.withColumn("__bucket", self._bucket(F.col("origin")).cast("string")))
        buckets = [r[0] for r in best.select("__bucket").distinct().collect()]  # of at most top_k rows; only their documents are read
        best, down = best.drop("__bucket"), name in ("bm25", "ts_rank")
        w = Window.partitionBy().orderBy(F.desc_nulls_last("metric_value") if down else F.asc("metric_value"), "chunk_id")
        placed = F.broadcast(best.drop("embedding").withColumn("arrival", F.row_number().over(w)))  # top_k rows
        d = self._read("documents", buckets).select("origin", F.col("text").alias("__text"))
        out = d.join(placed, "origin").withColumn("text", slice_text(F.col("__text"), F.col("start_index"), F.col("end_index")))
        out = out.withColumn("metrics", search.metric(name, F.col("metric_value"))).withColumn("chunk_ids", F.array("chunk_id"))
        spans = [f.name for f in SPANS]
        return out.select(*spans, "text", *self.attributes, "metric_value", "metrics", "chunk_ids", "arrival").orderBy("arrival")

    def retrieve(self, text: str, top_k: int = 3, *, deoverlap: bool = True, attributes_filter=None) -> DataFrame:
        """Vector (if there is a provider) and keyword search, ``top_k`` of each, fused by chunk; overlapping chunks merged.

        The order is that of arrival, vectors first; it isn't ranked anew.
        """
        parts = [self.retrieve_vss(text, top_k, attributes_filter=attributes_filter)] if self.provider else []
        parts.append(self.retrieve_bm25(text, top_k, attributes_filter=attributes_filter))
        fused = search.fuse_methods([p.drop("metric_value") for p in parts])
        return (search.deoverlap(fused, list(self.attributes)) if deoverlap else fused).orderBy("arrival")
