"""Discovering, fetching and converting sources: directories, page graphs, remote crawlers, and their cache."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text as X
from tidemark.functions import urls
from tidemark.plans.durable import cut
from tidemark.sources.html import links_column, markdown_column

#: Depth of an unlimited crawl; states in which a remote crawl is over.
UNLIMITED = 100_000
FINISHED = ("cancelled_by_user", "cancelled_due_to_limits", "cancelled_due_to_timeout", "completed", "errored")

SOURCE = (
    "origin string, resolved_origin string, body string, content_type string, status_code int, metadata map<string,string>, "
    "fetched_at timestamp, revalidated_at timestamp"
)


@dataclass(frozen=True)
class Scope:
    """What a crawl may reach (exclude patterns, links, depth) and what it reports (include patterns and types, limit)."""

    roots: Sequence[str]
    include_patterns: Sequence[urls.Pattern] = ()
    exclude_patterns: Sequence[urls.Pattern] = ()
    include_types: Sequence[str] = ()
    exclude_types: Sequence[str] = ()
    depth: int | None = None
    limit: int | None = None
    include_external_links: bool = False
    include_subdomains: bool = False


class Fetcher(Protocol):
    """Rows (origin, ...) to rows as in :data:`SOURCE`; what can't be fetched is left out, or has an ``error`` in its metadata."""

    def __call__(self, origins: DataFrame) -> DataFrame: ...


def fetch_from(pages: DataFrame) -> Fetcher:
    """Fetch from a table of pages: origin, and as many columns of a source as it has."""

    def fetch(origins: DataFrame) -> DataFrame:
        return origins.join(_as_sources(pages), "origin")

    return fetch


def _as_sources(pages: DataFrame) -> DataFrame:
    kinds = dict(x.strip().split(" ", 1) for x in SOURCE.replace("map<string,string>", "map<string;string>").split(","))
    return pages.select(*((F.col(c) if c in pages.columns else F.lit(None)).cast(k.replace(";", ",")).alias(c) for c, k in kinds.items()))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _joined(links: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([[u for x in (ls if ls is not None else []) if (u := urls.canonical_url(x, b))] for ls, b in zip(links, base)])


def crawl(spark: SparkSession, scope: Scope, fetch: Fetcher) -> DataFrame:
    """Rows (discovered, depth, origin, source columns...) in order of discovery, breadth first.

    A page is fetched once for each scope it is reached under; excluded pages aren't fetched; pages that include patterns or types leave out
    are followed but not reported. Links are followed in sorted order. After a redirect the scope is the
    new address's, unless subdomains are allowed and the address stayed. A round is one job: the frontier less what was
    visited, joined to the pages; its links are the next frontier.
    """
    empty = f"discovered array<int>, depth int, {SOURCE}"
    if scope.limit == 0:
        return spark.createDataFrame([], empty)
    roots = [urls.canonical_url(str(r)) for r in scope.roots]
    if None in roots:
        raise ValueError("roots are absolute web addresses")
    rows = [(u, u, urlsplit(u).hostname or "", [i]) for i, u in enumerate(roots)]
    frontier = spark.createDataFrame(rows, "origin string, scope string, host string, discovered array<int>")
    visited, found = None, None
    keys = ["origin", "scope", "host"]
    for depth in range((UNLIMITED if scope.depth is None else scope.depth) + 1):
        here, place = urls.origin_key(F.col("origin")), urls.origin_key(F.col("scope"))
        inside = here == place
        if scope.include_subdomains:
            inside = inside | ((here["scheme"] == place["scheme"]) & (here["port"] == place["port"]) & F.endswith(here["host"], F.concat(F.lit("."), F.col("host"))))
        if scope.include_external_links:
            inside = F.lit(True)
        batch = frontier.where(inside & urls.matches(F.col("origin"), (), scope.exclude_patterns)).groupBy(*keys).agg(F.min("discovered").alias("discovered"))
        if visited is not None:
            batch = batch.join(visited, keys, "left_anti")
        batch = cut(batch)
        if not batch.limit(1).count():
            break
        visited = batch.select(*keys) if visited is None else visited.union(batch.select(*keys))  # each round is cut already
        got = cut(batch.join(fetch(batch.select("origin").distinct()), "origin").where(F.col("metadata")["error"].isNull()))
        label = F.coalesce(F.col("metadata")["type_label"], X.type_label(F.regexp_extract("origin", r"^[^?#]*", 0), F.col("content_type")))
        wanted = urls.matches(F.col("origin"), scope.include_patterns) & urls.matches_types(label, scope.include_types, scope.exclude_types)
        seen = got.where(wanted).withColumn("depth", F.lit(depth)).drop("scope", "host")
        found = seen if found is None else found.unionByName(seen)
        if scope.limit is not None and found.select("origin").distinct().count() >= scope.limit:
            break
        base = F.coalesce("resolved_origin", "origin")
        stays = urls.origin_key(base) == urls.origin_key(F.col("origin"))
        keeps = stays & F.lit(scope.include_subdomains)
        at = urls.origin_key(base)
        new_scope = F.when(keeps, F.col("scope")).otherwise(F.concat(at["scheme"], F.lit("://"), at["host"], F.lit(":"), at["port"]))
        new_host = F.when(keeps, F.col("host")).otherwise(at["host"])
        linked = got.select("discovered", new_scope.alias("scope"), new_host.alias("host"), F.posexplode(_joined(links_column(F.col("body")), base)).alias("n", "origin"))
        frontier = linked.select("origin", "scope", "host", F.concat("discovered", F.array("n")).alias("discovered"))
    if found is None:
        return spark.createDataFrame([], empty)
    first = Window.partitionBy("origin").orderBy("depth", "discovered")
    out = found.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n").orderBy("depth", "discovered")
    return out.limit(scope.limit) if scope.limit is not None else out


def bfs(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """Rows (node, depth) of what lies within ``depth`` steps of the roots, along edges (src, dst), at its least depth."""
    seen = cut(roots.select("node", F.lit(0).alias("depth")).distinct())
    last = seen
    for d in range(1, depth + 1):
        step = last.join(edges, last["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        last = cut(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)))
        if not last.limit(1).count():
            break
        seen = seen.unionByName(last)
    return seen


def find_links(
    spark: SparkSession, start: str | Sequence[str], fetch: Fetcher, depth: int = 0, children_only: bool = False,
    keep: Callable[[Column], Column] | None = None, known: DataFrame | None = None,
) -> DataFrame:
    """Rows (origin): the pages reached from ``start``. Links on pages at ``depth`` are reported, not fetched.

    ``children_only`` keeps what lies under a starting page (a sitemap's own name doesn't count). ``keep`` filters
    addresses. ``known`` (origin) holds the valid ones, if links are to be validated.
    """
    starts = [start] if isinstance(start, str) else list(start)
    roots = [u for s in starts if (u := urls.canonical_url(s))]
    prefix = [r.removesuffix("sitemap.xml") if children_only else "" for r in roots]
    schema = "origin string, prefix string"
    frontier = spark.createDataFrame(list(zip(roots, prefix)), schema).distinct()
    seen = frontier.limit(0)
    for d in range(depth + 2):
        new = frontier.where(F.startswith("origin", "prefix")).join(seen, ["origin", "prefix"], "left_anti")
        if known is not None and d:
            new = new.join(known.select("origin").distinct(), "origin", "left_semi")
        new = cut(new)
        seen = seen.unionByName(new)
        if d > depth or not new.limit(1).count():
            break
        got = new.join(fetch(new.select("origin").distinct()), "origin")
        linked = got.select("prefix", F.explode(_joined(links_column(F.col("body")), F.coalesce("resolved_origin", "origin"))).alias("origin")).distinct()
        frontier = (linked.where(keep(F.col("origin"))) if keep else linked).select("origin", "prefix")
    return seen.select("origin").distinct()


def valid_targets(df: DataFrame, known: DataFrame, col: str = "origin") -> DataFrame:
    """The rows whose address is a known page with a status below 400 (or without one)."""
    good = known.where(F.coalesce("status_code", F.lit(200)) < 400) if "status_code" in known.columns else known
    return df.join(good.select(F.col("origin").alias(col)).distinct(), col, "left_semi")


# -------------------------------------------------------------------- directories


def directory_sources(spark: SparkSession, root: str, scope: Scope | None = None) -> DataFrame:
    """Files below a folder as rows (origin, type_label, sha256, size, modified, body bytes), in order of their paths.

    A scope's depth counts folders below the root (its own files are at 0); patterns are matched against paths. Files beginning with _ or . are left
    out, as Spark's listing does, and so is a cache folder of that kind.
    """
    scope = scope or Scope([root])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = urlsplit(root).path.rstrip("/") if "://" in root else root.rstrip("/")
    path = F.regexp_replace("path", "^file:/*", "/")
    inner = F.substring(F.col("p"), len(base) + 2, 1 << 30)
    rows = files.withColumn("p", path).withColumn("inner", inner).withColumn("type_label", X.type_label(F.col("p"), F.lit(None).cast("string")))
    rows = rows.where(urls.matches(F.col("p"), scope.include_patterns, scope.exclude_patterns) & urls.matches_types(F.col("type_label"), scope.include_types, scope.exclude_types))
    if scope.depth is not None:
        rows = rows.where(F.size(F.split("inner", "/")) - 1 <= scope.depth)
    out = rows.select(F.col("p").alias("origin"), "type_label", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.col("content").alias("body"))
    out = out.orderBy("origin")
    return out if scope.limit is None else out.limit(scope.limit)


def convert(sources: DataFrame, html_extract_selectors: Sequence[str] = ("main",), html_zap_selectors: Sequence[str] = ("nav",)) -> DataFrame:
    """Rows (origin, content, type_label): Markdown and text pass, HTML is converted, other types have null content.

    PDF, word processor and notebook files need converters that aren't part of this engine.
    """
    body = F.decode("body", "utf-8") if dict(sources.dtypes)["body"] == "binary" else F.col("body")
    kind = F.col("content_type") if "content_type" in sources.columns else F.lit(None).cast("string")
    label = F.coalesce(F.col("type_label") if "type_label" in sources.columns else F.lit(None).cast("string"), X.type_label(F.regexp_extract("origin", r"^[^?#]*", 0), kind))
    rows = sources.select("origin", label.alias("type_label"), body.alias("__b"))
    html = markdown_column(F.when(F.col("type_label") == "html", F.col("__b")), list(html_extract_selectors), list(html_zap_selectors))
    passed = F.when(F.col("type_label").isin("markdown", "text", "rst", "python", "json", "xml"), F.col("__b"))
    return rows.withColumn("__h", html).select("origin", F.coalesce(passed, F.col("__h")).alias("content"), "type_label")


def markdown_documents(spark: SparkSession, scope: Scope, fetch: Fetcher, convert_with: Callable[[DataFrame], DataFrame] = convert) -> DataFrame:
    """Discover, fetch and convert, in order of discovery: rows (origin, content, type_label)."""
    found = crawl(spark, scope, fetch)
    order = found.select("origin", "depth", "discovered")
    return convert_with(found).join(order, "origin").orderBy("depth", "discovered").drop("depth", "discovered")


def read_as_markdown(spark: SparkSession, path: str, **selectors) -> DataFrame:
    """Files or folders as Markdown documents (origin, content, type_label)."""
    return convert(directory_sources(spark, path), **selectors)


# -------------------------------------------------------------------------- cache


def freshest(fetched: Column, revalidated: Column) -> Column:
    return F.greatest(fetched, revalidated)


def is_fresh(fetched: Column, revalidated: Column, now: Column, stale_after: str | None) -> Column:
    """Whether a cached source is young enough; ``stale_after`` such as '1 day', None for always. Without any time it isn't."""
    if stale_after is None:
        return F.lit(True)
    return F.coalesce(now - freshest(fetched, revalidated) <= F.expr(f"interval {stale_after}"), F.lit(False))


#: Parts that a cache may have before they are written anew as one.
MOST_PARTS = 16


@dataclass
class SourceCache:
    """Fetched sources as Parquet, a row a key; broken rows count as missing.

    A merge adds a part with its own rows, and a deletion one with keys alone; the last part that has a key holds for it. Parts are written
    beside the old ones, and the list of parts then swaps. ``MOST_PARTS`` of them are written anew as one.
    """

    spark: SparkSession
    path: str
    key: str = "origin"

    def _files(self):
        from tidemark.store.files import Files

        return Files(self.spark, self.path)

    def _parts(self) -> list[str]:
        files = self._files()
        return files.read("current.json")["parts"] if files.exists("current.json") else []

    def entries(self) -> DataFrame:
        parts, files = self._parts(), self._files()
        if not parts:
            return self.spark.createDataFrame([], SOURCE)
        rows = None
        for i, p in enumerate(parts):
            part = self.spark.read.parquet(files.path(p)).withColumn("__part", F.lit(i))
            rows = part if rows is None else rows.unionByName(part)
        rows = rows.where(F.col(self.key).isNotNull())
        if len(parts) > 1:
            last = rows.groupBy(self.key).agg(F.max("__part").alias("__part"))
            rows = rows.join(last, [self.key, "__part"])
        return rows.where(~F.col("__gone")).drop("__part", "__gone").select(*self.spark.createDataFrame([], SOURCE).columns)

    def upsert(self, rows: DataFrame) -> None:
        self._add(_as_sources(rows), False)

    def delete(self, keys: DataFrame) -> None:
        self._add(_as_sources(keys.select(self.key)), True)

    def _add(self, rows: DataFrame, gone: bool) -> None:
        files, parts = self._files(), self._parts()
        folder = f"s-{uuid.uuid4().hex}"
        rows.withColumn("__gone", F.lit(gone)).write.parquet(files.path(folder))
        files.swap("current.json", {"parts": [*parts, folder]})
        if len(parts) + 1 >= MOST_PARTS:
            whole = f"s-{uuid.uuid4().hex}"
            self.entries().withColumn("__gone", F.lit(False)).write.parquet(files.path(whole))
            files.swap("current.json", {"parts": [whole]})


def cached_fetch(cache: SourceCache, fetch: Fetcher, now: Column, stale_after: str | None = None, revalidate: Fetcher | None = None) -> Fetcher:
    """Fetch through a cache: fresh rows are reused; stale ones revalidated (status 304 only renews the time) or fetched again; others fetched."""

    def run(origins: DataFrame) -> DataFrame:
        held = cut(cache.entries().join(origins, "origin", "left_semi"))
        fresh = held.where(is_fresh(F.col("fetched_at"), F.col("revalidated_at"), now, stale_after))
        missing = origins.join(fresh, "origin", "left_anti")
        renewed = held.limit(0)
        if revalidate is not None:
            stale = held.join(fresh.select("origin"), "origin", "left_anti")
            unchanged = cut(revalidate(stale.select("origin", "metadata")).where("status_code = 304").select("origin"))
            renewed = stale.join(unchanged, "origin", "left_semi").withColumn("revalidated_at", now.cast("timestamp"))
            missing = missing.join(unchanged, "origin", "left_anti")
        got = cut(_as_sources(fetch(missing.select("origin")).withColumn("fetched_at", now.cast("timestamp"))).unionByName(_as_sources(renewed)))
        cache.upsert(got)
        return fresh.unionByName(got)

    return run


def http_fetch(timeout: float = 30.0) -> Fetcher:
    """Fetch over the network, in the executors' batches: rows as in :data:`SOURCE`.

    Origins that come with ``metadata`` of an earlier fetch are asked for conditionally, by its etag or last-modified; an unchanged page is a
    row of status 304 without a body. A failure is a row too: with the status, if there was an answer, and the reason as
    ``error`` in its metadata; crawls neither follow nor report it.
    """

    def one(u: str, known: dict) -> tuple:
        import urllib.error
        import urllib.request

        ask = {"User-Agent": "tidemark"} | {h: known[k] for k, h in (("etag", "If-None-Match"), ("last-modified", "If-Modified-Since")) if known.get(k)}
        try:
            with urllib.request.urlopen(urllib.request.Request(u, headers=ask), timeout=timeout) as r:
                tags = {k.lower(): v for k, v in r.headers.items() if k.lower() in ("etag", "last-modified")}
                return u, urls.canonical_url(r.geturl()), r.read().decode("utf-8", "ignore"), r.headers.get("Content-Type"), r.status, tags, None, None
        except urllib.error.HTTPError as e:
            return u, None, None, None, e.code, known if e.code == 304 else {"error": str(e.reason)}, None, None
        except (OSError, ValueError) as e:
            return u, None, None, None, None, {"error": str(e)}, None, None

    def run(batches):
        for pdf in batches:
            rows = [one(u, dict(m) if m is not None else {}) for u, m in zip(pdf["origin"], pdf["metadata"])]
            frame = pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in SOURCE.replace("string,string", "").split(",")])
            yield frame.astype({"status_code": "Int32"})

    def fetch(origins: DataFrame) -> DataFrame:
        known = F.col("metadata") if "metadata" in origins.columns else F.lit(None).cast("map<string,string>")
        return origins.select("origin", known.alias("metadata")).mapInPandas(run, SOURCE)

    return fetch


def remote_crawl(start: Callable[[dict], str], status: Callable[[str], str], records: Callable[[str, str | None], tuple[list[dict], str | None]], scope: Scope, *, polls: int = 60, pause: Callable[[], None] = lambda: None) -> list[dict]:
    """Run a crawl at a service: start it with the patterns it knows, poll until it is over, page through its completed records.

    Globs are pushed down; include patterns aren't if one is a regular expression. What the service returns is filtered again.
    """
    import re

    whole = not any(isinstance(p, re.Pattern) for p in scope.include_patterns)
    globs = lambda ps: [p for p in ps if isinstance(p, str)]
    job = start({
        "url": scope.roots[0], "depth": scope.depth, "limit": scope.limit, "includePatterns": globs(scope.include_patterns) if whole else [],
        "excludePatterns": globs(scope.exclude_patterns), "includeSubdomains": scope.include_subdomains, "includeExternalLinks": scope.include_external_links,
    })
    for _ in range(polls):
        if (state := status(job)) in FINISHED:
            break
        pause()
    else:
        raise TimeoutError("the crawl isn't over")
    if state != "completed":
        raise RuntimeError(f"the crawl ended as {state}")
    out, cursor = [], None
    ok = lambda ps, u: any(p.search(u) if isinstance(p, re.Pattern) else re.fullmatch(urls.glob_regex(p), u) for p in ps)
    while True:
        page, cursor = records(job, cursor)
        for r in page:
            u = urls.canonical_url(r.get("url"))
            if u and r.get("status") == "completed" and not ok(scope.exclude_patterns, u) and (not scope.include_patterns or ok(scope.include_patterns, u)):
                out.append({**r, "url": u})
        if not cursor or not page:
            return out
