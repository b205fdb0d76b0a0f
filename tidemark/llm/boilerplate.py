"""The main body of a page, without the site furniture around and inside it (problem 3)."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import page_lines as P
from tidemark.plans.durable import spread

#: Pages whose weakly labelled lines the classifier is fitted on; documents of one source, or different sources, that make a line a repeated one.
SAMPLE_PAGES, REPEATS = 3_000, 5


def fit(pages: list[str], repeated: set[str] = frozenset(), least: int = REPEATS, rounds: int = 100, rate: float = 1.0, decay: float = 1e-5) -> np.ndarray:
    """Logistic weights of the line features, from lines that label themselves (:meth:`page_lines.Sample.weak_label`).

    ``repeated``: keys of lines that stand in many documents. Each different line counts once.
    """
    read = [P.Page(t) for t in pages]
    sample = P.Sample(read, repeated, least)
    rows, given = [], []
    seen: set[str] = set()
    for p in read:
        for i, s in enumerate(p.lines):
            key = P.key(s)
            if p.code[i] or key in seen:
                continue
            seen.add(key)
            if plain := p.plain_heading(i):
                rows.append(plain), given.append(0)
            if p.underlined[i]:
                continue
            y = sample.weak_label(p, i)
            if y is not None:
                rows.append(p.owns[i] + p.places(i)), given.append(y)
    w = np.zeros(P.SIZE)
    if not rows:
        return w
    index = np.concatenate([np.array(r) for r in rows])
    ptr = np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]])
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    y = np.array(given, float)
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    norm = np.maximum(np.bincount(index, weights=weight[row], minlength=P.SIZE), 5.0)
    for _ in range(rounds):
        z = np.add.reduceat(w[index], ptr)
        g = weight * (y - 1 / (1 + np.exp(-np.clip(z, -30, 30))))
        w += rate * (np.bincount(index, weights=g[row], minlength=P.SIZE) / norm) - decay * w
    return w


class Cut:
    """A minimum cut of a small graph, by shortest augmenting paths. Source side is main content."""

    def __init__(self, n: int):
        self.n, self.links, self.to, self.room = n, [[] for _ in range(n + 2)], [], []

    def edge(self, a: int, b: int, there: float, back: float) -> None:
        self.links[a].append(len(self.to))
        self.to.append(b), self.room.append(there)
        self.links[b].append(len(self.to))
        self.to.append(a), self.room.append(back)

    def source_side(self) -> list[bool]:
        s, t, to, room, links = self.n, self.n + 1, self.to, self.room, self.links
        while True:
            via = [-1] * (self.n + 2)
            via[s] = -2
            queue = deque([s])
            while queue and via[t] == -1:
                a = queue.popleft()
                for e in links[a]:
                    if room[e] > 1e-9 and via[to[e]] == -1:
                        via[to[e]] = e
                        queue.append(to[e])
            if via[t] == -1:
                return [via[i] != -1 for i in range(self.n)]
            flow, at = float("inf"), t
            while at != s:
                flow, at = min(flow, room[via[at]]), to[via[at] ^ 1]
            at = t
            while at != s:
                room[via[at]] -= flow
                room[via[at] ^ 1] += flow
                at = to[via[at] ^ 1]


def minimum_cut(cost: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is main content: ``cost`` > 0 is what that label costs it, < 0 what furniture costs.

    A node whose terminal outweighs all its edges keeps its terminal's label in every minimum cut; it is fixed, and its edges become
    part of its neighbours' terminals. What is left is small and solved by maximum flow.
    """
    n = len(cost)
    cost = list(cost)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    queue = list(range(n))
    while queue:
        i = queue.pop()
        if label[i] is None and abs(cost[i]) > sum(near[i].values()):
            label[i] = cost[i] < 0
            for j, w in near[i].items():
                del near[j][i]
                cost[j] += -w if label[i] else w
                queue.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        at = {i: k for k, i in enumerate(rest)}
        graph = Cut(len(rest))
        for i in rest:
            if cost[i] < 0:
                graph.edge(len(rest), at[i], -cost[i], 0.0)
            else:
                graph.edge(at[i], len(rest) + 1, cost[i], 0.0)
            for j, w in near[i].items():
                if i < j:
                    graph.edge(at[i], at[j], w, w)
        for i, kept in zip(rest, graph.source_side()):
            label[i] = kept
    return label


#: Capacities. FIXED ties headings, code and the like to the main body; the others are smoothness edges: lines of a block, items of a
#: list, a line that ends in a colon with each item below it, and neighbours with blank lines between them.
FIXED, BLOCK, LIST, HEAD, APART = 50.0, 1.0, 3.0, 8.0, 0.15


def graph(page: P.Page, w: list[float]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """What each line costs as main content, and the edges between lines that lie together.

    A line that ends in a colon speaks for the list below it: each of its items is its child, and its cost counts once for each.
    """
    lines, numbers = page.lines, page.numbers
    marks = [P.marker(s) for s in lines]
    costs = [-FIXED if page.body(i) else max(-FIXED, min(sum([w[f] for f in own]) + sum([w[f] for f in page.places(i)]), FIXED)) for i, own in enumerate(page.owns)]
    edges: list[tuple[int, int, float]] = []
    head, first, loose = -1, 0, False
    for i in range(1, len(lines)):
        joined = numbers[i] == numbers[i - 1] + 1
        same = bool(marks[i]) and marks[i] == marks[i - 1]
        if same and i == first + 1:
            loose = not joined  # items with blank lines between them
        if marks[i] and not (same and (joined or loose)):
            first, loose = i, False
            head = i - 1 if not marks[i - 1] and lines[i - 1].endswith((":", "：")) and not page.body(i - 1) else -1
        elif not marks[i]:
            head = -1
        if same and i > first:
            edges.append((i - 1, i, LIST))
        elif joined and not marks[i] and not marks[i - 1]:
            edges.append((i - 1, i, BLOCK))
        elif not joined:
            edges.append((i - 1, i, APART))
        if head >= 0:
            edges.append((head, i, HEAD))
            costs[head] *= (i - first + 2) / (i - first + 1)
    return costs, edges


def label_page(text: str, w: list[float]) -> list[int]:
    """Numbers of the non-blank lines outside the main body."""
    page = P.Page(text)
    return [k for k, kept in zip(page.numbers, minimum_cut(*graph(page, w))) if not kept]


def sampled_pages(df: DataFrame, text_col: str, sample_pages: int) -> list[str]:
    """The ``sample_pages`` different texts of the smallest hashes, wherever in the table they are."""
    pages = df.select(F.col(text_col).alias("text")).where("text is not null").withColumn("h", F.xxhash64("text"))
    first = F.broadcast(pages.select("h").distinct().orderBy("h").limit(sample_pages))
    return [r[0] for r in pages.join(first, "h").groupBy("h").agg(F.min("text").alias("text")).orderBy("h").select("text").collect()]


def repeated_keys(df: DataFrame, text_col: str, source_col: str | None, keys: list[str], least: int = REPEATS) -> set[str]:
    """Those of ``keys`` (:func:`page_lines.key`) whose line stands in ``least`` different texts of a source, or in those of as many sources.

    All texts of ``df`` are counted. The keys are broadcast, so only their lines move: each once for a text of a source, then
    as counts. Null and blank sources are one source that counts for nothing by itself.
    """
    spark = df.sparkSession
    known = spark.createDataFrame([(k,) for k in keys], "key string").select("key", F.xxhash64("key").alias("k"))
    name = F.lower(F.trim(F.col(source_col))) if source_col else F.lit("")
    rows = df.select(F.coalesce(name, F.lit("")).alias("s"), F.col(text_col).alias("text")).where("text is not null")
    lines = rows.select(F.xxhash64("s").alias("src"), (F.col("s") != "").alias("named"), F.xxhash64("text").alias("copy"), F.explode(F.split("text", "\n")).alias("line"))
    flat = F.regexp_replace(F.trim(F.regexp_replace(F.lower("line"), r"(?U)\s+", " ")), r"(?U)\d+", "0")
    hits = lines.select("src", "named", "copy", F.xxhash64(flat).alias("k")).join(F.broadcast(known.select("k")), "k")
    per = hits.distinct().groupBy("k", "src", "named").agg(F.count("*").alias("n"))
    found = per.groupBy("k").agg(F.max(F.when(F.col("named"), F.col("n"))).alias("texts"), F.count_if("named").alias("sources"))
    found = found.where((F.col("texts") >= least) | (F.col("sources") >= least))
    return {r[0] for r in known.join(found, "k").select("key").collect()}  # at most as many as there are keys


def _weights(df: DataFrame, text_col: str, source_col: str | None, sample_pages: int) -> np.ndarray:
    """The classifier, fitted on a bounded sample: whole pages in the order of a hash of their text."""
    pages = sampled_pages(df, text_col, sample_pages)
    keys = sorted({P.key(s) for t in pages for s in t.split("\n") if s.strip()})
    source = source_col if source_col in df.columns else None
    return fit(pages, repeated_keys(df, text_col, source, keys) if keys else set())


def furniture_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: np.ndarray | None = None, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """Rows (id_col, line_no): the non-blank lines that are not part of the page's main body, numbered from 0.

    A line classifier (structure, place in the page, hashed words; no word lists) gives each line a cost of either label. Smoothness edges
    tie the lines of a block, the items of a list, neighbours across blank lines, and a line that ends in a colon to each item below it
    (:func:`graph`); the labelling is the minimum cut of that graph. The classifier is fitted here on at most ``sample_pages``
    different pages, whose lines label themselves: by how often they stand in all texts of their source or in other sources
    (:func:`repeated_keys`), and by their structure. ``weights`` from :func:`fit` replace it. Headings, code, tables, quotes and bold
    notes always stay. Null, empty and blank texts have no rows; a repeated row of a page has its rows repeatedly; a table without ``source_col``
    is one nameless source; other columns are ignored.
    """
    model = df.sparkSession.sparkContext.broadcast((_weights(df, text_col, source_col, sample_pages) if weights is None else weights).tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for b in batches:
            ids, lines = [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = label_page(text, w) if text else []
                ids += [i] * len(found)
                lines += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(lines, pa.int64())], ["id", "line_no"])

    rows = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, line_no long").withColumnRenamed("id", id_col)


def main_body(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: np.ndarray | None = None, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """Rows (id_col, text): each page's text without its furniture lines. Null texts stay null, empty ones empty."""
    model = df.sparkSession.sparkContext.broadcast((_weights(df, text_col, source_col, sample_pages) if weights is None else weights).tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                if text:
                    drop = set(label_page(text, w))
                    text = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in drop)
                out.append(text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["id", "text"])

    rows = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
