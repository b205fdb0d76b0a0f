"""Long exact spans shared between texts (problem 10)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.fm_index import FMIndex, shared_ranges
from tidemark.plans.durable import BROADCAST_ROWS, cut, grouped, shuffle_parts, spread
from tidemark.plans.skew import salted_join

#: Length of the grams whose least hash marks a window; code points aimed at in a shard of the index.
GRAM, SHARD = 150, 1_500_000
#: Windows of a text that are looked at together, so that very long texts take no more memory.
SLICE = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Windows:
    """Cuts a text into runs of windows of ``least`` code points that share their least gram hash.

    Two equal windows have equal grams, so they lie in runs of one mark, wherever they stand.
    """

    def __init__(self, least: int, gram: int | None = None):
        self.least, self.gram = least, gram or min(GRAM, max(1, least // 2))
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BASE)]))
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _INVERSE)]))

    def runs(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(mark, first window, last window) of each run, in order; a run ends where a slice does."""
        parts = [(at, *self._slice(text[at : at + SLICE + self.least - 1])) for at in range(0, max(1, len(text) - self.least + 1), SLICE)]
        return tuple(np.concatenate([p[i] + (p[0] if i > 1 else np.uint64(0)) for p in parts]) for i in (1, 2, 3))

    def _slice(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c = _codes(text)
        if len(c) < self.least:
            z = np.zeros(0, np.int64)
            return z.view(np.uint64), z, z
        self._powers(len(c) + 1)
        total = np.zeros(len(c) + 1, np.uint64)
        np.cumsum((c.astype(np.uint64) + np.uint64(1)) * self.up[: len(c)], out=total[1:])
        h = (total[self.gram :] - total[: -self.gram]) * self.down[: len(c) - self.gram + 1]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        w = self.least - self.gram + 1
        low = _sliding_min(h, w)
        edge = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        last = np.append(edge[1:], len(low)) - 1
        return low[edge], edge, last


def _sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Least of each ``w`` neighbours: prefixes and suffixes of blocks of w."""
    n = len(h)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = h
    blocks = padded.reshape(-1, w)
    pre = np.minimum.accumulate(blocks, axis=1).ravel()
    suf = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suf[: n - w + 1], pre[w - 1 : n])


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _marks(texts: DataFrame, least: int, gram: int | None) -> DataFrame:
    """Rows (mark, id): the different marks of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(least, gram)
        for b in batches:
            ids, marks = [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                m = np.unique(windows.runs(text)[0])
                ids.append(np.full(len(m), i, np.int64)), marks.append(m)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(marks).view(np.int64)), pa.array(np.concatenate(ids))], ["mark", "id"])

    return texts.select("id", "text").mapInArrow(run, "mark long, id long")


def _cut_out(texts: DataFrame, least: int, gram: int | None) -> DataFrame:
    """Rows (id, grp, at, piece): the stretches of each text whose marks belong to one group, neighbours joined.

    ``texts`` has id, at (where the text begins in its document), text and ``wanted``, an array of structs (mark, grp).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(least, gram)
        for b in batches:
            rows: list[tuple] = []
            for i, at, text, wanted in zip(*(b.column(c).to_pylist() for c in range(4))):
                group = {x["mark"]: x["grp"] for x in wanted}
                held: dict[int, list[tuple[int, int]]] = {}
                for m, first, last in zip(*(z.tolist() for z in _signed(windows.runs(text)))):
                    if m in group:
                        held.setdefault(group[m], []).append((first, last + least))
                for g, spans in held.items():
                    rows += [(i, g, at + s, text[s:e]) for s, e in merge_spans(spans)]
                if len(rows) > 2000:
                    yield _region_batch(rows)
                    rows = []
            if rows:
                yield _region_batch(rows)

    return texts.select("id", "at", "text", "wanted").mapInArrow(run, "id long, grp long, at long, piece string")


def _signed(runs: tuple) -> tuple:
    return runs[0].view(np.int64), runs[1], runs[2]


def _region_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["id", "grp", "at", "piece"])


def _regions(texts: DataFrame, least: int, gram: int | None, by_mark: bool) -> DataFrame:
    """Rows (id, grp, at, piece, p1, p2): the stretches of ``texts`` (id, at, text) whose marks another document has too.

    A mark's group is the smallest document that has it, or with ``by_mark`` the mark itself. Texts without such a mark
    are left out before the rest moves, as long as the ids of the others are few enough to be broadcast.
    """
    marks = cut(_marks(texts, least, gram))
    shared = marks.groupBy("mark").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high")
    shared = shared.select("mark", F.col("mark" if by_mark else "low").alias("grp"))
    hits = salted_join(marks, shared, ["mark"], "id", 4)
    wanted = cut(hits.groupBy("id").agg(F.collect_set(F.struct("mark", "grp")).alias("wanted")))  # a text has no more than its own marks
    if wanted.count() <= BROADCAST_ROWS:  # rows of 8 bytes
        texts = texts.join(F.broadcast(wanted.select("id")), "id", "left_semi")
    found = texts.join(wanted.hint("merge"), "id").dropDuplicates(["id", "at"])
    return cut(_cut_out(found, least, gram).withColumn("p1", F.xxhash64("piece")).withColumn("p2", F.xxhash64("piece", F.lit(5))))


def _search(pieces: DataFrame, least: int, shards: int, size: int) -> DataFrame:
    """Rows (grp, p1, p2, ranges) of the different pieces: a compressed index for each shard, all its pieces streamed through."""

    def run(table: pa.Table) -> pa.Table:
        # Texts of equal groups in a shard search each other; other groups' texts can't match at this length.
        texts = [_codes(x) for x in table.column("piece").to_pylist()]
        low, high = table.column("low").to_numpy(), table.column("high").to_numpy()
        found = shared_ranges(FMIndex(texts, low, low != high), least)
        kept = [i for i, x in enumerate(found) if len(x)]
        ranges = pa.array([[{"s": int(s), "e": int(e)} for s, e in found[i]] for i in kept], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))
        part = table.select(["grp", "p1", "p2"]).take(pa.array(kept, pa.int64()))
        return pa.Table.from_arrays([*part.columns, ranges], ["grp", "p1", "p2", "ranges"])

    sharded = pieces.withColumn("shard", F.pmod(F.xxhash64("grp"), F.lit(shards)))
    return grouped(sharded, "shard", 4 * size).groupBy("shard").applyInArrow(run, "grp long, p1 long, p2 long, ranges array<struct<s:long,e:long>>")


def shared_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least: int = 300, shard: int = SHARD) -> DataFrame:
    """Rows (id_col, span_start, span_end): the maximal ranges covered by spans of ``least`` code points that stand verbatim elsewhere.

    Elsewhere is a text of another id; a span repeated within one text only isn't shared. Ranges are half-open, in code points;
    overlapping and touching spans are one range. Null, empty and shorter texts have none, a repeated row of a document
    counts once, other columns are ignored, an empty table gives no rows.

    Each window of ``least`` code points is marked by the least hash among its grams, so equal windows have equal marks. Marks
    of one document only are dropped after one aggregate of 16-byte rows. The rest form groups by the smallest
    document that has them; a document's stretches of a group move to the shard of that group, equal ones
    collapsed into one that knows whether it stands for several documents. Each shard is an FM-index (suffix order, BWT in
    a wavelet tree); its texts are streamed through it by backward search, vectorised over all of them, and matching statistics
    give the ranges of at least ``least`` whose rows belong to two documents.

    A group whose different stretches fill more than a shard, as around a notice that a third of all pages hold, is cut finer and
    goes through the same index: first into a group for each mark, then, where a gram alone stands in that many different
    surroundings, by marks of whole windows, whose groups are single stretches of ``least``.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.lit(0).cast("long").alias("at"), F.col(text_col).alias("text"))
    texts = spread(docs.where(F.col("id").isNotNull() & (F.length("text") >= least)))
    spans = None
    for gram, by_mark in ((None, False), (None, True), (least, True)):
        regions = _regions(texts, least, gram, by_mark)
        pieces = cut(regions.groupBy("grp", "p1", "p2").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.first("piece").alias("piece")))
        sizes = pieces.groupBy("grp").agg(F.sum(F.length("piece")).alias("size"))
        total, most = sizes.agg(F.sum("size"), F.max("size")).collect()[0]
        finer = gram != least and (most or 0) > shard
        if finer:  # at most size / shard groups
            large = F.broadcast(sizes.where(F.col("size") > shard).select("grp"))
            texts = cut(regions.join(large, "grp", "left_semi").select("id", "at", F.col("piece").alias("text")))
            pieces, regions = pieces.join(large, "grp", "left_anti"), regions.join(large, "grp", "left_anti")
        shards = max(shuffle_parts(df.sparkSession), -(-(total or 0) // shard))
        ranges = cut(_search(pieces, least, shards, total or 0))
        at = salted_join(regions.select("id", "grp", "at", "p1", "p2"), ranges, ["grp", "p1", "p2"], "id", 4)
        part = at.select("id", "at", F.explode("ranges").alias("r")).select("id", (F.col("at") + F.col("r.s")).alias("s"), (F.col("at") + F.col("r.e")).alias("e"))
        spans = part if spans is None else spans.union(part)
        if not finer:
            break

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(i, s, e) for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for s, e in merge_spans([(y["s"], y["e"]) for y in x])]
            cols = list(zip(*out)) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["id", "span_start", "span_end"])

    # A document has at most as many spans as code points, so its list is bounded by its own text.
    per_doc = spans.groupBy("id").agg(F.collect_set(F.struct("s", "e")).alias("x"))
    return per_doc.mapInArrow(join_up, "id long, span_start long, span_end long").withColumnRenamed("id", id_col)


def shared_part(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows (id_col, n_chars, shared_chars, shared): how much of each text stands elsewhere. Null texts count as empty, with 0."""
    spans = shared_spans(df, id_col, text_col, **options).groupBy(id_col).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    texts = df.select(id_col, F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("n_chars")).dropDuplicates([id_col])
    out = texts.join(spans, id_col, "left").na.fill(0, ["shared_chars"])
    return out.withColumn("shared", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0))
