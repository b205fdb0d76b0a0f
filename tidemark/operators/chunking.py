"""Documents to overlapping chunks at natural boundaries, with the headings they stand under."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.markdown import Heading, blocks, line_starts
from tidemark.plans.durable import spread

#: Boundaries from the strongest to the weakest.
BOUNDARIES = ("heading", "paragraph", "sentence", "line", "word")

CHUNKS = "array<struct<start_index:int,end_index:int,char_count:int,context:string,text:string>>"


def stride(size: int, overlap: float) -> int:
    """Steps between targets; halves round to even."""
    if size <= 0:
        raise ValueError("chunk_size must be positive")
    return max(round(size * (1 - overlap)), 1)


def targets(length: int, size: int, overlap: float, breaks: list[int] | None = None) -> np.ndarray:
    """Rows (start, end) of each segment's targets: fixed strides, the last one moved back to the segment's end."""
    edges = [0, *sorted(breaks or []), length]
    step, out = stride(size, overlap), []
    for a, b in zip(edges, edges[1:]):
        if b - a <= size:
            out.append(np.array([[a, b]]))
        else:
            s = np.unique(np.append(np.arange(a, b - size, step), b - size))
            out.append(np.stack([s, s + size], axis=1))
    return np.concatenate(out)


def snap(points: np.ndarray, kinds: list[list[int]], within: int, fixed: tuple[int, int]) -> np.ndarray:
    """Each point's place: by the first kind that has a boundary ``within``, the nearest one, of two the left one; else its own."""
    place = points.copy()
    open_ = ~np.isin(points, fixed)
    for kind in kinds:
        if not kind or not open_.any():
            continue
        c = np.unique(np.array(kind, np.int64))
        right = np.searchsorted(c, points)
        left = c[np.maximum(right - 1, 0)]
        right = c[np.minimum(right, len(c) - 1)]
        near = np.where(np.abs(points - left) <= np.abs(points - right), left, right)
        ok = open_ & (np.abs(near - points) <= within)
        place[ok] = near[ok]
        open_ &= ~ok
    return place


def heading_context(headings: list[Heading], at: int) -> str | None:
    """The headings that a place stands under. One that begins there is in the chunk: it ends others but isn't named."""
    under: list[Heading] = []
    for h in headings:
        if h.start > at:
            break
        under = [u for u in under if u.level < h.level]
        if h.start < at:
            under.append(h)
    return "\n".join(h.text for h in under) or None


class Chunker(Protocol):
    """What turns a column of texts into chunks."""

    def cut(self, text: str) -> list[tuple[int, int, str | None]]: ...


@dataclass(frozen=True)
class MarkdownChunker:
    """Targets of ``chunk_size`` with ``target_overlap``, moved to the best boundary within ``max_snap_distance``."""

    chunk_size: int = 1600
    target_overlap: float = 0.5
    max_snap_distance: int = 20
    segment_by_heading_levels: tuple[int, ...] | None = None
    boundaries: tuple[str, ...] = field(default=BOUNDARIES)

    def cut(self, text: str) -> list[tuple[int, int, str | None]]:
        """(start, end, context) of each chunk, in order. An empty text is one empty chunk."""
        headings, paragraphs = blocks(text) if {"heading", "paragraph"} & {*self.boundaries} else ([], [])
        breaks = [h.start for h in headings if h.level in (self.segment_by_heading_levels or ())]
        aim = targets(len(text), self.chunk_size, self.target_overlap, breaks)
        found = {
            "heading": lambda: [h.start for h in headings],
            "paragraph": lambda: [0, *paragraphs],
            "sentence": lambda: [m.end() for m in re.finditer(r"[.!?]\s+", text)],
            "line": lambda: line_starts(text),
            "word": lambda: [m.end() for m in re.finditer(r"\s+", text)],
        }
        points = np.unique(np.append(aim, [0, len(text)]))
        place = snap(points, [found[k]() for k in BOUNDARIES if k in self.boundaries], self.max_snap_distance, (0, len(text)))
        start, end = (place[np.searchsorted(points, aim[:, i])] for i in (0, 1))
        ordered = np.sort(place)
        flat = start >= end
        beyond = np.searchsorted(ordered, start[flat], side="right")
        end[flat] = np.where(beyond < len(ordered), ordered[np.minimum(beyond, len(ordered) - 1)], end[flat])
        widest: dict[int, int] = {}
        for s, e in zip(start.tolist(), end.tolist()):
            widest[s] = max(e, widest.get(s, e))
        first: dict[int, int] = {}
        for s, e in widest.items():
            first[e] = min(s, first.get(e, s))
        return [(s, e, heading_context(headings, s)) for e, s in sorted(first.items(), key=lambda x: x[1])]


def chunk_documents(df: DataFrame, chunker: Chunker | None = None, id_col: str = "origin", text_col: str = "content") -> DataFrame:
    """``df`` with a column ``chunks``, an array of structs as in :data:`CHUNKS`; null texts have null chunks. Other columns stay as they are.

    One narrow stage: texts go through Arrow in batches, chunks come back as arrays.
    """
    chunker = chunker or MarkdownChunker()

    @F.arrow_udf(CHUNKS)
    def cut(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            out.append(None if t is None else [{"start_index": s, "end_index": e, "char_count": e - s, "context": c, "text": t[s:e]} for s, e, c in chunker.cut(t)])
        kind = pa.struct([("start_index", pa.int32()), ("end_index", pa.int32()), ("char_count", pa.int32()), ("context", pa.string()), ("text", pa.string())])
        return pa.array(out, pa.list_(kind))

    return spread(df).withColumn("chunks", cut(F.col(text_col)))


def explode_chunks(df: DataFrame) -> DataFrame:
    """One row a chunk: the other columns, and the chunk's fields."""
    rest = [c for c in df.columns if c != "chunks"]
    return df.select(*rest, F.explode("chunks").alias("__c")).select(*rest, "__c.*")


def target_spans(df: DataFrame, id_col: str, text_col: str, size: int, overlap: float, breaks: Column | None = None) -> DataFrame:
    """Rows (id, start_index, end_index): targets by array functions, in the JVM; ``breaks`` is a column of sorted segment starts."""
    step = stride(size, overlap)
    n = F.length(text_col)
    starts = F.array(F.lit(0)) if breaks is None else F.concat(F.array(F.lit(0)), breaks)
    segments = F.zip_with(starts, F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(n)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def inside(s: Column) -> Column:
        long = F.array_distinct(F.concat(F.sequence(s["a"], s["b"] - size - 1, F.lit(step)), F.array(s["b"] - size)))
        spans = F.transform(long, lambda x: F.struct(x.alias("start_index"), (x + size).alias("end_index")))
        return F.when(s["b"] - s["a"] <= size, F.array(F.struct(s["a"].alias("start_index"), s["b"].alias("end_index")))).otherwise(spans)

    rows = df.where(F.col(text_col).isNotNull()).select(id_col, F.explode(F.flatten(F.transform(segments, inside))).alias("x"))
    return rows.select(id_col, "x.*")


#: White space as Unicode has it, and what ends a piece of text, for each kind of boundary: the next piece begins there.
SPACE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
PIECES = {"line": r"\r\n|\n|\r", "sentence": rf"[.!?]{SPACE}+", "word": rf"{SPACE}+"}


def boundary_starts(df: DataFrame, id_col: str, text_col: str, kind: str) -> DataFrame:
    """Rows (id_col, start_index): where the lines, sentences or words of each text begin; lines include 0.

    One narrow stage: a pattern runs over each text in Arrow batches; nothing but places comes back.
    """
    ends, first = re.compile(PIECES[kind]), [0] if kind == "line" else []

    @F.arrow_udf("array<int>")
    def places(texts: pa.Array) -> pa.Array:
        return pa.array([first + [m.end() for m in ends.finditer(t)] for t in texts.to_pylist()], pa.list_(pa.int32()))

    rows = spread(df.where(F.col(text_col).isNotNull()).select(id_col, text_col))
    return rows.select(id_col, F.explode(places(F.col(text_col))).alias("start_index"))


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """Code points start to end of a text, counted from 0."""
    return F.substring(text, start + 1, end - start)


def check_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows (origin, problem, chunks): what breaks the rules a store keeps. Empty where all is well.

    Every chunk has an origin whose document exists, spans 0 <= start <= end <= length, and text, where given, equal to its slice.
    """
    d = documents.select(F.col("origin"), F.col("text").alias("__text"))
    x = chunks.join(d, "origin", "left")
    own = F.col("text") if "text" in chunks.columns else F.lit(None).cast("string")
    span_ok = (F.col("start_index") >= 0) & (F.col("start_index") <= F.col("end_index")) & (F.col("end_index") <= F.length("__text"))
    problem = (
        F.when(F.col("origin").isNull() | (F.col("origin") == ""), "origin")
        .when(F.col("__text").isNull(), "document")
        .when(~F.coalesce(span_ok, F.lit(False)), "span")
        .when(own.isNotNull() & (own != slice_text(F.col("__text"), F.col("start_index"), F.col("end_index"))), "text")
    )
    return x.select("origin", problem.alias("problem")).where("problem is not null").groupBy("origin", "problem").agg(F.count("*").alias("chunks"))


def batches_of(values: list, size: int) -> Iterator[list]:
    for at in range(0, len(values), size):
        yield values[at : at + size]
