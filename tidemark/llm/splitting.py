"""Cutting oversized texts at natural boundaries (problem 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import offsets

#: Characters that end a sentence.
SENTENCE_ENDS = ".!?。！？…"


def piece_pattern(limit: int, fill: float = 0.5) -> str:
    """Bounded-quantifier alternatives in order of boundary strength.

    What is left, if it fits; else up to ``limit`` code points ending in an empty line, a line end, a sentence end
    before white space (these three only if at least ``fill`` of the limit gets used), any white space, any
    sentence end, and at last any character.
    """
    least = max(1, int(limit * fill))
    upto = lambda low, tail: f".{{{max(1, min(low, limit - tail))},{max(1, limit - tail)}}}"
    ends = f"[{SENTENCE_ENDS}]"
    return (
        r"(?sU)(?:"
        rf".{{1,{limit}}}\z"
        rf"|{upto(least, 4)}(?:\r?\n){{2}}"
        rf"|{upto(least, 1)}\n"
        rf"|{upto(least, 2)}{ends}\s"
        rf"|.{{0,{limit - 1}}}\s"
        rf"|.{{0,{limit - 1}}}{ends}"
        rf"|.{{1,{limit}}})"
    )


def split_oversized(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, limit: int = 1600, overlap: int = 200, fill: float = 0.5
) -> DataFrame:
    """Rows (``id_col``, piece_no, start_index, end_index, forced) of every text longer than ``limit`` code points.

    Spans are half-open, at most ``limit`` long and cover the text. Each begins up to ``overlap`` code points before
    the end of the one before it: after the first white space of that lookback where there is one, else exactly
    ``overlap`` (or the whole of a shorter piece before). ``forced`` marks pieces cut through a stretch with neither
    white space nor a sentence end. Texts within the limit, empty and null ones give no rows; a row of ``df`` given
    twice gives its pieces twice; other columns are ignored.

    All of it is built-in functions in one narrow stage: a regular expression consumes the text piece by piece, array
    functions turn piece lengths into offsets.
    """
    if not 0 <= overlap < limit - 4:
        raise ValueError("overlap must be at least 0 and well below limit")
    core = limit - overlap
    natural = rf"(?U)[\s{SENTENCE_ENDS}]"
    rows = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where(F.length("__text") > limit)
    rows = rows.select("__id", F.regexp_extract_all("__text", F.lit(piece_pattern(core, fill)), F.lit(0)).alias("p"))
    rows = rows.select("__id", "p", F.transform("p", F.length).alias("n"))
    rows = rows.select("__id", "p", "n", offsets(F.col("n")).alias("at"))

    def piece(i: Column) -> Column:
        text, n, at = F.get("p", i), F.get("n", i), F.get("at", i)
        before, following = F.get("p", i - 1), F.get("p", i + 1)
        back = F.substring(before, F.greatest(F.length(before) - overlap + 1, F.lit(1)), F.lit(overlap))
        words = F.regexp_extract(back, r"(?sU)^\S*\s+(\S.*)$", 1)
        lookback = F.when((i == 0) | F.lit(overlap == 0), 0).otherwise(F.when(words == "", F.length(back)).otherwise(F.length(words)))
        cut = (
            (n == core)
            & ~text.rlike(natural)
            & F.coalesce(~F.substring(following, 1, 1).rlike(natural), F.lit(False))
        )
        return F.struct(i.alias("piece_no"), (at - lookback).alias("start_index"), (at + n).alias("end_index"), cut.alias("forced"))

    pieces = F.transform(F.sequence(F.lit(0), F.size("p") - 1), piece)
    return rows.select(F.col("__id").alias(id_col), F.explode(pieces).alias("x")).select(id_col, "x.*")


def found(df: DataFrame, limit: int = 1600) -> DataFrame:
    """``over`` for each text above the limit, ``forced`` where the operator had to cut through a stretch."""
    pieces = split_oversized(df, limit=limit, overlap=0)
    docs = pieces.groupBy("doc_id").agg(F.max("forced").alias("forced"))
    kinds = F.when(F.col("forced"), F.array(F.lit("over"), F.lit("forced"))).otherwise(F.array(F.lit("over")))
    return docs.select("doc_id", F.explode(kinds).alias("kind"))
