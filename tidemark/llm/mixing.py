"""Mixing sources to target weights by token size (problem 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.site_lines import source_key
from tidemark.llm.tokens import count_tokens
from tidemark.plans.durable import cut
from tidemark.plans.prefix import range_sum, running_sum

#: Most rows a table of targets may have; it is read by the driver and broadcast.
MAX_TARGETS = 10_000


def _targets(targets: DataFrame) -> DataFrame:
    """One row a source: spelled alike, the largest share and cap of a repeated one; shares of null, NaN and less than 0 are 0."""
    rows = targets.select(source_key(F.col("source")).alias("key"), F.col("source").alias("name"), F.col("target_share").alias("share"), F.col("max_repeats").alias("cap"))
    share = F.col("share")
    rows = rows.where(F.col("key").isNotNull()).withColumn("share", F.when((share > 0) & ~F.isnan("share"), share).otherwise(0.0))
    cap = F.coalesce(F.when(F.max("share") > 0, F.max(F.when(F.col("share") > 0, F.col("cap")))).otherwise(F.max("cap")), F.lit(1))
    rows = rows.groupBy("key").agg(F.min("name").alias("name"), F.max("share").alias("share"), F.greatest(cap, F.lit(0)).alias("cap"))
    if rows.count() > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    return rows


def _queue(df: DataFrame, targets: DataFrame, seed: int, tokenizer: str, folder: str | None) -> tuple[DataFrame, DataFrame]:
    """Listed documents with running token sums in shuffled order; and the targets with their sources' token sums."""
    goal = cut(_targets(targets))
    docs = df.select("doc_id", source_key(F.col("source")).alias("key"), "text").join(F.broadcast(goal.select("key")), "key")
    sized = count_tokens(docs, name=tokenizer, folder=folder).withColumn("u", F.xxhash64("doc_id", F.lit(seed)))
    sized = cut(sized.where(F.col("tokens") > 0))
    queued = running_sum(sized, ["key"], F.shiftright("u", 48), [F.col("u"), F.col("doc_id"), F.col("tokens")], F.col("tokens"), "until")
    totals = sized.groupBy("key").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
    return cut(queued), cut(goal.join(F.broadcast(totals), "key", "left").na.fill(0, ["tokens", "documents"]))


def _horizon(rows: list, budget: float) -> float:
    """The virtual time at which the sources' served tokens reach the budget: each serves share x time until it is empty."""
    ends = sorted((r["tokens"] * r["cap"] / r["share"], r["share"], r["tokens"] * r["cap"]) for r in rows)
    served, rate = 0.0, sum(r["share"] for r in rows)
    for end, share, full in ends:
        if rate <= 0 or served + rate * end >= budget:
            break
        served, rate = served + full, rate - share
    return (budget - served) / rate if rate > 1e-12 else float("inf")


def _finished(df: DataFrame, targets: DataFrame, budget: int | None, seed: int, tokenizer: str, folder: str | None) -> tuple[DataFrame, DataFrame, list, float]:
    """Turns with virtual finish times; targets with their sources' sums and last finish; these as rows; the size of the mix.

    A source goes through its documents as often as the end of the mix needs, at most ``cap`` times. Its last finish is the greatest
    of its queue's times on the last time round.
    """
    queued, goal = _queue(df, targets, seed, tokenizer, folder)
    finish = ((F.col("repeat") - 1) * F.col("all_tokens") + F.col("until")) / F.col("share")
    shares = goal.where("share > 0").select("key", "name", "share", "cap", F.col("tokens").alias("all_tokens"))
    waiting = queued.join(F.broadcast(shares), "key")
    ends = waiting.withColumn("repeat", F.col("cap")).groupBy("key").agg(F.max(finish).alias("last_finish"))
    goal = cut(goal.join(F.broadcast(ends), "key", "left").na.fill(0.0, ["last_finish"]))
    rows = goal.collect()  # the targets
    size = sum(r["tokens"] for r in rows) if budget is None else budget  # also of sources that ask for nothing, and aren't served
    asking = [r for r in rows if r["share"] > 0 and r["tokens"] > 0]
    horizon = min(_horizon(asking, size), max((r["last_finish"] for r in asking), default=0.0))
    times = F.ceil(F.lit(horizon * (1 + 1e-9)) * F.col("share") / F.col("all_tokens")) + 1  # rounds begun by then, and one for its last document
    turns = waiting.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.greatest(F.least(F.col("cap").cast("bigint"), times), F.lit(1)))))
    turns = turns.where(F.col("repeat") <= F.col("cap")).withColumn("finish", finish)  # a cap of 0 leaves none
    # A document finishes after it begins, so the exact end lies at the fluid one plus at most a document of each source.
    near = turns.where((F.col("finish") - F.col("tokens") / F.col("share")) <= horizon * (1 + 1e-9))
    return near, goal, rows, float(size)


def starved(df: DataFrame, targets: DataFrame, *, budget: int | None = None, seed: int = 17, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """Rows (source): the targets whose finish times end before the mix does.

    While all sources are served, one of share s has had s x t tokens at virtual time t, so a mix of ``budget`` tokens in the target
    shares ends at time ``budget``. A source whose last document finishes earlier can't reach its share; neither can one
    that has none. Sources of no share reach it. Options as in :func:`mix`.
    """
    _, goal, _, size = _finished(df, targets, budget, seed, tokenizer, folder)
    return goal.where((F.col("share") > 0) & ((F.col("tokens") == 0) | (F.col("last_finish") < size))).select(F.col("name").alias("source"))


def mix(df: DataFrame, targets: DataFrame, *, budget: int | None = None, seed: int = 17, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix, and the report on it.

    Weighted fair queueing: a document's virtual finish time is its source's running token sum, in an order shuffled
    by ``seed``, divided by the source's target share; a source goes through its documents at most ``max_repeats``
    times. Documents are sorted by finish time, over the cluster by ranges of it, and taken until the next would go beyond
    ``budget`` tokens (None: as many as all texts of the listed sources have).

    Mix: rows (position, doc_id, source, repeat, tokens, finish). Report: rows (source, target_share, max_repeats,
    documents, available_tokens, mixed_tokens, actual_share, most_possible_share, reachable), one a target;
    ``reachable`` is whether the source's finish times last to the end of a mix of budget size (:func:`starved`).

    Documents of other or no source, of null and empty texts don't take part; a row given twice takes part twice; a
    listed source without documents mixes 0 tokens and isn't reachable; one of no share counts in the size, mixes 0 tokens and is reachable; without any document the mix is empty.
    Running sums go by buckets of the shuffle key and ranges of the finish time, so a source that holds a third of the rows is many
    tasks. Documents are repeated only as often as the end of the mix needs. Only the targets, at most 10,000 rows, are collected and broadcast.
    """
    near, goal, _, size = _finished(df, targets, budget, seed, tokenizer, folder)
    placed = range_sum(near, [F.col("finish"), F.col("key"), F.col("doc_id"), F.col("repeat"), F.col("u")], F.col("tokens"), "upto")
    taken = cut(placed.where(F.col("upto") <= size).select(F.col("upto").alias("position"), "doc_id", F.col("name").alias("source"), "repeat", "tokens", "finish"))
    mixed = taken.groupBy("source").agg(F.sum("tokens").alias("mixed"))
    report = goal.join(F.broadcast(mixed.withColumnRenamed("source", "name")), "name", "left").na.fill(0, ["mixed"])
    whole = F.sum("mixed").over(Window.partitionBy())
    report = report.select(
        F.col("name").alias("source"), F.col("share").alias("target_share"), F.col("cap").alias("max_repeats"), "documents",
        F.col("tokens").alias("available_tokens"), F.col("mixed").alias("mixed_tokens"),
        F.when(whole > 0, F.col("mixed") / whole).otherwise(0.0).alias("actual_share"),
        (F.col("tokens") * F.col("cap") / F.lit(max(size, 1.0))).alias("most_possible_share"),
        ((F.col("share") <= 0) | ((F.col("tokens") > 0) & (F.col("last_finish") >= size))).alias("reachable"),
    )
    return taken, report
