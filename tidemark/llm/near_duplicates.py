"""Near-duplicate texts with small edits (problem 2)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.durable import BROADCAST_ROWS, cut, grouped, shuffle_parts, spread
from tidemark.plans.skew import salted_join

#: Bits of a text's bitmap; rows of a tile that a bucket is cut into; rows of the tiles compared at once.
BITS, TILE, STEP = 1024, 4096, 128
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct runs of ``width`` words as sorted 64-bit hashes. Words are remembered; forgetting changes nothing."""

    def __init__(self, width: int):
        self.width, self.words = width, {}

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        found = _WORD.findall(text or "")
        if len(found) < self.width:
            return np.zeros(0, np.uint64)
        known = self.words
        if new := set(found).difference(known):
            if len(known) > 500_000:
                known.clear()
                new = set(found)
            known.update((w, xxhash.xxh3_64_intdigest(w.lower())) for w in new)
        h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        n = len(h) - self.width + 1
        run = np.zeros(n, np.uint64)
        for i in range(self.width):
            run = _mixed(run * _MIX + h[i : i + n])
        return np.unique(run)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """``BITS`` bits, one set for each shingle. Two bitmaps differ in at most as many bits as the sets in members."""
    bits = np.zeros(BITS, np.uint8)
    bits[shingles % np.uint64(BITS)] = 1
    return np.packbits(bits)


def radius(na: np.ndarray, nb: np.ndarray, t: float) -> np.ndarray:
    """Most members in which sets of these sizes differ at a Jaccard similarity of ``t`` or more."""
    return (na + nb) * ((1 - t) / (1 + t)) + 1e-9


def _signatures(df: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """Rows (id, s1, s2, n, bits, keys): a text's shingle set by 128 bits, its size, bitmap and band keys."""
    src = spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null"))
    rng = np.random.default_rng(11)
    mul = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    salt = _mixed(np.arange(1, bands + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                out: list[tuple] = []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    s = shingle(text)
                    if not len(s):
                        continue
                    low = np.full(len(mul), np.iinfo(np.uint64).max, np.uint64)
                    for p in range(0, len(s), 512):  # pieces keep the table of products in the cache
                        np.minimum(low, (mul[:, None] * s[None, p : p + 512]).min(axis=1), out=low)
                    keys = salt.copy()
                    for r in range(rows):
                        keys = _mixed(keys * _MIX + low[r * bands : (r + 1) * bands])
                    s1, s2 = _mixed(s).sum(dtype=np.uint64), _mixed(s ^ _MIX).sum(dtype=np.uint64)
                    out.append((i, s1.view(np.int64), s2.view(np.int64), len(s), bitmap(s).tobytes(), keys.view(np.int64)))
                if out:
                    i, s1, s2, n, bits, keys = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(i, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(n, pa.int32()), pa.array(bits, pa.binary()), pa.ListArray.from_arrays(np.arange(len(i) + 1, dtype=np.int32) * bands, np.concatenate(keys))],
                        ["id", "s1", "s2", "n", "bits", "keys"],
                    )

    return src.mapInArrow(run, "id long, s1 long, s2 long, n int, bits binary, keys array<long>")


def compare_tiles(rep: np.ndarray, n: np.ndarray, bits: np.ndarray, left: np.ndarray, right: np.ndarray, t: float) -> np.ndarray:
    """Pairs of ``rep`` from rows ``left`` x ``right`` that may reach ``t``: exclusive-or and bit counts of whole tiles.

    Both sides are ordered by their bit count; a tile pair is skipped if its counts lie further apart than its widest
    radius. What remains is compared exactly, so no pair at ``t`` or above is lost.
    """
    ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int32)
    left, right = left[np.argsort(ones[left], kind="stable")], right[np.argsort(ones[right], kind="stable")]
    step, out = STEP, []
    for i in range(0, len(left), step):
        a = left[i : i + step]
        for j in range(0, len(right), step):
            b = right[j : j + step]
            apart = max(ones[b[0]] - ones[a[-1]], ones[a[0]] - ones[b[-1]])
            if apart > radius(n[a].max(), n[b].max(), t):
                continue
            differ = np.bitwise_count(bits[a][:, None, :] ^ bits[b][None, :, :]).sum(axis=2, dtype=np.int32)
            x, y = np.nonzero(differ <= radius(n[a][:, None], n[b][None, :], t))
            out.append(np.stack([rep[a[x]], rep[b[y]]], axis=1))
    pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
    return np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1)


def compare_small(n: np.ndarray, ones: np.ndarray, bits: np.ndarray, rows: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (left, right) of the pairs that may reach ``t`` in many units of one small size, a unit in each row of ``rows``.

    The same comparison as :func:`compare_tiles`, a unit being one tile: pairs whose counts lie further apart than their radius are
    skipped before the exclusive-or.
    """
    i, j = np.triu_indices(rows.shape[1], 1)
    left, right, step = [], [], max(1, 100_000 // max(1, len(i)))
    for at in range(0, len(rows), step):
        a, b = rows[at : at + step][:, i].ravel(), rows[at : at + step][:, j].ravel()
        most = radius(n[a], n[b], t)
        near = np.abs(ones[a] - ones[b]) <= most
        a, b, most = a[near], b[near], most[near]
        ok = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int32) <= most
        left.append(a[ok]), right.append(b[ok])
    return np.concatenate(left), np.concatenate(right)


def _candidates(sig: DataFrame, t: float) -> DataFrame:
    """Rows (ra, rb): representatives that share a bucket and pass the exact tile comparison."""
    parts = shuffle_parts(sig.sparkSession)
    # Sets of similarity t differ in size by a factor of t at most, so they lie in the same class of sizes or in neighbouring ones.
    size_class = F.floor(F.log("n") / float(np.log(1 / t) * (1 + 1e-9))).cast("int")
    entries = sig.select("rep", size_class.alias("c"), F.explode("keys").alias("key"))
    full = cut(entries.groupBy("key").count().where("count > 1"))
    hot = full.where(F.col("count") > TILE)
    none = F.lit(None).cast("map<int,bigint>")
    if hot.isEmpty():
        full = full.withColumn("classes", none)
    else:  # one key for each TILE entries at most; a key has as many classes as the logarithm of the longest text
        of_hot = entries.join(F.broadcast(hot.select("key")), "key").groupBy("key", "c").count()
        of_hot = of_hot.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("c", "count"))).alias("classes"))
        full = full.join(F.broadcast(of_hot), "key", "left")
    placed = salted_join(entries, full, ["key"], "rep", 4)
    # A hot bucket becomes a group of each two neighbouring classes; each is cut into tiles by hash, and each pair of tiles is a unit.
    own = lambda c: F.coalesce(F.col("classes")[c], F.lit(0))
    placed = placed.withColumn("g", F.explode(F.when(F.col("classes").isNull(), F.array(F.lit(-1))).otherwise(F.array("c", F.col("c") + 1))))
    placed = placed.withColumn("tiles", F.when(F.col("g") < 0, 1).otherwise(F.ceil((own(F.col("g")) + own(F.col("g") - 1)) / TILE)).cast("int"))
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("tiles").cast("long")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    lo, hi = F.least("tile", "other"), F.greatest("tile", "other")
    units = placed.select("rep", F.xxhash64("key", "g", lo, hi).alias("unit"), (F.col("tile") == lo).alias("first"), (lo == hi).alias("same"))
    loaded = units.join(sig.select("rep", "n", "bits"), "rep")
    packed = loaded.withColumn("pack", F.pmod("unit", F.lit(4 * parts)))

    def run(table: pa.Table) -> pa.Table:
        rep, n, unit = (table.column(c).to_numpy() for c in ("rep", "n", "unit"))
        first, same = (table.column(c).to_numpy(zero_copy_only=False) for c in ("first", "same"))
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(rep), -1)
        order = np.argsort(unit, kind="stable")
        ends = np.flatnonzero(np.diff(unit[order], append=unit[order][-1:] ^ 1))
        starts = np.concatenate([[0], ends[:-1] + 1])
        sizes, out = ends - starts + 1, []
        ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int32)
        for size in np.unique(sizes[(sizes > 1) & (sizes <= 32)]):  # small units of one size are one array operation
            a, b = compare_small(n, ones, bits, order[starts[sizes == size][:, None] + np.arange(size)], t)
            out.append(np.sort(np.stack([rep[a], rep[b]], axis=1), axis=1))
        for s, e in zip(starts[sizes > 32], ends[sizes > 32]):
            rows = order[s : e + 1]
            if same[rows[0]]:
                out.append(compare_tiles(rep, n, bits, rows, rows, t))
            else:
                out.append(compare_tiles(rep, n, bits, rows[first[rows]], rows[~first[rows]], t))
        pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
        return pa.table({"ra": pairs[:, 0], "rb": pairs[:, 1]})

    return grouped(packed, "pack").groupBy("pack").applyInArrow(run, "ra long, rb long").distinct()


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = 0.8, width: int = 5, bands: int = 48, rows: int = 4
) -> tuple[DataFrame, DataFrame]:
    """Links between different texts, and every text's class of copies.

    Links: rows (ra, rb, similarity), ra < rb, representatives whose shingle sets have a Jaccard similarity of ``threshold`` or
    more. Members: rows (id, rep): documents of one shingle set share the smallest id. Shingles are ``width``
    consecutive words, maximal runs of letters and digits, lower-cased. Null, empty and shorter texts are in neither; a
    repeated row counts once; other columns are ignored.

    Copies collapse first, so a group of copies of any size is one row. Texts meet in buckets of banded minimum hashes:
    at similarity s two texts share no bucket with probability (1 - s**rows)**bands, below 1e-4 at 0.65
    and 1e-10 at 0.8 with the defaults. Within a bucket every pair is compared, in tiles, by exclusive-or and bit counts of 1,024-bit
    maps whose distance bounds the sets' difference from below (:func:`compare_tiles`); what is left is
    decided on the shingle sets. Hot buckets are cut by classes of set size, of which only neighbours can be similar, and these into tiles;
    pairs of tiles are units of work.
    """
    sig = cut(_signatures(df, id_col, text_col, width, bands, rows))
    members = sig.select("id", "s1", "s2").distinct()
    reps = members.groupBy("s1", "s2").agg(F.min("id").alias("rep"))
    members = cut(salted_join(members, reps, ["s1", "s2"], "id", 4).select("id", "rep"))
    one = sig.join(members.where("id = rep").select("id", "rep"), "id").dropDuplicates(["rep"]).select("rep", "n", "bits", "keys")
    pairs = cut(_candidates(cut(one), threshold))
    wanted = pairs.select(F.explode(F.array("ra", "rb")).alias("id")).distinct()
    if pairs.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                data = pa.array([shingle(x).tobytes() for x in part.column(1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), data], ["id", "s"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(both / (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], ["ra", "rb", "similarity"])

    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(wanted, "id").dropDuplicates(["id"])
    held = cut(docs.mapInArrow(sets, "id long, s binary"))
    a, b = held.select(F.col("id").alias("ra"), F.col("s").alias("sa")), held.select(F.col("id").alias("rb"), F.col("s").alias("sb"))
    links = pairs.join(a, "ra").join(b, "rb").select("ra", "rb", "sa", "sb").mapInArrow(exact, "ra long, rb long, similarity double")
    return cut(links.where(F.col("similarity") >= threshold)), members


def expand(links: DataFrame, members: DataFrame) -> DataFrame:
    """Rows (doc_a, doc_b), doc_a < doc_b: every pair of documents, copies included. As many rows as there are pairs."""
    a, b = members.select(F.col("rep").alias("ra"), F.col("id").alias("a")), members.select(F.col("rep").alias("rb"), F.col("id").alias("b"))
    across = salted_join(b, salted_join(a, links.select("ra", "rb"), ["ra"], "a", 4), ["rb"], "b", 4)
    copied = members.groupBy("rep").count().where("count > 1").select("rep")
    copies = salted_join(members, copied, ["rep"], "id", 4)  # a text may have any number of them
    within = salted_join(copies.select("rep", F.col("id").alias("a")), copies.select("rep", F.col("id").alias("b")), ["rep"], "a").where("a < b").select("a", "b")
    pairs = across.select("a", "b").union(within)
    return pairs.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"))


def classes(links: DataFrame, members: DataFrame, rounds: int = 40) -> DataFrame:
    """Rows (id, class_id, copies, links): each document's group over links and copies, named by its smallest document.

    Representatives take the smallest label among themselves and those they link to, then that label's own label, until
    nothing changes; each round is a join and an aggregate, cut from its lineage, with joins salted, as a group may hold a third of all. ``links`` counts the representatives linked to.
    """
    both = cut(links.select("ra", "rb").union(links.select("rb", "ra")))
    label = cut(both.groupBy(F.col("ra").alias("v")).agg(F.least(F.min("rb"), F.min("ra")).alias("c")))
    for _ in range(rounds):
        near = salted_join(both, label.select(F.col("v").alias("rb"), "c"), ["rb"], "ra", 4).groupBy(F.col("ra").alias("v")).agg(F.min("c").alias("m"))
        step = label.join(near, "v").select("v", F.least("c", "m").alias("n"), "c")
        step = cut(step)
        jump = step.select(F.col("v").alias("n"), F.col("n").alias("j"))  # every label is a representative itself
        new = cut(salted_join(step, jump, ["n"], "v").select("v", F.least("n", "j").alias("n"), "c"))  # a label may stand for most of them
        changed = new.where("n <> c").limit(1).count()
        label = new.select("v", F.col("n").alias("c"))
        if not changed:
            break
    else:
        raise RuntimeError("labels still change; allow more rounds")
    degree = both.groupBy(F.col("ra").alias("rep")).agg(F.count("*").alias("links"))
    sizes = members.groupBy("rep").agg(F.count("*").alias("copies"))
    out = members.join(sizes, "rep").join(label.select(F.col("v").alias("rep"), "c"), "rep", "left").join(degree, "rep", "left")
    return out.select("id", F.coalesce("c", "rep").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
