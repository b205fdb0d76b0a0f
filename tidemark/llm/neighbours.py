"""The most similar vectors of every vector (problem 1)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.durable import BROADCAST_ROWS, cut, grouped, spread
from tidemark.plans.skew import salted_join

SEED = 20240229
#: Vectors the driver's trees are fitted on; all vectors are indexed. Samples that a fitted leaf needs.
SAMPLE_ROWS, LEAF_SAMPLE = 20_000, 8
#: Aimed size of a cell, for tables of up to so many rows (:func:`cell_size`); rows of a block of the tree inside a cell.
CELL_ROWS, CELL_BASE, BLOCK_ROWS = 4_096, 1 << 19, 256
#: Trees at least; the probability below which a row is sent to further cells.
TREES, FLOOR = 10, 0.9
#: Places that a neighbour is drawn at, for each row and tree, to see how far beyond its own cell a row is to be sent.
DRAWS = 16
#: Added to cosines of 32-bit sums where a bound is to hold.
ROUNDING = 2e-6
#: Queries that are broadcast at once, and rows a task indexes at once, when stated queries search all rows.
QUERY_BLOCK, INDEX_BLOCK = 50_000, 100_000


def chi_square_quantile(p: float, m: int) -> float:
    """The value that a chi-square variable of ``m`` degrees of freedom stays below with probability ``p``."""

    def below(x: float) -> float:
        a, half = m / 2, x / 2
        term = total = 1 / a
        k = 0
        while term > total * 1e-15:
            k += 1
            term *= half / (a + k)
            total += term
        return total * math.exp(a * math.log(half) - half - math.lgamma(a))

    lo, hi = 1e-9, 10.0 * m + 100
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def _dense(vectors: pa.Array, dim: int, kind: type = np.float32) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the usable vectors, and these scaled to length 1."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    size = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(size == dim)
    if not len(rows):
        return rows, np.zeros((0, dim), kind)
    flat = vectors.take(pa.array(rows)).flatten()
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)  # nulls become NaN
    with np.errstate(all="ignore"):
        x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
        x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    good = np.isfinite(x).all(axis=1)
    return rows[good], x[good].astype(kind, copy=False)


def _hash(x: np.ndarray) -> np.ndarray:
    """64 bits for each vector, equal for equal ones."""
    odd = np.random.default_rng(SEED).integers(0, 1 << 63, x.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    h = ((x + np.float32(0)).view(np.uint32).astype(np.uint64) * odd).sum(axis=1, dtype=np.uint64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def projections(dim: int, m: int, trees: int) -> np.ndarray:
    """Gaussian (2-stable) directions: a squared projected distance is the squared distance times chi-square of m."""
    return np.random.default_rng(SEED + 1).standard_normal((dim, m * trees)).astype(np.float32)


def cell_size(n: int) -> float:
    """The aimed size of a cell: it grows with the third root of large tables, so that the trees needed grow less."""
    return CELL_ROWS * max(1.0, n / CELL_BASE) ** (1 / 3)


def trees_needed(depth: int, cosine: float, probability: float) -> int:
    """So many own cells that two vectors of that cosine share one with ``probability``: a median split parts them at the share of their angle."""
    same = (1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi) ** depth
    return 1 if same >= probability else math.ceil(math.log(1 - probability) / math.log(1 - same))


def _normal(z: np.ndarray) -> np.ndarray:
    """The normal distribution, to 2e-4."""
    z = np.clip(z, -8, 8)
    return 1 / (1 + np.exp(-(1.5976 * z + 0.07056 * z**3)))


class Tree:
    """A kd-tree's upper splits, fitted on a sample: each halves it at the median of the widest dimension.

    A leaf that the sample can't split further is halved once more along each dimension, at the medians of its
    sample, so ``depth`` may exceed what the sample carries by as many levels as there are dimensions.
    """

    def __init__(self, points: np.ndarray, depth: int):
        m = points.shape[1]
        self.base = min(depth, int(math.log2(max(1, len(points) // LEAF_SAMPLE))))
        self.depth = min(depth, self.base + m)
        self.dims, self.cuts = np.zeros((1 << self.base) - 1, np.int32), np.zeros((1 << self.base) - 1, np.float32)
        self.middle = np.zeros((1 << self.base, m), np.float32)
        held = {0: np.arange(len(points))}
        for node in range((1 << self.base) - 1):
            own = held.pop(node)
            if len(own) > 1:
                self.dims[node] = d = int(points[own].std(axis=0).argmax())
                self.cuts[node] = np.median(points[own, d])
            side = points[own, self.dims[node]] > self.cuts[node]
            held[2 * node + 1], held[2 * node + 2] = own[~side], own[side]
        for node, own in held.items():
            if len(own):
                self.middle[node - ((1 << self.base) - 1)] = np.median(points[own], axis=0)

    def split(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The dimension and place of the split below each node of a level."""
        if level < self.base:
            return self.dims[node], self.cuts[node]
        d = np.full(len(node), level - self.base)
        leaf = ((node + 1) >> (level - self.base)) - (1 << self.base)
        return d, self.middle[leaf, d]

    def cell(self, node: np.ndarray) -> np.ndarray:
        return node - ((1 << self.depth) - 1)

    def route(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        node, rows = np.zeros(len(points), np.int64), np.arange(len(points))
        for level in range(self.depth):
            d, c = self.split(level, node)
            node = 2 * node + 1 + (points[rows, d] > c)
        return self.cell(node)

    def stays(self, points: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        """The probability that a neighbour at ``cosine`` lies in the same cell, from below: its projection is normal with that correlation."""
        node, rows, p = np.zeros(len(points), np.int64), np.arange(len(points)), np.ones(len(points))
        wide = np.sqrt(np.maximum(1 - cosine * cosine, 1e-6))
        for level in range(self.depth):
            d, c = self.split(level, node)
            own = points[rows, d]
            side = own > c
            p *= _normal(np.where(side, 1, -1) * (cosine * own - c) / wide)
            node = 2 * node + 1 + side
        return p

    def gaps(self, points: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Squared distance of each point to the cell that the other point of its row lies in."""
        node, rows, off = np.zeros(len(points), np.int64), np.arange(len(points)), np.zeros_like(points)
        for level in range(self.depth):
            d, c = self.split(level, node)
            own, side = points[rows, d], others[rows, d] > c
            off[rows, d] = np.where((own > c) != side, np.maximum(off[rows, d], np.abs(own - c)), off[rows, d])
            node = 2 * node + 1 + side
        return (off * off).sum(axis=1)

    def within(self, points: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cells): each point's own cell, and all others whose squared distance to it is at most ``reach``."""
        row, node, off = np.arange(len(points)), np.zeros(len(points), np.int64), np.zeros_like(points)
        for level in range(self.depth):
            d, c = self.split(level, node)
            own = points[row, d]
            side = own > c
            over = off.copy()
            i = np.arange(len(row))
            over[i, d] = np.maximum(over[i, d], np.abs(own - c))
            ok = (over * over).sum(axis=1) <= reach[row]
            row, off = np.concatenate([row, row[ok]]), np.concatenate([off, over[ok]])
            node = np.concatenate([2 * node + 1 + side, 2 * node[ok] + 1 + ~side[ok]])
        return row, self.cell(node)

    def reach(self, points: np.ndarray, cosine: np.ndarray, share: float, random: np.random.Generator) -> np.ndarray:
        """The squared distance to cells within which a neighbour at ``cosine`` lies with a probability of ``share``: places of it are drawn."""
        c = cosine[:, None]
        drawn = [self.gaps(points, (c * points + np.sqrt(1 - c * c) * random.standard_normal(points.shape)).astype(np.float32)) for _ in range(DRAWS)]
        return np.sort(np.stack(drawn), axis=0)[min(DRAWS, math.ceil(share * DRAWS)) - 1]


def _blocks(points: np.ndarray, most: int) -> list[np.ndarray]:
    """The leaves of a kd-tree over a cell's projections."""
    stack, out = [np.arange(len(points))], []
    while stack:
        own = stack.pop()
        if len(own) <= most:
            out.append(own)
            continue
        order = own[np.argpartition(points[own, points[own].std(axis=0).argmax()], len(own) // 2)]
        stack += [order[: len(own) // 2], order[len(own) // 2 :]]
    return out


def _wider(cosine: np.ndarray, angle: np.ndarray) -> np.ndarray:
    """The cosine of an angle larger by ``angle``."""
    wide = np.cos(np.minimum(np.arccos(np.clip(cosine, -1, 1)) + angle, math.pi)) - ROUNDING
    return np.where(angle > 0, wide, cosine)


def _search(
    q: np.ndarray, q_points: np.ndarray, own_row: np.ndarray, x: np.ndarray, points: np.ndarray, k: int, least: np.ndarray, slack: np.ndarray, chi: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows of ``q``, rows of ``x``, cosines) of all that can be among a row's ``k`` best; and what each k-th best reaches for sure.

    ``slack``: the angle by which those of a row of ``q`` may be wrong. ``own_row``: a row's place in ``x``, or -1.
    """
    sure = np.array(least, np.float64)
    blocks, asking = _blocks(points, BLOCK_ROWS), _blocks(q_points, BLOCK_ROWS) if len(q) else []
    low, high = np.array([points[b].min(axis=0) for b in blocks]), np.array([points[b].max(axis=0) for b in blocks])
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for own in asking:
        a, b = q_points[own].min(axis=0), q_points[own].max(axis=0)
        apart = (np.maximum(0, np.maximum(low - b, a - high)) ** 2).sum(axis=1)
        far, wrong, self_row = sure[own], slack[own], own_row[own]
        worst = _wider(far, wrong).astype(np.float32)
        r, c, v = np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.float32)
        for j in np.argsort(apart, kind="stable"):
            if apart[j] > chi * 2 * (1 - float(far.min())):
                break
            s = q[own] @ x[blocks[j]].T
            i, at = np.nonzero(s >= worst[:, None])
            new = blocks[j][at]
            other = new != self_row[i]
            i, at, new = i[other], at[other], new[other]
            if not len(i):
                continue
            r, c, v = np.concatenate([r, i]), np.concatenate([c, new]), np.concatenate([v, s[i, at]])
            order = np.lexsort((-v, r))
            r, c, v = r[order], c[order], v[order]
            full = np.flatnonzero(np.arange(len(r)) - np.searchsorted(r, r) == k - 1)
            far[r[full]] = np.maximum(far[r[full]], _wider(v[full].astype(np.float64), wrong[r[full]]))
            worst = _wider(far, wrong).astype(np.float32)
            good = v >= worst[r]
            r, c, v = r[good], c[good], v[good]
        sure[own] = far
        out.append((own[r], c, v))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.float32), sure
    return *(np.concatenate(z) for z in zip(*out)), sure


def search_cell(x: np.ndarray, points: np.ndarray, k: int, least: float, chi: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (row, neighbour row, cosine): the ``k`` neighbours of each row, and ties, with a cosine of at least ``least``.

    Blocks are met in the order of their projected distance. Their vectors are verified until the distance of the next
    block, squared, is above ``chi`` times the squared distance to the k-th best so far, or to ``least``: with
    the quantile's probability nothing nearer is then left in the cell.
    """
    return _search(x, points, np.arange(len(x)), x, points, k, np.full(len(x), least), np.zeros(len(x)), chi)[:3]


def _hashes(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """Rows (id, h) of the usable vectors."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = _dense(b.column(1), dim)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(_hash(x))], ["id", "h"])

    return df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where(F.col("id").isNotNull()).mapInArrow(run, f"id {kind}, h long")


def _vectors(df: DataFrame, vec_col: str, dim: int) -> DataFrame:
    """Rows (h, x): unit vectors as 32-bit floats, copies in one batch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, x = _dense(b.column(0), dim)
            h, first = np.unique(_hash(x), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array([r.tobytes() for r in x[first]], pa.binary())], ["h", "x"])

    return df.select(F.col(vec_col).alias("v")).mapInArrow(run, "h long, x binary")


def _first_cells(
    df: DataFrame, id_col: str, vec_col: str, dim: int, m: int, trees: int | None, cosine: float, probability: float
) -> tuple[DataFrame, list[Tree], np.ndarray, int]:
    """Rows (cell, h, wrong, q): each vector in 8 bits, the angle it is wrong by, and its cell in the first tree; the trees, their projections, the number of rows."""
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(vec_col).alias("v")).where(F.size("v") == dim)
    n = df.count()
    sample = rows.sample(False, min(1.0, SAMPLE_ROWS / max(n, 1)), SEED).limit(2 * SAMPLE_ROWS).toArrow()
    _, x = _dense(sample.column("v"), dim) if sample.num_rows else (None, np.zeros((0, dim), np.float32))
    x = np.unique(x, axis=0) if len(x) else x
    depth = max(0, math.ceil(math.log2(max(1, n / cell_size(n)))))
    trees = trees or max(TREES, trees_needed(depth, cosine, probability))
    wide = projections(dim, m, trees)
    forest = [Tree(x @ wide[:, t * m : (t + 1) * m], depth) for t in range(trees)]
    tree = forest[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            _, x = _dense(b.column(0), dim)
            h, first = np.unique(_hash(x), return_index=True)
            new = np.array([v not in seen for v in h.tolist()], bool)
            if len(seen) < 200_000:  # copies that a partition holds again are sent once
                seen.update(h.tolist())
            h, x = h[new], x[first[new]]
            if not len(h):
                continue
            scale = (np.abs(x).max(axis=1) / 127).astype(np.float32)
            q = np.rint(x / scale[:, None]).astype(np.int8)
            off = np.sqrt(((q * scale[:, None].astype(np.float64) - x) ** 2).sum(axis=1))
            wrong = np.arcsin(np.minimum(off, 1)) * 1.001 + 1e-6
            data = pa.array([r.tobytes() for r in q], pa.binary())
            cell = tree.route(_unit(q) @ wide[:, :m])
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(h), pa.array(wrong.astype(np.float32)), data], ["cell", "h", "wrong", "q"])

    return spread(rows).mapInArrow(run, "cell long, h long, wrong float, q binary"), forest, wide, n


def _unit(q: np.ndarray) -> np.ndarray:
    x = q.astype(np.float32)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def similar_pairs(
    df: DataFrame, id_col: str, vec_col: str, *, k: int = 5, min_cosine: float = 0.9, dim: int = 64, m: int = 8, trees: int | None = None, probability: float = 0.98
) -> DataFrame:
    """Rows (a, b, cosine), a < b: one of the two is among the ``k`` most similar of the other, at ``min_cosine`` or more.

    Vectors count if they have ``dim`` values, none null or NaN, not all 0; rows of a null id don't count. A repeated row counts
    once; of an id with different vectors the one of smaller hash counts. Equal vectors are one point of the
    search; among ids equally similar the smaller come first, so of a group of copies each member pairs with the first
    ``k`` others. Extra columns are ignored; an empty table gives no rows.

    Method: Gaussian projections to ``m`` dimensions, each indexed by a kd-tree whose upper splits are fitted on at most
    2 x 20,000 sampled vectors (:class:`Tree`). Splits at medians keep cells even where vectors crowd. There are as many trees, ten
    at least, as two vectors at ``min_cosine`` need to share a cell of one with ``probability``; that number grows with the trees' depth, cells
    with the third root of the table. A first round searches the first tree's cells, which gives a bound for each row's k-th
    best. Rows go on to their own cells of the other trees; where these would meet a neighbour at that bound with less than
    a probability of 0.9, as in a crowd whose members are hardly nearer than the cells are wide, also to all cells near enough that it
    is met with ``probability``. A cell is searched through a kd-tree of its own until the chi-square test of
    ``probability`` holds. Cosines there are of 8-bit vectors, whose error in angle is known: every candidate that can be among the k
    best goes on, and exact cosines decide.
    """
    chi = chi_square_quantile(probability, m)
    ids = _hashes(df, id_col, vec_col, dim)
    members = cut(ids.groupBy("id").agg(F.min("h").alias("h"), (F.min("h") < F.max("h")).alias("several")))
    first_cells, forest, wide, n_rows = _first_cells(df, id_col, vec_col, dim, m, trees, min_cosine, probability)
    trees, depth = len(forest), forest[0].depth
    if not members.where("several").isEmpty():  # vectors that are no id's must not take a place among the k best
        first_cells = first_cells.join(ids.join(members.select("h"), "h", "left_anti").select("h").distinct(), "h", "left_anti").select("cell", "h", "wrong", "q")
    members = members.select("id", "h")
    share = 1 - (1 - probability) ** (1 / max(1, trees - 1))
    shared = df.sparkSession.sparkContext.broadcast(forest)

    def read(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        q = np.frombuffer(b"".join(table.column("q").to_pylist()), np.int8).reshape(-1, dim)
        return q, table.column("wrong").to_numpy().astype(np.float64)

    def rows_in(table: pa.Table, cell: np.ndarray, home: bool) -> pa.Table:
        return pa.table({"cell": cell.astype(np.int64), "home": np.full(len(cell), home), **{c: table.column(c) for c in ("h", "wrong", "sure", "q")}})

    def pairs_of(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        lo, hi = np.minimum(h[a], h[b]), np.maximum(h[a], h[b])
        return np.unique(np.stack([lo, hi], axis=1), axis=0) if len(lo) else np.zeros((0, 2), np.int64)

    def as_rows(pairs: np.ndarray) -> pa.Table:
        """Pairs of the first round go with the vectors of the second, in groups below 0."""
        none = np.zeros(len(pairs))
        names = pa.array([x.tobytes() for x in pairs[:, 1]], pa.binary())
        cell = -1 - (pairs[:, 0] & np.int64(1023))
        return pa.table({"cell": cell, "home": none.astype(bool), "h": pairs[:, 0], "wrong": none.astype(np.float32), "sure": none, "q": names})

    def send(table: pa.Table) -> pa.Table:
        _, first = np.unique(table.column("h").to_numpy(), return_index=True)
        table = table.take(pa.array(first))
        q, wrong = read(table)
        x = _unit(q)
        p = x @ wide
        a, b, _, sure = _search(x, p[:, :m], np.arange(len(x)), x, p[:, :m], k, np.full(len(x), min_cosine), wrong + wrong.max(), chi)
        random = np.random.default_rng(SEED + 2)
        table = table.append_column("sure", pa.array(sure))
        out = [as_rows(pairs_of(table.column("h").to_numpy(), a, b))]
        place = lambda t: p[:, t * m : (t + 1) * m]
        missed = np.ones(len(x))
        for t in range(trees):
            missed *= 1 - shared.value[t].stays(place(t), sure)
        far = np.flatnonzero(missed > 1 - FLOOR)
        for t in range(1, trees):
            tree = shared.value[t]
            own = tree.route(place(t))
            out.append(rows_in(table, own + (t << depth), True))
            for i in range(0, len(far), 1024):
                some = far[i : i + 1024]
                at = place(t)[some]
                row, cell = tree.within(at, tree.reach(at, sure[some], share, random))
                other = own[some][row] != cell
                out.append(rows_in(table.take(pa.array(some[row[other]])), cell[other] + (t << depth), False))
        return pa.concat_tables(out)

    def search(table: pa.Table) -> pa.Table:
        cell = table.column("cell")[0].as_py()
        if cell < 0:
            pairs = np.stack([table.column("h").to_numpy(), np.frombuffer(b"".join(table.column("q").to_pylist()), np.int64)], axis=1)
            return pa.table({"ha": pairs[:, 0], "hb": pairs[:, 1]})
        tree = cell >> depth
        home = table.column("home").to_numpy()
        table = pa.concat_tables([table.filter(pa.array(home)), table.filter(pa.array(~home))])
        h, n = table.column("h").to_numpy(), int(home.sum())
        q, wrong = read(table)
        x = _unit(q)
        p = x @ wide[:, tree * m : (tree + 1) * m]
        own = np.where(np.arange(len(x)) < n, np.arange(len(x)), -1)
        if not n:
            return pa.table({"ha": np.zeros(0, np.int64), "hb": np.zeros(0, np.int64)})
        a, b, _, _ = _search(x, p, own, x[:n], p[:n], k, table.column("sure").to_numpy(), wrong + wrong[:n].max(), chi)
        pairs = pairs_of(h, a, b)
        return pa.table({"ha": pairs[:, 0], "hb": pairs[:, 1]})

    size = n_rows * (dim + 32)
    cells = grouped(first_cells, "cell", size).groupBy("cell").applyInArrow(send, "cell long, home boolean, h long, wrong float, sure double, q binary")
    rough = cut(grouped(cells, "cell", size * (trees - 1)).groupBy("cell").applyInArrow(search, "ha long, hb long").distinct())
    wanted = rough.select(F.explode(F.array("ha", "hb")).alias("h")).distinct()
    if rough.count() <= BROADCAST_ROWS:  # at most two ids of 8 bytes a pair
        wanted = F.broadcast(wanted)
    points = cut(_vectors(df, vec_col, dim).join(wanted, "h").dropDuplicates(["h"]))
    a, b = points.select(F.col("h").alias("ha"), F.col("x").alias("xa")), points.select(F.col("h").alias("hb"), F.col("x").alias("xb"))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x, y = (np.frombuffer(b"".join(t.column(i).to_pylist()), np.float32).reshape(-1, dim).astype(np.float64) for i in (2, 3))
            c = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(c)], ["ha", "hb", "cosine"])

    near = rough.join(a, "ha").join(b, "hb").select("ha", "hb", "xa", "xb").mapInArrow(exact, "ha long, hb long, cosine double")
    near = cut(near.where(F.col("cosine") >= min_cosine))

    # Ids of each point. Groups of copies are counted, and only their first k + 1 members take part as neighbours.
    first = Window.partitionBy("h").orderBy("id")
    heads = members.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    heads = cut(heads)
    groups = heads.groupBy("h").agg(F.max("place").alias("size"))  # k + 1 stands for any larger size

    copied = groups.where(F.col("size") > 1).select("h")
    others = heads.join(copied, "h").select("h", F.col("id").alias("other"), F.col("place"))
    inside = salted_join(members, others, ["h"], "id").where(F.col("id") != F.col("other"))
    own_place = heads.select("h", "id", F.col("place").alias("own"))
    inside = inside.join(own_place, ["h", "id"], "left").where(
        F.when(F.col("own").isNull() | (F.col("own") > F.col("place")), F.col("place") <= k).otherwise(F.col("place") <= k + 1)
    )
    copies = inside.select("id", "other", F.lit(1.0).alias("cosine"))

    both = near.select("ha", "hb", "cosine").union(near.select("hb", "ha", "cosine"))
    both = both.join(groups.select(F.col("h").alias("ha"), (F.lit(k + 1) - F.col("size")).alias("slots")).where("slots > 0"), "ha")
    spots = heads.where(F.col("place") <= k).select(F.col("h").alias("hb"), F.col("id").alias("other"))
    by = Window.partitionBy("ha").orderBy(F.col("cosine").desc(), "other")
    ranked = both.join(spots, "hb").withColumn("r", F.row_number().over(by)).where(F.col("r") <= F.col("slots"))
    cross = ranked.join(heads.select(F.col("h").alias("ha"), "id"), "ha").select("id", "other", "cosine")

    pairs = copies.union(cross).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "cosine")
    return pairs.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def search_index(q: np.ndarray, q_points: np.ndarray, x: np.ndarray, points: np.ndarray, k: int, chi: float) -> tuple[np.ndarray, np.ndarray]:
    """(cosines, rows of ``x``), each queries x ``k``: the best verified until the chi-square test holds; row -1 where there are fewer.

    As in :func:`search_cell`, for queries that are not themselves the index.
    """
    best, rows = np.full((len(q), k), -2, np.float32), np.full((len(q), k), -1)
    blocks = _blocks(points, 2 * BLOCK_ROWS)
    low, high = np.array([points[b].min(axis=0) for b in blocks]), np.array([points[b].max(axis=0) for b in blocks])
    for own in _blocks(q_points, BLOCK_ROWS):
        a, b = q_points[own].min(axis=0), q_points[own].max(axis=0)
        apart = (np.maximum(0, np.maximum(low - b, a - high)) ** 2).sum(axis=1)
        top, at = best[own], rows[own]
        for j in np.argsort(apart, kind="stable"):
            if apart[j] > chi * 2 * (1 - float(top[:, -1].min())):
                break
            s = q[own] @ x[blocks[j]].T
            better = np.flatnonzero((s > top[:, -1:]).any(axis=1))
            if not len(better):
                continue
            c = np.concatenate([top[better], s[better]], axis=1)
            r = np.concatenate([at[better], np.broadcast_to(blocks[j], (len(better), len(blocks[j])))], axis=1)
            order = np.argpartition(-c, k - 1, axis=1)[:, :k]
            order = np.take_along_axis(order, np.argsort(-np.take_along_axis(c, order, 1), axis=1, kind="stable"), 1)
            top[better], at[better] = np.take_along_axis(c, order, 1), np.take_along_axis(r, order, 1)
        best[own], rows[own] = top, at
    return best, rows


def most_similar(
    df: DataFrame, queries: DataFrame, id_col: str, vec_col: str, *, k: int = 5, dim: int = 64, m: int = 6, probability: float = 0.9
) -> DataFrame:
    """Rows (query_id, neighbour_id, cosine, rank): the ``k`` most similar other ids of each query, whatever their cosine.

    Both tables have ``id_col`` (whole numbers) and ``vec_col``. Usable vectors are as in :func:`similar_pairs`; a repeated row counts once;
    equally similar ids are in order; queries without a usable vector and rows of a null id have no result.

    Queries go out in blocks of at most 50,000 (26 MB), by hash of their id; every task indexes its rows by a kd-tree over ``m``
    projections and sends on each query's best ``k`` of them. A neighbour is missed with a probability of at most
    1 - ``probability``, less where blocks hold more than was asked.
    """
    chi, wide = chi_square_quantile(probability, m), projections(dim, m, 1)
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where(F.col("id").isNotNull() & (F.size("v") == dim)).dropDuplicates(["id"])
    asked = cut(asked)
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK * 1.05))
    base = spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where(F.col("id").isNotNull() & (F.size("v") == dim)))
    found = None
    for n in range(blocks):
        table = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n).toArrow()
        keep, q = _dense(table.column("v"), dim, np.float64) if table.num_rows else (np.zeros(0, int), np.zeros((0, dim)))
        shared = df.sparkSession.sparkContext.broadcast((table.column("id").to_numpy()[keep] if len(keep) else np.zeros(0, np.int64), q))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, exact_q = shared.value
            q = exact_q.astype(np.float32)
            held: list[tuple[np.ndarray, np.ndarray]] = []

            def search() -> Iterator[pa.RecordBatch]:
                ids, first = np.unique(np.concatenate([h[0] for h in held]), return_index=True)
                exact_x = np.concatenate([h[1] for h in held])[first]
                x = exact_x.astype(np.float32)
                if not len(x) or not len(q):
                    return
                _, r = search_index(q, q @ wide, x, x @ wide, k + 1, chi)
                c = np.stack([(exact_q * exact_x[r[:, j]]).sum(axis=1) for j in range(k + 1)], axis=1)
                who, other = np.repeat(names, k + 1), np.where(r.ravel() >= 0, ids[r.ravel()], -1)
                ok = (r.ravel() >= 0) & (who != other)
                yield pa.RecordBatch.from_arrays([pa.array(who[ok]), pa.array(other[ok]), pa.array(c.ravel()[ok])], ["query_id", "neighbour_id", "cosine"])

            for b in batches:
                rows, x = _dense(b.column(1), dim, np.float64)
                held.append((b.column(0).to_numpy()[rows], x))
                if sum(len(h[0]) for h in held) >= INDEX_BLOCK:
                    yield from search()
                    held = []
            if held:
                yield from search()

        part = base.mapInArrow(run, "query_id long, neighbour_id long, cosine double")
        w = Window.partitionBy("query_id").orderBy(F.round("cosine", 9).desc(), "neighbour_id")  # copies differ by rounding
        once = part.groupBy("query_id", "neighbour_id").agg(F.max("cosine").alias("cosine"))
        part = cut(once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))
        found = part if found is None else found.unionByName(part)
    return found
