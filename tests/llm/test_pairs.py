"""Operators on pairs and spans against brute force."""

import random
import re

import numpy as np

from tidemark.llm import near_duplicates, neighbours, shared_spans
from tidemark.llm.fm_index import FMIndex, shared_ranges, suffix_order


def unit(x):
    return x / np.linalg.norm(x)


def brute_pairs(rows, k, least):
    best = {}
    for i, v in rows:
        if i is None or v is None or len(v) != 8 or any(x is None or x != x for x in v) or not any(v):
            continue
        best[i] = unit(np.array(v))
    ids = sorted(best)
    out = set()
    for i in ids:
        near = sorted(((-round(float(best[i] @ best[j]), 6), j) for j in ids if j != i))[:k]
        out |= {(min(i, j), max(i, j)) for c, j in near if -c >= least}
    return out


def test_neighbours_with_dirty_vectors_and_copies(spark):
    r = np.random.default_rng(4)
    rows = []
    for i in range(300):
        base = unit(r.standard_normal(8))
        rows.append((i, base.tolist()))
        if i % 3 == 0:
            rows.append((1000 + i, unit(base + 0.05 * r.standard_normal(8)).tolist()))
    hot = unit(r.standard_normal(8)).tolist()
    rows += [(5000 + i, hot) for i in range(150)]
    rows += [rows[0], rows[0], (9000, None), (9001, []), (9002, [0.0] * 8), (9003, [float("nan")] * 8), (9004, [None] * 8), (9005, [1.0] * 7), (None, hot)]
    df = spark.createDataFrame([(i, v, 1, "x", 2.0) for i, v in rows], "id int, e array<double>, h int, cell string, x double")
    got = {(p.a, p.b) for p in neighbours.similar_pairs(df, "id", "e", dim=8, m=4, min_cosine=0.9).collect()}
    want = brute_pairs(rows, 5, 0.9)
    assert not {p for p in got - want if p[0] < 5000}  # among copies other rounding may order equal ones otherwise
    assert len(got & want) / len(want) >= 0.95
    copies = {p for p in got if p[0] >= 5000}
    assert {x for p in copies for x in p} == {5000 + i for i in range(150)} and len(copies) < 150 * 5
    empty = neighbours.similar_pairs(df.limit(0), "id", "e", dim=8, m=4)
    assert empty.columns == ["a", "b", "cosine"] and empty.count() == 0


def test_most_similar_of_stated_queries(spark):
    r = np.random.default_rng(6)
    x = r.standard_normal((1200, 16)) + 2 * r.standard_normal((30, 16))[r.integers(0, 30, 1200)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, x[0].tolist()) for i in range(3)]
    df = spark.createDataFrame([(*v, 1) for v in [*rows, rows[3], rows[3], (9000, None), (9001, [0.0] * 16), (9002, [1.0]), (None, rows[0][1])]], "id int, e array<double>, rank int")
    got = neighbours.most_similar(df, df.where("id % 20 = 0"), "id", "e", k=5, dim=16).collect()
    v = np.array([v for _, v in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = np.array([i for i, _ in rows])
    hit = total = 0
    for a in np.flatnonzero(ids % 20 == 0):
        mine = [g.neighbour_id for g in sorted((g for g in got if g.query_id == ids[a]), key=lambda g: g.rank)]
        best = [j for j in np.lexsort((ids, -np.round(v[a] @ v.T, 6))) if j != a][:5]
        assert len(mine) == 5 == len(set(mine)) and ids[a] not in mine
        hit, total = hit + len(set(mine) & set(ids[best].tolist())), total + 5
    assert hit / total >= 0.9 and {g.query_id for g in got} == set(ids[ids % 20 == 0].tolist())
    assert neighbours.most_similar(df.limit(0), df, "id", "e", dim=16).count() == 0 == neighbours.most_similar(df, df.limit(0), "id", "e", dim=16).count()


def test_chi_square_quantile():
    assert abs(neighbours.chi_square_quantile(0.95, 8) - 15.5073) < 1e-3
    assert abs(neighbours.chi_square_quantile(0.5, 2) - 1.38629) < 1e-4


def test_search_stops_without_losing_near_vectors():
    r = np.random.default_rng(9)
    x = r.standard_normal((1500, 16)).astype(np.float32)
    x[::2] = x[1::2] + 0.03 * r.standard_normal((750, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    p = x @ neighbours.projections(16, 6, 1)
    a, b, c = neighbours.search_cell(x, p, 3, 0.9, neighbours.chi_square_quantile(0.98, 6))
    s = x @ x.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i])[:3] if s[i, j] >= 0.9}
    got = set(zip(a.tolist(), b.tolist()))
    assert len(got & want) / len(want) > 0.97 and not got - {(i, int(j)) for i, j in zip(*np.nonzero(s >= 0.9))}


def recall_of_pairs(spark, x):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, e array<double>")
    got = {(p.a, p.b) for p in neighbours.similar_pairs(df, "id", "e", dim=x.shape[1]).collect()}
    s = x @ x.T
    np.fill_diagonal(s, -2)
    want = {(min(i, int(j)), max(i, int(j))) for i in range(len(x)) for j in np.argsort(-s[i])[:5] if s[i, j] >= 0.9}
    return len(got & want) / len(want)


def test_neighbours_across_cells_of_a_crowd(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 64)
    r = np.random.default_rng(11)
    x = r.standard_normal((2400, 64))
    x[:800] = unit(r.standard_normal(64)) + 0.03 * r.standard_normal((800, 64))
    x[800:1200] = x[1200:1600] + 0.4 * r.standard_normal((400, 64))
    recall = recall_of_pairs(spark, x / np.linalg.norm(x, axis=1, keepdims=True))
    assert recall > 0.98, recall


def test_neighbours_closer_together_than_eight_bits_tell(spark):
    r = np.random.default_rng(12)
    x = unit(r.standard_normal(64)) + 0.001 * r.standard_normal((700, 64))
    recall = recall_of_pairs(spark, x / np.linalg.norm(x, axis=1, keepdims=True))
    assert recall > 0.99, recall


def edited(words, r, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = r.choice("alpha beta gamma delta".split())
    return " ".join(words)


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(120):
        words = [r.choice(vocabulary) for _ in range(60)]
        rows.append((i, " ".join(words)))
        if i % 4 == 0:
            rows += [(1000 + i, edited(words, r, 2)), (2000 + i, edited(words, r, 5))]
    notice = [r.choice(vocabulary) for _ in range(80)]
    rows += [(5000 + i, edited(notice, r, 1)) for i in range(60)]  # a hot group of different texts
    rows += [(7000 + i, rows[0][1].upper()) for i in range(40)]  # and one of copies
    rows += [(8000, None), (8001, ""), (8002, "one two"), (8003, "   "), rows[1], (None, rows[0][1]), (8004, "x y z"), (8005, "X, y; z!")]
    df = spark.createDataFrame([(i, t, "a", 1, 2) for i, t in rows], "doc_id long, text string, rep string, n int, unit int")
    old, near_duplicates.TILE = near_duplicates.TILE, 16
    try:
        links, members = near_duplicates.near_duplicates(df, threshold=0.6, width=3)
        got = {tuple(x) for x in near_duplicates.expand(links, members).collect()}
    finally:
        near_duplicates.TILE = old
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if i is not None and len(w) > 2:
            sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    ids = sorted(sets)
    want = {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    assert len(want - got) <= 0.002 * len(want) and not got - want and (8004, 8005) in got
    groups = {r.id: r for r in near_duplicates.classes(links, members).collect()}
    assert len(groups) == len(sets) and groups[7005].class_id == groups[0].class_id == 0 and groups[0].copies == 41
    assert len({groups[5000 + i].class_id for i in range(60)}) == 1
    links, members = near_duplicates.near_duplicates(df.limit(0))
    assert near_duplicates.expand(links, members).count() == 0 and near_duplicates.classes(links, members).count() == 0


def test_tiles_skip_nothing_within_the_radius():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 1 << 40, n).astype(np.uint64)) for n in r.integers(5, 400, 300)]
    sets += [s[: max(1, int(len(s) * 0.8))] for s in sets[:100]]
    bits = np.stack([near_duplicates.bitmap(s) for s in sets])
    n = np.array([len(s) for s in sets])
    rows = np.arange(len(sets))
    got = {tuple(p) for p in near_duplicates.compare_tiles(rows, n, bits, rows, rows, 0.7).tolist()}
    assert {(i, 300 + i) for i in range(100) if len(sets[300 + i]) / n[i] >= 0.7} <= got


def test_suffix_order_and_shared_ranges():
    r = np.random.default_rng(0)
    for _ in range(60):
        s = r.integers(0, r.integers(1, 5) + 1, r.integers(1, 60))
        assert suffix_order(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    for _ in range(60):
        texts = [r.integers(5, 8, r.integers(1, 40)).astype(np.uint32) for _ in range(r.integers(1, 6))]
        owner, many, least = r.integers(0, 3, len(texts)), r.random(len(texts)) < 0.1, int(r.integers(1, 8))
        found = shared_ranges(FMIndex(texts, owner, many), least, int(r.integers(1, 50)))
        for i, t in enumerate(texts):
            want, got = np.zeros(len(t), bool), np.zeros(len(t), bool)
            for a in range(len(t) - least + 1):
                g = t[a : a + least].tolist()
                own = {(owner[j], bool(many[j])) for j, u in enumerate(texts) if any(u[b : b + least].tolist() == g for b in range(len(u) - least + 1))}
                if len({o for o, _ in own}) > 1 or any(m for _, m in own):
                    want[a : a + least] = True
            for a, b in found[i]:
                got[a:b] = True
            assert (want == got).all()


def brute_spans(rows, least):
    texts = {i: t for i, t in rows if i is not None and t}
    owner = {}
    for i, t in texts.items():
        for k in range(len(t) - least + 1):
            owner.setdefault(t[k : k + least], set()).add(i)
    out = set()
    for i, t in texts.items():
        spans = [(k, k + least) for k in range(len(t) - least + 1) if len(owner[t[k : k + least]]) > 1]
        out |= {(i, s, e) for s, e in shared_spans.merge_spans(spans)}
    return out


def test_shared_spans_equal_brute_force(spark):
    r = random.Random(2)
    make = lambda n: "".join(r.choice("абвxyz 🙂.") for _ in range(n))
    quote, notice = make(90), make(45)
    rows = [(i, make(150) + (quote[r.randrange(40) :] if i % 3 == 0 else "") + make(60) + (notice if i % 2 else "")) for i in range(40)]
    rows += [(100 + i, rows[0][1]) for i in range(20)]
    rows += [(200, None), (201, ""), (202, "short"), (203, "a" * 3000), (204, "a" * 50 + make(40)), rows[0], (None, quote), (205, make(60) * 2)]
    df = spark.createDataFrame([(i, t, 1, "g") for i, t in rows], "doc_id long, text string, mark int, grp string")
    want = brute_spans(rows, 40)
    assert {tuple(x) for x in shared_spans.shared_spans(df, least=40).collect()} == want
    for shard in (400, 50):  # groups too large for a shard, cut finer once and twice
        assert {tuple(x) for x in shared_spans.shared_spans(df, least=40, shard=shard).collect()} == want
    long = [(i, t) for i, t in rows if i is not None and t]
    windows = shared_spans.Windows(40)
    whole = {i: windows.runs(t) for i, t in long}
    old, shared_spans.SLICE = shared_spans.SLICE, 50
    try:
        for i, t in long:  # slices cover each window once, with the mark it has in the whole
            mark, first, last = windows.runs(t)
            at = {w: m for m, a, b in zip(mark.tolist(), first.tolist(), last.tolist()) for w in range(a, b + 1)}
            assert at == {w: m for m, a, b in zip(*(z.tolist() for z in whole[i])) for w in range(a, b + 1)} and len(at) == max(0, len(t) - 39)
    finally:
        shared_spans.SLICE = old
    part = {x.doc_id: x for x in shared_spans.shared_part(df.where("doc_id is not null"), least=40).collect()}
    assert part[200].shared_chars == 0 and part[101].shared == 1.0 and part[203].shared_chars == 3000
    assert shared_spans.shared_spans(df.limit(0), least=40).count() == 0


def test_trees_go_deeper_than_their_sample():
    r = np.random.default_rng(3)
    tree = neighbours.Tree(r.standard_normal((64, 4)).astype(np.float32), 6)
    assert (tree.base, tree.depth) == (3, 6)
    x = r.standard_normal((4000, 4)).astype(np.float32)
    cells = tree.route(x)
    assert cells.min() >= 0 and cells.max() < 64 and len(np.unique(cells)) > 40
    row, cell = tree.within(x, np.zeros(len(x)))
    assert (cell[np.argsort(row)] == cells).all()
    row, cell = tree.within(x[:9], np.full(9, np.inf))
    assert sorted(zip(row.tolist(), cell.tolist())) == [(i, c) for i in range(9) for c in range(64)]
    near = 0.97 * x + (1 - 0.97**2) ** 0.5 * r.standard_normal(x.shape).astype(np.float32)
    p = tree.stays(x, np.full(len(x), 0.97))
    assert abs(p.mean() - (tree.route(near) == cells).mean()) < 0.08
    reach = tree.reach(x, np.full(len(x), 0.97), 0.8, r)
    assert (tree.gaps(x, near) <= reach).mean() > 0.75
    assert neighbours.trees_needed(0, 0.9, 0.98) == 1 and neighbours.trees_needed(7, 0.9, 0.98) == 10 < neighbours.trees_needed(12, 0.9, 0.98)
