"""Operators on single texts, and on a source's texts."""

import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import boilerplate, mixing, page_lines, ranking, site_lines, splitting, tokens

PAGE = """Home > Docs > Parser
Skip to main content
* Pricing
* Blog

# The parser

Last updated 3 days ago by Ann Lee

The parser reads each token and keeps the longest match that the grammar allows at that place.

```
Home | Blog | Pricing
```

Related:
- Wide lexer notes
- Small table guide

Most errors come from a missing bracket, which the parser reports with the line and column of the opening one.

* [A guide](/guide): what to read next when the parser stops at a token it cannot place.

© 2021 The parser collective. All rights reserved.
"""


def made_sites(seed, sites=14, pages=12):
    """Rows (doc_id, source, text) and the furniture lines of sites in a made-up language, each with wording of its own."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(r.randint(1, 3)))
    nouns = [word() for _ in range(300)]
    some = lambda a, b: " ".join(r.choice(nouns) for _ in range(r.randint(a, b)))
    places = [word() for _ in range(14)]
    asks = [word() for _ in range(5)]
    rows, truth = [], set()
    for site in range(sites):
        brand, by, foot = word().title(), f"{asks[0].title()} {asks[1]}", f"{asks[2].title()} {word()} {asks[3]}"
        menu = r.sample(places, 5)
        for k in range(pages):
            out = []
            add = lambda t, f: out.append((t, f))
            style = site % 3
            if style == 0:
                add(" | ".join(menu), True)
            else:
                for m in menu:
                    add(f"* {m.title()}" if style == 1 else f"* [{m}](/{m})", True)
            add("", False)
            add(f"{places[0].title()} > {r.choice(nouns)} > {some(2, 3)}", True)
            add("", False)
            add(f"# {some(3, 4).title()}", False)
            add("", False)
            add(f"{by} {word()} {word()}", True)
            for _ in range(r.randint(3, 6)):
                add("", False)
                add(". ".join(some(7, 14).capitalize() for _ in range(r.randint(1, 3))) + ".", False)
                if r.random() < 0.2:
                    add("", False), add(f"## {some(2, 3)}", False)
                if r.random() < 0.2:
                    add("", False)
                    for _ in range(3):
                        add(f"- {some(6, 9).capitalize()}.", False)
            add("", False)
            add(f"{asks[4].title()}:", True)
            for _ in range(3):
                add(f"- {some(3, 4)}", True)
            add("", False)
            add(f"{foot} {brand}", True)
            i = 1000 * seed + 100 * site + k
            rows.append((i, f"site{seed}-{site}", "\n".join(t for t, _ in out)))
            truth |= {(i, n) for n, (t, f) in enumerate(out) if f and t}
    return rows, truth


@pytest.fixture(scope="module")
def weights():
    pages = [PAGE.replace("parser", w) for w in ("parser", "lexer", "linker", "reader", "writer", "binder")]
    often = {page_lines.key(x) for x in PAGE.split("\n") if x.startswith(("Skip", "Related", "Last"))}
    return boilerplate.fit(pages, often, least=3)


def test_boilerplate_of_sites_in_a_made_up_language(spark):
    rows, truth = made_sites(1)
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    w = boilerplate._weights(df, "text", "source", 1000)
    for given, true in ((rows, truth), made_sites(2, sites=4)):
        got = {(i, k) for i, _, t in given for k in boilerplate.label_page(t, w.tolist())}
        right = len(got & true)
        if given is rows:
            assert right / len(got) > 0.97 and right / len(true) > 0.97, (right / len(got), right / len(true))
        else:  # other words altogether, so structure and place alone
            assert right / len(got) > 0.8 and right / len(true) > 0.8, (right / len(got), right / len(true))


def test_counts_of_lines_cover_all_texts(spark):
    rows = [(i, "A " if i % 2 else "a", f"Same  line {i}\nown words {chr(97 + i)}\nshared") for i in range(5)] + [(10 + i, f"s{i}", "across") for i in range(5)]
    rows += [(20 + i, "b", "a page fetched again") for i in range(9)] + [(40 + i, None, f"of no source\n{i} {chr(97 + i)}") for i in range(9)] + [(60, "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    keys = ["same line 0", "own words a", "shared", "across", "a page fetched again", "of no source"]
    assert boilerplate.repeated_keys(df, "text", "source", keys) == {"same line 0", "shared", "across"}
    assert boilerplate.repeated_keys(df.drop("source"), "text", None, keys) == set()


def test_a_line_over_a_list_decides_for_its_items():
    page = page_lines.Page("Some words that go before.\n\nMore:\n- one two three\n- four five six\n\n- an item of another list")
    w = [0.0] * page_lines.SIZE
    costs, edges = boilerplate.graph(page, w)
    assert [(a, b) for a, b, c in edges if c == boilerplate.HEAD] == [(1, 2), (1, 3)]
    assert boilerplate.minimum_cut([-5, 6 * 3, -3, -3, -3], edges) == [True, False, False, False, True]


def test_boilerplate_on_a_page(weights):
    lines = PAGE.split("\n")
    dropped = {lines[k] for k in boilerplate.label_page(PAGE, weights.tolist())}
    assert {"Skip to main content", "* Pricing", "* Blog", "Related:", "- Wide lexer notes", "- Small table guide"} <= dropped
    assert not dropped & {"# The parser", "```", "Home | Blog | Pricing"} and not any(x.startswith(("The parser reads", "Most errors", "* [A guide]")) for x in dropped)


def test_boilerplate_tables(spark, weights):
    rows = [(1, PAGE, 5), (1, PAGE, 5), (2, None, 5), (3, "", 5), (4, " \n\t", 5), (5, "x" * 300_000, 5), (None, "* Blog\n* Pricing", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, line_no int")
    got = [tuple(r) for r in boilerplate.furniture_lines(df, weights=weights).collect()]
    assert {1, None} <= {i for i, _ in got} <= {1, 5, None} and len([1 for i, _ in got if i == 1]) == 2 * len({k for i, k in got if i == 1})
    body = boilerplate.main_body(df, weights=weights).collect()
    assert len(body) == len(rows) and {r.text for r in body if r.doc_id == 2} == {None} and {r.text for r in body if r.doc_id == 3} == {""}
    assert boilerplate.furniture_lines(df.limit(0)).count() == 0


@given(st.lists(st.floats(-3, 3), min_size=1, max_size=7), st.data())
@settings(max_examples=150, deadline=None)
def test_minimum_cut_is_minimal(cost, data):
    n = len(cost)
    edges = [(i, j, data.draw(st.floats(0, 2))) for i in range(n) for j in range(i + 1, n) if data.draw(st.booleans())]

    def energy(kept):
        return sum(c if k else 0 for c, k in zip(cost, kept)) + sum(w for a, b, w in edges if kept[a] != kept[b])

    best = min(energy([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
    assert math.isclose(energy(boilerplate.minimum_cut(cost, edges)), best, abs_tol=1e-6)


def test_repeated_lines(spark):
    line = "All rights reserved by desk {} of this site"
    rows = [(i, " Site.Example ", f"text {chr(97 + i) * 3} of its own, long enough\n{line.format(i)}\r\n\n{line.format(i)}", "2024-01-01 00:00:00") for i in range(12)]
    rows += [(50 + i, "other", "short\n" + "the same long line of the others" + "\n" * 3, None) for i in range(9)]
    rows += [(100 + i, "copies", "an article of more than twenty characters", "2024-01-01 00:00:00") for i in range(15)]
    rows += [(70, None, line.format(1), None), (71, "site.example", None, None), (72, "site.example", "", None), (73, "  ", line.format(2), None), rows[0]]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, fetched_at string, key int").selectExpr("doc_id", "source", "text", "key", "1 as src", "to_timestamp(fetched_at) as fetched_at")
    got = site_lines.repeated_occurrences(df).collect()
    assert {(r.doc_id, r.line_no) for r in got if r.doc_id < 50} == {(i, n) for i in range(12) for n in (1, 3)}
    assert {r.documents for r in got if r.doc_id < 50} == {12} and {r.clusters for r in got if r.doc_id >= 100} == {1}
    assert not [r for r in got if 50 <= r.doc_id < 100]
    assert not site_lines.repeated_occurrences(df, min_clusters=2).where("doc_id >= 100").count()
    clean = {r.doc_id: r.text for r in site_lines.remove_repeated(df).collect()}
    assert clean[3] == "text ddd of its own, long enough\n" and clean[71] is None and clean[72] == "" and clean[100] == ""
    assert site_lines.repeated_occurrences(df.limit(0)).count() == 0


@pytest.mark.parametrize("bucket_rows", [10_000, 1])
def test_one_ranking(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(ranking, "BUCKET_ROWS", bucket_rows)
    nan = float("nan")
    rows = [
        (1, 10, [("BM25", 900.0), (" Cosine-Distance ", 0.1)]), (1, 11, [("bm25", 1.0), ("cosine_distance", 0.2), ("cosine_distance", 0.05)]),
        (1, 12, [("bm25", None), (None, 1.0), ("cosine_distance", nan)]), (1, 13, None), (1, 10, [("bm25", 2.0)]), (1, 14, []),
        (2, 1, [("bm25", 5.0)]), (2, 2, [("bm25", 5.0)]), (None, 1, [("bm25", 1.0)]), (3, None, [("bm25", 1.0)]), (4, 7, [("bm25", float("inf")), ("x", 1e-320)]),
    ]
    df = spark.createDataFrame([(*r, "n") for r in rows], "query_id long, chunk_id int, metrics array<struct<name string, value double>>, name string")
    for influence in ("component", "equal"):
        got = {(r.query_id, r.chunk_id): r.place for r in ranking.fuse(df, influence=influence).collect()}
        assert {(r.query_id, r.chunk_id, r.place) for r in ranking.top(df, 2, influence=influence).collect()} == {(*k, p) for k, p in got.items() if p <= 2}
        assert set(got) == {(1, 10), (1, 11), (1, 12), (1, 13), (1, 14), (2, 1), (2, 2), (4, 7)}
        assert {got[1, 10], got[1, 11]} == {1, 2} and (got[1, 12], got[1, 13], got[1, 14]) == (3, 4, 5) and (got[2, 1], got[2, 2]) == (1, 2)
    assert ranking.fuse(df.limit(0)).count() == 0


def test_first_component_points_in_declared_directions(spark):
    r = random.Random(1)
    rows = []
    for q in range(30):
        for c in range(8):
            x = r.random()
            rows.append((q, c, [("bm25", 1000 * x + r.random()), ("cosine_distance", 1 - x + 0.01 * r.random()), ("similarity", x + 0.01 * r.random())]))
    df = spark.createDataFrame(rows, "query_id long, chunk_id int, metrics array<struct<name string, value double>>")
    names = ["bm25", "cosine_distance", "similarity"]
    weights = ranking.loadings(ranking.rank_scores(df, names), names)
    assert all(0.5 < w < 0.65 for w in weights.values()) and len(weights) == 3


def test_splitting(spark):
    r = random.Random(8)
    texts = ["word " * 900, "x" * 5000, ("Sentence one is here. " * 30 + "\n\n") * 6, "。".join("字" * 90 for _ in range(40)), "🙂" * 1700, "a\r\n" * 900, "short", "", None, "y" * 1600, "z" * 1600 + " z", "q" * 1601]
    texts += ["".join(r.choice("ab \n.?") for _ in range(r.randrange(1500, 9000))) for _ in range(30)] + ["word " * 200_000]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, p int, n int")
    for overlap in (0, 200):
        by = {}
        for p in splitting.split_oversized(df, overlap=overlap).collect():
            by.setdefault(p.doc_id, []).append(p)
        assert set(by) == {i for i, t in enumerate(texts) if t and len(t) > 1600}
        for i, pieces in by.items():
            pieces.sort(key=lambda p: p.piece_no)
            assert pieces[0].start_index == 0 and pieces[-1].end_index == len(texts[i])
            assert all(0 < p.end_index - p.start_index <= 1600 for p in pieces)
            for a, b in zip(pieces, pieces[1:]):
                assert a.start_index < b.start_index <= a.end_index < b.end_index and a.end_index - b.start_index <= overlap
    found = {tuple(x) for x in splitting.found(df).collect()}
    want = {(i, "over") for i, t in enumerate(texts) if t and len(t) > 1600} | {(i, "forced") for i, t in enumerate(texts) if t and re.search(r"[^\s.!?。！？…]{1601,}", t)}
    assert found == want
    assert splitting.split_oversized(df.limit(0)).count() == 0


TEXTS = [None, "", " ", "\n\n  x", "It's 12345 o'clock!!  \t end ", "naïve façade 日本語 🙂👩‍👩‍👧", "<|endoftext|>", "a" * 20_000, "\x00\x01 é", "foo_bar(baz=1);", "Ünïcødé ١٢٣", "  x"]


def test_token_ids_equal_the_public_library(spark):
    from tokenizers import Tokenizer

    public = Tokenizer.from_file(f"{tokens.FOLDER}/byte_bpe_50k.json")
    public.encode_special_tokens = True
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids array<int>")
    coded = tokens.encode_corpus(df)
    got = {r.doc_id: list(r.ids) for r in coded.collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == public.encode(t or "", add_special_tokens=False).ids
    back = {r.doc_id: r.text for r in tokens.decode_corpus(coded).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))
    assert tokens.encode_corpus(df.limit(0)).count() == 0
    assert {r.tokens for r in tokens.count_tokens(df.where("doc_id < 2").select("doc_id", "text")).collect()} == {0}


@given(st.text(max_size=60))
@settings(max_examples=150, deadline=None)
def test_encode_round_trip(text):
    enc = tokens.encoder(f"{tokens.FOLDER}/byte_bpe_multi_50k.tiktoken")
    assert enc.decode(enc.encode(text)) == text


def test_mix(spark):
    rows = [(i, "Big ", "word " * 10, 1) for i in range(300)] + [(1000 + i, "small", "word " * 10, 1) for i in range(20)]
    rows += [(2000 + i, "mid", "word " * 10, 1) for i in range(80)] + [(3000, None, "word", 1), (3001, "big", None, 1), (3002, "big", "", 1), (3003, "unlisted", "word " * 50, 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, tokens int")
    goal = spark.createDataFrame([("big", 0.5, 1), ("SMALL", 0.3, 2), ("mid", 0.2, 4), ("gone", 0.1, 3), (None, 0.1, 1), ("mid", None, None)], "source string, target_share double, max_repeats int")
    mix, report = mixing.mix(df, goal)
    r = {x.source: x for x in report.collect()}
    total = sum(x.available_tokens for x in r.values())
    assert {x.source for x in r.values() if not x.reachable} == {"SMALL", "gone"}
    assert r["SMALL"].mixed_tokens == 2 * r["SMALL"].available_tokens and r["gone"].documents == 0
    taken = mix.collect()
    assert total * 0.98 <= sum(x.tokens for x in taken) <= total
    assert max(x.repeat for x in taken if x.source == "SMALL") == 2 and all(x.repeat == 1 for x in taken if x.source == "big")
    half = mixing.mix(df, goal.where("source in ('big', 'mid')"), budget=700)[1].collect()
    assert all(abs(x.actual_share - x.target_share / 0.7) < 0.05 for x in half if x.source in ("big", "mid"))
    empty = mixing.mix(df.limit(0), goal)
    assert empty[0].count() == 0 and {x.mixed_tokens for x in empty[1].collect()} == {0}


def test_line_features_are_sorted_and_within_size():
    for s in PAGE.split("\n"):
        if s.strip():
            own = page_lines.features(s.strip())
            assert list(own) == sorted(own) and own[-1] < page_lines.SIZE


def test_long_lines_are_judged_by_the_same_features(weights):
    menu = "  ".join(f"{a} {b}" for a in ("Blog", "Pricing", "Help", "Login", "Forum") for b in ("news", "desk", "list", "shop", "team"))
    long = "word " * 100 + "unseen"
    assert len(menu) > 200 and boilerplate.label_page(f"# Title\n\nThe parser reads each token and keeps the longest match of all.\n\n{menu}", weights.tolist()) == [4]
    assert set(page_lines.features("unseen")) & set(page_lines.features(long.strip())) - {page_lines.shape("bias")}  # the last word of a long line is a feature too


def test_sampled_pages_come_from_the_whole_table(spark):
    rows = [(f"page {i} " + "x" * (250_000 if i == 1990 else 5),) for i in range(2000)]
    got = boilerplate.sampled_pages(spark.createDataFrame(rows + rows[:1], "text string").coalesce(1), "text", 1000)
    numbers = [int(t.split()[1]) for t in got]
    assert len(set(numbers)) == 1000 and 400 < sum(n >= 1000 for n in numbers) < 600
    assert len(max(boilerplate.sampled_pages(spark.createDataFrame(rows, "text string"), "text", 3000), key=len)) > 250_000


def test_opposing_metrics_both_count(spark):
    rows = [(q, c, [("bm25", float(c)), ("cosine_similarity", -float(c))]) for q in range(20) for c in range(6)]
    df = spark.createDataFrame(rows, "query_id long, chunk_id int, metrics array<struct<name string, value double>>")
    names = ["bm25", "cosine_similarity"]
    found = {r.name: r for r in ranking.component(df).collect()}
    assert all(abs(found[n].weight - 0.5**0.5) < 1e-9 for n in names) and found["bm25"].loading * found["cosine_similarity"].loading < 0


def test_ranks_of_missing_scores(spark):
    rows = [(1, c, [("a", float(v))] if v else [("b", 1.0)] if c == 9 else []) for c, v in [(1, 3), (2, 2), (3, 2), (4, 0), (9, 0)]] + [(2, 1, None)]
    df = spark.createDataFrame(rows, "query_id long, chunk_id int, metrics array<struct<name string, value double>>")
    z = {(r.query_id, r.chunk_id): list(r.z) for r in ranking.rank_scores(df, ["a", "b"]).collect()}
    assert z == {(1, 1): [1.0, 0.5], (1, 2): [0.375, 0.5], (1, 3): [0.375, 0.5], (1, 4): [0.375, 0.5], (1, 9): [0.375, 0.5], (2, 1): [None, None]}


def test_sources_of_no_share_count_in_the_mix(spark):
    rows = [(i, s, "word " * 10) for i, s in enumerate(["big"] * 30 + ["zero"] * 20 + ["none"] * 10)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    goal = spark.createDataFrame([("big", 1.0, 1), ("zero", 0.0, 1), ("none", None, 1)], "source string, target_share double, max_repeats int")
    mix, report = mixing.mix(df, goal)
    r = {x.source: x for x in report.collect()}
    assert set(r) == {"big", "zero", "none"} and r["zero"].mixed_tokens == 0 == r["none"].mixed_tokens
    assert {x.source for x in mix.collect()} == {"big"} and not r["big"].reachable and r["zero"].reachable
    assert abs(r["big"].most_possible_share - 0.5) < 1e-9
