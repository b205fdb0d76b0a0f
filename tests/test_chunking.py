import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.operators.chunking import MarkdownChunker, check_chunks, chunk_documents, explode_chunks, snap, stride, targets
from tidemark.operators.markdown import Heading, blocks


def spans(text, *a, **k):
    return [x[:2] for x in MarkdownChunker(*a, **k).cut(text)]


def test_strides_and_words():
    assert spans("abcdefghij" * 3, 10, 0.5, max_snap_distance=0) == [(0, 10), (5, 15), (10, 20), (15, 25), (20, 30)]
    t = "aaaaa bbbbb ccccc"
    assert spans(t, 5, 0, max_snap_distance=2)[1] == (6, 12) and t[6:12] == "bbbbb "
    assert spans(t, 5, 0, max_snap_distance=0)[1] == (5, 10)
    assert MarkdownChunker(6, 0, max_snap_distance=1).cut("aaaa\r    bbbb")[0][:2] == (0, 5)
    assert spans("") == [(0, 0)] and spans("short") == [(0, 5)]
    assert stride(5, 0.5) == 2 and stride(3, 0.5) == 2 and stride(10, 1.0) == 1
    with pytest.raises(ValueError):
        stride(0, 0.5)


def test_segments_at_headings():
    t = "# One\n\ntext of one\n\n## Two\n\ntext of two\n"
    cut = MarkdownChunker(1000, 0.5, segment_by_heading_levels=(2,)).cut(t)
    assert [x[:2] for x in cut] == [(0, 20), (20, len(t))] and cut[1][2] == "# One" and cut[0][2] is None
    assert targets(100, 40, 0.5, [30]).tolist() == [[0, 30], [30, 70], [50, 90], [60, 100]]


def test_heading_context():
    t = "# A\n\n" + "x " * 30 + "\n\n## B\n\n" + "y " * 30 + "\n\n# C\n\n" + "z " * 30
    cut = MarkdownChunker(30, 0, max_snap_distance=5).cut(t)
    at = {s: c for s, _, c in cut}
    assert at[min(s for s in at if s > t.index("y y"))] == "# A\n## B"
    assert all(c == "# C" for s, c in at.items() if s > t.index("# C") + 3)
    assert at.get(t.index("# C"), None) is None


@pytest.mark.parametrize(
    "text, headings",
    [
        ("Title\n=====\n\nSub\n---\n", [Heading(0, 1, "Title\n====="), Heading(13, 2, "Sub\n---")]),
        ("```\n# Not a heading\n```\n# Is", [Heading(24, 1, "# Is")]),
        ("~~~\n# no\n```\n# no\n~~~~\n## yes", [Heading(23, 2, "## yes")]),
        ("#no\n####### no\n    # code\n  ### yes ###", [Heading(28, 3, "### yes ###")]),
        ("> # quoted\n- # item\n1. ## two", [Heading(2, 1, "# quoted"), Heading(13, 1, "# item"), Heading(23, 2, "## two")]),
        ("text\n\n---\n\n***\n", []),
        ("a\r# b\r\n# c", [Heading(2, 1, "# b"), Heading(7, 1, "# c")]),
    ],
)
def test_headings(text, headings):
    assert blocks(text)[0] == headings


def test_paragraphs():
    t = "first\nstill first\n\nsecond\n\n- item\n\n  in item\n\n> quote\n\n    code\n\n# head\nthird\n<div>\nhtml\n</div>\n"
    assert [t[p : p + 5] for p in blocks(t)[1]] == ["first", "secon", "item\n", "in it", "quote", "third"]


def test_snap_prefers_kinds_then_left():
    import numpy as np

    assert snap(np.array([0, 10, 20, 30]), [[12], [9, 11, 19, 21]], 2, (0, 30)).tolist() == [0, 12, 19, 30]


@given(st.text(alphabet="ab .!\n#-\r>`", max_size=400), st.integers(5, 60), st.sampled_from([0.0, 0.3, 0.5]), st.integers(0, 20))
@settings(max_examples=300, deadline=None)
def test_chunks_cover_the_text(text, size, overlap, within):
    cut = spans(text, size, overlap, max_snap_distance=within)
    assert cut[0][0] == 0 and cut[-1][1] == len(text) and cut == sorted(cut)
    assert all(s < e or not text for s, e in cut) and len({s for s, _ in cut}) == len(cut) == len({e for _, e in cut})
    if within < size * (1 - overlap) / 2:
        assert all(b[0] <= a[1] for a, b in zip(cut, cut[1:]))


def test_columns(spark):
    rows = [("a", "# T\n\nbody text", 1), ("b", None, 2), ("c", "", 3)]
    out = chunk_documents(spark.createDataFrame(rows, "origin string, content string, chunks_n int"))
    assert out.columns == ["origin", "content", "chunks_n", "chunks"]
    flat = {(r.origin, r.start_index, r.end_index, r.text) for r in explode_chunks(out).collect()}
    assert flat == {("a", 0, 14, "# T\n\nbody text"), ("c", 0, 0, "")}


def test_check_chunks(spark):
    docs = spark.createDataFrame([("a", "alphabeta")], "origin string, text string")
    rows = [("a", 5, 9, "beta"), ("a", 0, 5, "wrong"), ("a", 4, 20, None), ("x", 0, 1, None), (None, 0, 1, None)]
    got = {(r.origin, r.problem) for r in check_chunks(spark.createDataFrame(rows, "origin string, start_index int, end_index int, text string"), docs).collect()}
    assert got == {("a", "text"), ("a", "span"), ("x", "document"), (None, "origin")}
