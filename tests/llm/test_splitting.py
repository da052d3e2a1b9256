import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm.splitting import cut_points, split_long_texts


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n\r\f\té😀", max_size=900), st.sampled_from([(50, 10), (80, 0), (30, 5), (200, 60)]))
def test_pieces_fit_and_join(text, sizes):
    limit, overlap = sizes
    got = cut_points(text, limit, overlap)
    assert "".join(text[f:e] for _, f, e, _ in got) == text
    assert all(e - b <= limit and b <= f for b, f, e, _ in got)
    assert len(got) == 1 or all(f < e for _, f, e, _ in got)
    assert got[0][0] == got[0][1] == 0


def test_boundaries_and_overlap():
    para = ("word " * 180).strip() + ".\n\n"
    text = para * 20
    got = cut_points(text)
    assert len(got) == -(-(len(text) - 200) // 5800)
    assert {k for *_, k in got[:-1]} == {"paragraph"}
    assert all(150 <= f - b <= 250 for b, f, _, _ in got[1:])
    assert all(text[b - 1].isspace() for b, f, _, _ in got[1:])
    words = "word " * 4000
    assert all(k == "word" for *_, k in cut_points(words)[:-1])
    sentences = "A word here. " * 1500
    assert all(k == "sentence" for *_, k in cut_points(sentences)[:-1])
    lengths = [e - f for _, f, e, _ in cut_points(words)]
    assert max(lengths) - min(lengths) < 400  # balanced
    assert [k for *_, k in cut_points("x" * 13000)] == ["none", "none", "end"]


def test_limits():
    assert len(cut_points("x" * 6000)) == 1 and len(cut_points("x" * 6001)) == 2 and cut_points("") == [(0, 0, 0, "end")]
    with pytest.raises(ValueError):
        cut_points("x", 10, 10)


@settings(max_examples=250, deadline=None)
@given(st.text(alphabet="ab .\n", min_size=1, max_size=200), st.integers(1, 50), st.data())
def test_every_overlap_below_the_limit_ends(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    got = cut_points(text * 3, limit, overlap)
    assert "".join((text * 3)[f:e] for _, f, e, _ in got) == text * 3
    assert all(0 < e - b <= limit and f < e for b, f, e, _ in got)


@pytest.mark.parametrize("limit, overlap", [(100, 85), (100, 90), (100, 79), (100, 99), (10, 9), (6000, 5999)])
def test_large_overlaps_end(limit, overlap):
    got = cut_points("word " * 2000, limit, overlap)
    assert all(e - b <= limit and f < e for b, f, e, _ in got) and got[-1][2] == 10_000


def test_frame(spark):
    long = "é" * 6001
    rows = [(1, long, None, 5, "f"), (1, long, None, 5, "f"), (2, "x" * 6000, "", 5, "f"), (None, "a b " * 5000, "c", 5, "f"), (3, "z" * 3_000_000, None, 5, "f")]
    df = spark.createDataFrame(rows, "pair_id long, a string, b string, piece int, field string")
    got = split_long_texts(df, "pair_id", ["a", "b"]).collect()
    by = {}
    for r in got:
        by.setdefault((r["pair_id"], r["field"]), []).append(r)
    assert len(by[1, "a"]) == 4 and {r["n_pieces"] for r in by[1, "a"]} == {2}
    assert [r["text"] for r in by[2, "b"]] == [""] and len(by[2, "a"]) == 1 and (1, "b") not in by
    for key, text in (((None, "a"), "a b " * 5000), ((3, "a"), "z" * 3_000_000)):
        pieces = sorted(by[key], key=lambda r: r["piece"])
        assert "".join(r["text"][r["fresh"] - r["begin"] :] for r in pieces) == text and all(len(r["text"]) <= 6000 for r in pieces)
    assert {r["piece"] > 0 or r["n_pieces"] > 1 for r in split_long_texts(df, "pair_id", ["a"], only_long=True).collect()} == {True}
    assert split_long_texts(df.limit(0), "pair_id", ["a", "b"]).count() == 0
