"""Splitting: pieces rebuild the text, stay within the limit, share the overlap, cut where they may."""

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import split
from millrace.llm.sentences import sentence_ends

TEXT = st.lists(st.sampled_from(["One two three. ", "Is it? ", "approx. 3.5 mg, ", "word ", "\n\n", "没有。", "\r\n \r\n", "x" * 30, "😀", " "]), max_size=60).map("".join)


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(20, 80), st.integers(0, 15))
def test_round_trip(text, limit, overlap):
    pieces = split.pieces_of(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, b, _), (c, d, _) in zip(pieces, pieces[1:]):
        assert c == b - overlap and d > b
    assert all(b - a <= limit for a, b, _ in pieces)
    rebuilt = text[: pieces[0][1]] + "".join(text[p[1] : q[1]] for p, q in zip(pieces, pieces[1:]))
    assert rebuilt == text


def test_sentence_ends():
    text = 'Seen by Dr. Smith at 37.5 degrees, approx. two days. "Well?" Yes! 好。再见。'
    parts = [text[a:b].strip() for a, b in zip([0, *sentence_ends(text)], sentence_ends(text))]
    assert parts == ["Seen by Dr. Smith at 37.5 degrees, approx. two days.", '"Well?"', "Yes!", "好。", "再见。"]


def test_boundary():
    assert split.boundary_of("a" * 30 + "\n\n" + "b" * 30, 40) == "paragraph"
    assert split.boundary_of("It is so. " * 8, 40) == "sentence"
    assert split.boundary_of("no end here vs. there " * 8, 40) == "none"
    assert split.pieces_of("a" * 30 + "\n\n" + "b. " * 10, 40, 5)[0][1:] == (32, "paragraph")


def test_frame_edges(spark):
    rows = [(1, "x" * 10, None, "own"), (2, "y" * 11, "", "own"), (2, "y" * 11, "", "own"), (3, None, "z" * 25, "own")]
    df = spark.createDataFrame(rows, "sample_id long, a string, b string, boundary string")
    got = split.split_oversized(df, ["sample_id"], ["a", "b"], limit=10, overlap=2)
    assert sorted((r.sample_id, r.field, r.n_chars, r.boundary) for r in got.collect()) == [(2, "a", 11, "none"), (2, "a", 11, "none"), (3, "b", 25, "none")]
    assert [len(r.text) for r in split.explode_pieces(got.filter("sample_id = 3"), ["sample_id"]).orderBy("piece").collect()] == [10, 10, 9]
    assert split.split_oversized(df.limit(0), ["sample_id"], ["a"], 10, 2).count() == 0
