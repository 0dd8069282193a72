"""Problem 1: values over a size limit, cut into overlapping pieces at natural boundaries.

Method: prefix sums of token lengths give the character offset of every token; the offsets after
blank lines and after sentences form two sorted arrays. From a piece's start, binary search finds the
last boundary under the limit, blank lines before sentence ends; where neither lies in reach, the cut
falls on the last token that fits, or inside it if it is longer than a piece. The next piece starts
the overlap before the cut.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.sentences import paragraph_bounds, paragraph_ends, sentence_bounds, sentence_ends

_TOKENS = re.compile(r"\s+|[^\W_]+|[\W_]")


def _last_in(bounds: list[int], low: int, high: int) -> int:
    """The last of the sorted `bounds` in low < x <= high, or -1."""
    i = bisect_right(bounds, high) - 1
    return bounds[i] if i >= 0 and bounds[i] > low else -1


def token_offsets(text: str) -> list[int]:
    """Prefix sums of the lengths of the words, marks and white space that make up the text."""
    out, at = [], 0
    for m in _TOKENS.finditer(text):
        at += m.end() - m.start()
        out.append(at)
    return out


def boundary_of(text: str, limit: int, paragraphs: tuple[list[int], list[int]] | None = None, sentences: tuple[list[int], list[int]] | None = None) -> str:
    """`paragraph`, `sentence` or `none`: the weakest boundary at which a text without overlap must be cut to get under the limit.

    The same search as for pieces, over the places where paragraphs and sentences end without the white space
    after them: from a piece's start, the last end in reach decides, paragraphs before sentences. A piece without either is over
    the limit by itself.
    """
    paragraphs = paragraph_bounds(text) if paragraphs is None else paragraphs
    sentences = sentence_bounds(text) if sentences is None else sentences
    kind, start, end = "paragraph", 0, len(text.rstrip())
    while end - start > limit:
        cut = -1
        for (ends, begins), name in ((paragraphs, "paragraph"), (sentences, "sentence")):
            i = bisect_right(ends, start + limit) - 1
            if i >= 0 and begins[i] > start:
                cut = begins[i]
                kind = name if name == "sentence" else kind
                break
        if cut < 0:
            blank = len(text[start:]) - len(text[start:].lstrip())
            if not blank:
                return "none"
            cut = start + blank  # white space that opens the text is no part of its first sentence
        start = cut
    return kind


def pieces_of(text: str, limit: int, overlap: int, paragraphs: list[int] | None = None, ends: list[int] | None = None) -> list[tuple[int, int, str]]:
    """Pieces (start, end, cut) that cover the text; neighbours share exactly `overlap` characters."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and under the limit")
    paragraphs = paragraph_ends(text) if paragraphs is None else paragraphs
    ends = sentence_ends(text) if ends is None else ends
    tokens: list[int] | None = None
    out, start = [], 0
    while len(text) - start > limit:
        low, high = start + overlap, start + limit
        cut, kind = _last_in(paragraphs, low, high), "paragraph"
        if cut < 0:
            cut, kind = _last_in(ends, low, high), "sentence"
        if cut < 0:
            tokens = token_offsets(text) if tokens is None else tokens
            cut, kind = _last_in(tokens, low, high), "none"
        if cut < 0:
            cut = high
        out.append((start, cut, kind))
        start = cut - overlap
    out.append((start, len(text), "end"))
    return out


SPLIT_COLUMNS = T.StructType(
    [
        T.StructField("boundary", T.StringType()),
        T.StructField(
            "pieces",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("piece", T.IntegerType()),
                        T.StructField("start", T.IntegerType()),
                        T.StructField("end", T.IntegerType()),
                        T.StructField("cut", T.StringType()),
                        T.StructField("text", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)


def split_oversized(df: DataFrame, keys: list[str], fields: list[str], limit: int = 1500, overlap: int = 150, with_text: bool = True) -> DataFrame:
    """One row per value over the limit: the keys, `field`, `n_chars`, `boundary` and the ordered `pieces`.

    Lengths are code points. Values of exactly the limit, shorter, empty or null ones give no row. Rows
    are not compared with each other, so that a repeated row gives repeated results; an empty table gives
    none. Only the keys and fields are read; other columns may have any name, but a key may not be called
    like a result column. Without `with_text` the pieces have offsets only. The filter on length runs before the text goes to Python, without a shuffle.
    """
    clash = {"field", "n_chars", "boundary", "pieces", "_text"} & set(keys)
    if clash:
        raise ValueError(f"keys named like result columns: {sorted(clash)}")
    long = df.select(
        *keys, F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("_text")) for f in fields)))
    ).filter(F.length("_text") > limit)
    schema = T.StructType([*long.drop("_text").schema.fields, T.StructField("n_chars", T.IntegerType()), *SPLIT_COLUMNS.fields])
    arrow = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("cut", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            bounds, pieces = [], []
            for t in texts:
                p, e = paragraph_bounds(t), sentence_bounds(t)
                bounds.append(boundary_of(t, limit, p, e))
                pieces.append(
                    [
                        {"piece": i, "start": a, "end": b, "cut": c, "text": t[a:b] if with_text else None}
                        for i, (a, b, c) in enumerate(pieces_of(t, limit, overlap, p[1], e[1]))
                    ]
                )
            rest = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "_text"]
            names = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array([len(t) for t in texts], pa.int32()), pa.array(bounds, pa.string()), pa.array(pieces, arrow)],
                [*names, "n_chars", "boundary", "pieces"],
            )

    return long.mapInArrow(run, schema)


def explode_pieces(split: DataFrame, keys: list[str]) -> DataFrame:
    """One row per piece of what `split_oversized` returns."""
    return split.select(*keys, "field", "boundary", F.inline("pieces"))
