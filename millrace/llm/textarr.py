"""Batches of strings as flat code-point arrays, and hashes of all their n-grams at once."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

U64 = np.uint64
#: Odd multiplier of the rolling hash and the finaliser's two constants (splitmix64).
BASE = U64(0x9E3779B97F4A7C15)
MIX1, MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)

CHUNK_CHARS = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (splitmix64 finaliser)."""
    h = (h ^ (h >> U64(30))) * MIX1
    h = (h ^ (h >> U64(27))) * MIX2
    return h ^ (h >> U64(31))


def arrow_fields(df: DataFrame) -> list[tuple[str, pa.DataType]]:
    """Name and Arrow type of each column, for the schema of record batches that keep them."""
    return [(f.name, to_arrow_type(f.dataType)) for f in df.schema.fields]


def chunks(texts: Sequence[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of `texts` that hold about `limit` characters each; one long text is a range by itself."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def codepoints(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one uint32 array, each followed by a NUL, and the start of each (one more at the end)."""
    flat = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return flat, starts


class Ngrams:
    """Hashes of the n-grams ending at each position of a flat array, for doubled and summed lengths."""

    def __init__(self, flat: np.ndarray) -> None:
        self.by: dict[int, np.ndarray] = {1: mix(flat.astype(U64) + U64(1))}

    def of(self, n: int) -> np.ndarray:
        """Entry i is the hash of positions i-n+1..i; the first n-1 entries are of shorter grams."""
        if n not in self.by:
            a = 1 << ((n - 1).bit_length() - 1)
            left, right = self.of(a), self.of(n - a)
            power = U64(pow(int(BASE), n - a, 1 << 64))
            out = right.copy()
            out[n - a :] += left[: len(left) - (n - a)] * power
            self.by[n] = out
        return self.by[n]


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0..n-1, modulo 2^64."""
    out = []
    for x in (int(BASE), pow(int(BASE), -1, 1 << 64)):
        p = np.full(n, x, dtype=U64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=U64))
    return out[0], out[1]


class Rolling:
    """The hashes that `Ngrams` gives, for any length, only where they are asked for."""

    def __init__(self, flat: np.ndarray) -> None:
        self.power, inverse = _powers(1 << max(20, int(len(flat)).bit_length()))
        self.sums = np.zeros(len(flat) + 1, dtype=U64)
        np.cumsum(mix(flat.astype(U64) + U64(1)) * inverse[: len(flat)], out=self.sums[1:])

    def of(self, n: int, at: np.ndarray) -> np.ndarray:
        """Hashes of the n-grams that end at the places `at`, all of them n - 1 or more."""
        return (self.sums[at + 1] - self.sums[at + 1 - n]) * self.power[at]


INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿]")


def plain(text: str) -> str:
    """Entities resolved, compatibility forms folded, invisible characters dropped, lower case."""
    if "&" in text:
        text = unescape(text)
    if not text.isascii():
        text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return text.lower()


HAN = "㐀-䶿一-鿿豈-﫿"
_TOKEN = re.compile(rf"[{HAN}]|[^\W_{HAN}]+")


def words(text: str) -> list[str]:
    """Words of `plain(text)`; each Han character is one."""
    return _TOKEN.findall(plain(text))
