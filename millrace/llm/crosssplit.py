"""Problem 3: records of evaluation splits that also stand, exactly or nearly, in the training split.

Method: edit-distance segment join, with words as the units of editing. A text whose near copies bear k edits is
cut into k + 1 segments, of which at least one stands unchanged in each of them; the texts of the other side are
searched for the segments at the positions that the edits, and one sentence more, less or moved, allow, and
candidates are verified with banded dynamic programming. Nearness is mutual, so that either side may be cut: as all
positions of the other one are sent about, the side that is cut is the larger one, the training texts.

A matching segment alone says little where texts are made of stock sentences. More is known of a near copy:
read round the text, one of its unchanged segments has at most one edit in the next segment and at most two in
the next two, or else the edits would add up to more than k. Each segment therefore carries a fingerprint of the
sixteen words that follow it, and the join's own condition compares fingerprints; pairs are then held against
each other by bitmaps of their words. No pair within the bounds is lost by any of this: fingerprints and bitmaps
err to the side of letting through, at every size. Segments that many texts have are salted.

Equal texts, beyond layout and notation, are one class first: links are found between classes, and a class's
members are listed once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.components import split_name
from millrace.llm.textarr import HAN, U64, Ngrams, mix, plain
from millrace.session import stored

AHEAD = 16  # words after a segment of which it carries a fingerprint of four bits each
BAG = 4  # words of 64 bits of a text's bitmap of words
HOT = 2000  # a segment is hot from this part of all segments on, so that there are at most so many hot ones
BLOCK_SHARE = 0.4  # of the longer text: no sentence that is more, less or moved is longer

_TOKEN = re.compile(rf"[{HAN}]|[^\W_{HAN}]+|[。!?]|\.(?=[\"'”’»)\]]*(?:\s|$))|\n")
_STOPS = frozenset("。!?.\n")


def edits_borne(n: np.ndarray | int) -> np.ndarray:
    """k: the edits borne by two texts the shorter of which has n words: one word in eight, and one more where k + 1 segments of 7 words still fit."""
    n = np.asarray(n)
    return n // 8 + np.where(n < 56, n >= 16, 7 * (n // 8 + 2) <= n)


def slack(n: np.ndarray | int) -> np.ndarray:
    """The edits borne besides a sentence that is more, less or moved."""
    return edits_borne(n) // 4 + (np.asarray(n) >= 16)


def segment_length(n: np.ndarray) -> np.ndarray:
    """Words of each of the k + 1 segments of a text of n words; 0 for texts that bear no edit, which are only compared as a whole."""
    k = edits_borne(n)
    return np.where(k > 0, n // (k + 1), 0)


def tokens_of(text: str) -> tuple[list[str], int]:
    """Words of the plain text, each Han character one, and the words of its longest sentence."""
    out: list[str] = []
    longest = begin = 0
    for x in _TOKEN.findall(plain(text)):
        if x in _STOPS:
            longest = max(longest, len(out) - begin)
            begin = len(out)
        else:
            out.append(x)
    return out, max(longest, len(out) - begin)


def bag_of(tokens: np.ndarray) -> list[int]:
    """Bitmap of a text's words, as BAG signed 64-bit numbers."""
    bits = np.zeros(64 * BAG, dtype=np.uint8)
    bits[(mix(tokens.astype(U64)) % U64(64 * BAG)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64).tolist()


_BAG = [f"bag{i}" for i in range(BAG)]


def classes_of(df: DataFrame, key: str, split: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(members, classes): (id, part, class) of each record of a split with text, and each class's words.

    A key that is delivered twice counts once. Null, blank and wordless texts and records without a
    split are left out. The class is the least id of those with the same words. Classes have `tokens` (hashes
    of the words), `reach` (how far one sentence displaces the rest), the bitmap of their words, and
    whether `train` and `held` records are among them.
    """
    own = df.select(F.col(key).cast("long").alias("id"), split_name(F.col(split)).alias("part"), F.col(text).alias("_text")).filter("id is not null and part is not null and _text is not null")
    fields = [("id", T.LongType(), pa.int64()), ("part", T.StringType(), pa.string()), ("same", T.BinaryType(), pa.binary()), ("tokens", T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), ("reach", T.IntegerType(), pa.int32())]
    fields += [(b, T.LongType(), pa.int64()) for b in _BAG]
    schema = T.StructType([T.StructField(n, t) for n, t, _ in fields])
    arrow = pa.schema([(n, a) for n, _, a in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            at, same, tokens, reach, bags = [], [], [], [], []
            for i, t in enumerate(batch.column("_text").to_pylist()):
                w, longest = tokens_of(t)
                if w:
                    at.append(i)
                    same.append(xxhash.xxh3_128_digest(" ".join(w)))
                    for x in w:
                        if x not in known:
                            known[x] = xxhash.xxh3_64_intdigest(x) >> 33
                    tokens.append(np.fromiter((known[x] for x in w), dtype=np.int32, count=len(w)))
                    reach.append(min(longest, int(BLOCK_SHARE * len(w)) + 1))
                    bags.append(bag_of(tokens[-1]))
            if len(known) > 1 << 20:
                known.clear()
            take = pa.array(at, pa.int64())
            columns = np.array(bags, dtype=np.int64).reshape(-1, BAG)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(take), batch.column("part").take(take), pa.array(same, pa.binary()), pa.array(tokens, pa.list_(pa.int32())), pa.array(reach, pa.int32()), *(pa.array(columns[:, i]) for i in range(BAG))],
                schema=arrow,
            )

    rows = own.mapInArrow(run, schema)
    grouped = stored(
        rows.groupBy("same").agg(
            F.min("id").alias("class"), F.first("tokens").alias("tokens"), F.max("reach").alias("reach"), *(F.first(b).alias(b) for b in _BAG),
            F.max((F.col("part") == "train").cast("int")).alias("train"), F.max((F.col("part") != "train").cast("int")).alias("held"),
        )
    )
    members = stored(rows.select("id", "part", "same").distinct().join(grouped.select("same", "class"), "same").select("id", "part", "class"))
    return members, grouped.drop("same")


class _Texts:
    """The token lists of a batch, each read round: after a text its first AHEAD words follow again."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        col = batch.column("tokens")
        offsets = np.asarray(col.offsets) - col.offsets[0].as_py()
        flat = np.asarray(col.flatten()).astype(np.uint32)
        self.n = np.diff(offsets).astype(np.int64)
        wide = self.n + AHEAD
        self.starts = np.cumsum(wide) - wide
        self.row = np.repeat(np.arange(len(wide)), wide)
        self.pos = np.arange(len(self.row)) - self.starts[self.row]
        ring = flat[offsets[self.row] + self.pos % self.n[self.row]]
        self.grams = Ngrams(ring)
        # Fingerprints of the words that begin at each place, four bits each, the first one lowest.
        ahead = np.concatenate([mix(ring.astype(U64) + U64(99)) >> U64(60), np.zeros(AHEAD, dtype=U64)])
        for step in (1, 2, 4, 8):
            ahead[: len(ahead) - step] |= ahead[step:] << U64(4 * step)
        self.ahead = ahead

    def hashes(self, q: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, hash) of the segments of q words of the wanted rows; a place is where a segment begins in the ring."""
        at = np.flatnonzero((self.pos <= self.n[self.row] - q) & wanted[self.row])
        return at, self.grams.of(q)[at + q - 1] ^ (U64(q) << U64(56))


LENGTHS = (4, 5, 6, 7)  # all that segment_length gives
LONG = 400  # texts of so many words, and all near them, have segments of 7
_UP_TO = {q: np.cumsum(segment_length(np.arange(2 * LONG)) == q) for q in LENGTHS}


def searched(n: np.ndarray, reach: np.ndarray, q: int) -> np.ndarray:
    """Whether a text of n words, one sentence of which has at most `reach`, can be near a cut one whose segments have q words."""
    low = n - np.maximum(reach + slack(n), edits_borne(n)) - 2
    high = np.ceil(n / (1 - BLOCK_SHARE)).astype(np.int64) + 4
    within = _UP_TO[q][np.minimum(high, 2 * LONG - 1)] > _UP_TO[q][np.clip(low, 1, 2 * LONG - 1) - 1]
    return (n >= q) & np.where(n < LONG, within, q == 7)


def cut_segments(classes: DataFrame) -> DataFrame:
    """The k + 1 segments of each class, with the fingerprint of what follows.

    `near1` and `near2` mark the words ahead in which at most one and at most two edits can be.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            t = _Texts(batch)
            q, k = segment_length(t.n), edits_borne(t.n)
            row = np.repeat(np.arange(len(q)), np.where(q > 0, k + 1, 0))
            first = np.searchsorted(row, np.arange(len(q)))
            pos = (np.arange(len(row)) - first[row]) * q[row]
            at = t.starts[row] + pos
            h = np.zeros(len(row), dtype=U64)
            for length in np.unique(q[q > 0]):
                own = q[row] == length
                h[own] = t.grams.of(int(length))[at[own] + length - 1] ^ (U64(length) << U64(56))
            left = t.n[row] - q[row]
            ones, flags = U64(0x1111111111111111), []
            for segments in (1, 2):
                words = np.where(k[row] >= segments, np.minimum(np.minimum(segments * q[row], left), AHEAD - 2), 0)
                flags.append(np.where(words > 0, ones >> (U64(64) - U64(4) * words.astype(U64)) % U64(64), U64(0)))
            reach = np.maximum(np.asarray(batch.column("reach"))[row], k[row] + 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), batch.column("class").take(pa.array(row)), pa.array(pos.astype(np.int32)), pa.array(t.n[row].astype(np.int32)), pa.array(reach), pa.array(t.ahead[at + q[row]].view(np.int64)), *(pa.array(f.view(np.int64)) for f in flags)],
                ["h", "cut", "pos", "n", "reach", "ahead", "near1", "near2"],
            )

    return classes.select("class", "tokens", "reach").mapInArrow(run, "h long, cut long, pos int, n int, reach int, ahead long, near1 long, near2 long")


def all_segments(classes: DataFrame) -> DataFrame:
    """The segments at all positions of each class, of the lengths that near texts are cut into.

    `place` packs the position (25 bits), the text's words (25 bits) and its reach (13 bits; the most stands for any).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            t = _Texts(batch)
            reach = np.asarray(batch.column("reach")).astype(np.int64)
            place = (t.n << 13) | np.minimum(reach, (1 << 13) - 1)
            for q in LENGTHS:
                at, h = t.hashes(q, searched(t.n, reach, q))
                row = t.row[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), batch.column("class").take(pa.array(row)), pa.array((t.pos[at] << 38) | place[row]), pa.array(t.ahead[at + q].view(np.int64))],
                    ["h", "other", "place", "after"],
                )

    return classes.select("class", "tokens", "reach").mapInArrow(run, "h long, other long, place long, after long")


def _apart(shift: int) -> Column:
    """Flags of the words ahead of a segment that the other text has not `shift` words further on."""
    after = F.col("after")
    other = F.shiftrightunsigned(after, 4 * shift) if shift > 0 else F.shiftleft(after, -4 * shift) if shift else after
    x = F.col("ahead").bitwiseXOR(other)
    folded = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    return folded.bitwiseOR(F.shiftrightunsigned(folded, 2))  # its lowest bit of four counts


def _may_be_near() -> Column:
    """Whether a segment's match can belong to a near pair: by its position and by the words that follow it."""
    pos, n, reach = F.shiftright("place", 38), F.shiftright("place", 13).bitwiseAND(F.lit((1 << 25) - 1)), F.col("place").bitwiseAND(F.lit((1 << 13) - 1))
    far = F.greatest(F.col("reach").cast("long"), F.when(reach == (1 << 13) - 1, F.lit(1 << 40)).otherwise(reach), F.expr("1") + F.shiftright(F.greatest(n, F.col("n").cast("long")), 3))
    one = _apart(0).bitwiseAND(_apart(1)).bitwiseAND(_apart(-1))
    two = one.bitwiseAND(_apart(2)).bitwiseAND(_apart(-2))
    return (
        (F.abs(F.col("pos") - pos) <= far) & (F.abs(F.col("n") - n) <= far)
        & (F.bit_count(one.bitwiseAND(F.col("near1"))) <= 1) & (F.bit_count(two.bitwiseAND(F.col("near2"))) <= 2)
    )


def banded_distance(a: list[np.ndarray], b: list[np.ndarray], band: int) -> np.ndarray:
    """Edit distance in words of each pair, swapped neighbours counting once, for all pairs at once; paths leave the diagonal by `band` words at most."""
    n, rows = len(a), max(map(len, a))
    width = 2 * band + 1
    x = np.full((n, rows), -1, dtype=np.int32)
    y = np.full((n, rows + width + 1), -2, dtype=np.int32)
    la, lb = np.array([len(t) for t in a]), np.array([len(t) for t in b])
    for i, (s, t) in enumerate(zip(a, b)):
        x[i, : len(s)] = s
        t = t[: rows + band]
        y[i, band : band + len(t)] = t
    window = np.lib.stride_tricks.sliding_window_view(y, width, axis=1)
    k = np.arange(width, dtype=np.int32)
    far = np.int32(1 << 20)
    # Cell k of row i is the distance of a's first i words and b's first i + k - band.
    prev = np.where(k >= band, k - band, far).astype(np.int32)[None, :].repeat(n, axis=0)
    out = np.full(n, far, dtype=np.int32)
    end = lb - la + band
    inside = (end >= 0) & (end < width)
    for i in range(rows + 1):
        done = np.flatnonzero((la == i) & inside)
        out[done] = prev[done, end[done]]
        if i == rows:
            break
        cell = prev + (window[:, i] != x[:, i : i + 1])
        cell[:, :-1] = np.minimum(cell[:, :-1], prev[:, 1:] + 1)
        if i:  # two neighbours that changed places are one edit
            swapped = (window[:, i - 1] == x[:, i : i + 1]) & (window[:, i] == x[:, i - 1 : i])
            cell = np.where(swapped, np.minimum(cell, before + 1), cell)
        before = prev
        j = i + 1 + k - band  # the words of b that a cell has taken; under 0 there is none
        cell = np.where(j[None, :] < 0, far, cell)
        cell = np.where(j[None, :] == 0, np.minimum(cell, i + 1), cell)
        prev = (np.minimum.accumulate(cell - k, axis=1) + k).astype(np.int32)
    return out


def one_block_apart(a: np.ndarray, b: np.ndarray, block: int) -> tuple[int, int]:
    """(edits if one block of a or of b is left out, edits if one of each is), for blocks of at most about `block` words.

    Banded dynamic programming over four states: nothing left out so far, a block of b, one of a, one of
    both. Leaving out costs nothing; a path can't leave the diagonal by more than the block and the slack.
    """
    band = block + int(slack(max(len(a), len(b)))) + 1
    width, far = 2 * band + 1, 1 << 20
    y = np.concatenate([np.full(band, -2, dtype=np.int32), b, np.full(width + len(a) + 1, -2, dtype=np.int32)])
    k = np.arange(width)
    neither = np.where(k >= band, k - band, far)
    states = {"": neither, "b": np.where(k >= band, 0, far), "a": np.full(width, far), "ab": np.full(width, far)}
    leaving = {"a": np.full(width, far), "ab": np.full(width, far)}
    for i, x in enumerate(a):
        j = i + 1 + k - band
        passed = {"a": np.minimum(leaving["a"], states[""]), "ab": np.minimum(leaving["ab"], states["b"])}
        leaving = {s: np.append(v[1:], far) for s, v in passed.items()}
        stepped = {}
        for s, prev in states.items():
            cell = prev + (y[i : i + width] != x)
            cell[:-1] = np.minimum(cell[:-1], prev[1:] + 1)
            if s in leaving:
                cell = np.minimum(cell, leaving[s])
            stepped[s] = np.where(j < 0, far, cell)
        stepped["b"] = np.minimum(stepped["b"], np.minimum.accumulate(stepped[""]))
        stepped["ab"] = np.minimum(stepped["ab"], np.minimum.accumulate(stepped["a"]))
        states = {s: np.minimum.accumulate(v - k) + k for s, v in stepped.items()}
    end = len(b) - len(a) + band
    if not 0 <= end < width:
        return far, far
    return int(min(states["a"][end], states["b"][end])), int(states["ab"][end])


def _missing(s: np.ndarray, t: np.ndarray) -> int:
    """How many words of s, counted as often as they stand, t has not."""
    words, n = np.unique(s, return_counts=True)
    other, m = np.unique(t, return_counts=True)
    at = np.minimum(np.searchsorted(other, words), len(other) - 1)
    return int(np.maximum(0, n - np.where(other[at] == words, m[at], 0)).sum())


def near(a: list[np.ndarray], b: list[np.ndarray], blocks: list[int] | None = None) -> np.ndarray:
    """Whether each pair is near: at most about one word in eight edited, or one sentence more, less or moved.

    A sentence has at most `blocks` words; where none are given, at most BLOCK_SHARE of the longer text.
    """
    out = np.zeros(len(a), dtype=bool)
    shorter = np.array([min(len(s), len(t)) for s, t in zip(a, b)], dtype=np.int64)
    k, spare = edits_borne(shorter), slack(shorter)
    todo, rest = [], []
    for i, (s, t) in enumerate(zip(a, b)):
        cap = int(BLOCK_SHARE * max(len(s), len(t)))
        cap = cap if blocks is None else min(cap, int(blocks[i]))
        less, more = _missing(s, t), _missing(t, s)
        if max(less, more) <= k[i]:  # an edit changes at most one word
            todo.append(i)
        if min(less, more) <= spare[i] and max(less, more) <= spare[i] + cap:
            rest.append((i, cap, max(less, more) <= spare[i]))
    todo.sort(key=lambda i: shorter[i])
    for g in range(0, len(todo), 64):
        part = todo[g : g + 64]
        d = banded_distance([a[i] for i in part], [b[i] for i in part], int(k[part].max()))
        out[part] = d <= k[part]
    for i, cap, same_words in rest:
        if not out[i]:
            one, both = one_block_apart(a[i], b[i], cap)
            out[i] = one <= spare[i] or same_words and both <= spare[i]
    return out


def hot_segments(segments: DataFrame, total: int) -> DataFrame:
    """(h, salts) of the segments that make up more than one part in HOT of all, at most 2 HOT ones.

    Each task counts its own rows and passes on what is hot among them, so that only few counts are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.asarray(batch.column("h")) for batch in batches]
        h, n = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        often = n > max(1, n.sum() // HOT)
        yield pa.RecordBatch.from_arrays([pa.array(h[often]), pa.array(n[often].astype(np.int64))], ["h", "n"])

    part = max(1, total // (2 * HOT))
    counts = segments.select("h").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") > part).select("h", F.expr(f"cast(n div {2 * part} + 1 as int)").alias("salts"))


def near_classes(classes: DataFrame, cut: str = "train") -> DataFrame:
    """(held, train): pairs of different classes that are near; the side `cut` is cut into segments."""
    other = "held" if cut == "train" else "train"
    left_classes = classes.filter(f"{cut} = 1")
    left = cut_segments(left_classes)
    right = all_segments(classes.filter(f"{other} = 1"))
    # Hot segments get salts in proportion, so that their matches are shared out.
    total = left_classes.agg(F.sum(F.shiftright(F.size("tokens"), 3) + 2)).first()[0] or 0
    hot = F.broadcast(hot_segments(left, total))
    a = right.join(hot, "h", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    b = left.join(hot, "h", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("cut"), F.col("salts").cast("long")).cast("int"), F.lit(0))).drop("salts")
    joined = b.join(a.hint("merge"), (a.h == b.h) & (a.salt == b.salt) & (F.col("cut") != F.col("other")) & _may_be_near())
    pairs = joined.select(F.col("cut").alias(cut), F.col("other").alias(other)).distinct()

    texts = classes.select("class", "reach", F.size("tokens").alias("n"), *_BAG)
    sides = [texts.select(F.col("class").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("reach", "n", *_BAG))) for s in ("held", "train")]
    both = pairs.join(sides[0].hint("merge"), "held").join(sides[1].hint("merge"), "train")
    only = lambda s, t: sum((F.bit_count(F.col(f"{b}_{s}").bitwiseAND(F.bitwise_not(f"{b}_{t}"))) for b in _BAG), F.lit(0))
    shorter = F.least("n_held", "n_train")
    k = F.shiftright(shorter, 3) + (shorter >= 16).cast("int")
    spare = F.shiftright(k, 2) + (shorter >= 16).cast("int")
    least, most = F.least(only("held", "train"), only("train", "held")), F.greatest(only("held", "train"), only("train", "held"))
    fits = (most <= k) | (least <= spare) & (most <= spare + F.greatest("reach_held", "reach_train"))
    chosen = stored(both.filter(fits).select("held", "train", F.greatest("reach_held", "reach_train").alias("block")))
    words = chosen.join(classes.select(F.col("class").alias("held"), F.col("tokens").alias("a")), "held").join(classes.select(F.col("class").alias("train"), F.col("tokens").alias("b")), "train")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = ([np.asarray(v.values, dtype=np.int32) for v in batch.column(c)] for c in ("a", "b"))
                at = pa.array(np.flatnonzero(near(a, b, batch.column("block").to_pylist())))
                yield pa.RecordBatch.from_arrays([batch.column("held").take(at), batch.column("train").take(at)], ["held", "train"])

    return words.select("held", "train", "block", "a", "b").mapInArrow(verify, "held long, train long")


def class_links(df: DataFrame, key: str = "sample_id", split: str = "split", text: str = "patient_context") -> tuple[DataFrame, DataFrame]:
    """(members, links): (id, part, class) of each record, and (held, train) of each pair of classes that is equal or near.

    Null, blank and wordless texts and records without a split are in no class; repeated keys count once. An
    empty table, or one without either side, gives no link. Only the named columns are read.
    """
    members, classes = classes_of(df, key, split, text)
    same = classes.filter("train = 1 and held = 1").select(F.col("class").alias("held"), F.col("class").alias("train"))
    return members, stored(near_classes(classes).unionByName(same))


def cross_split_overlaps(df: DataFrame, key: str = "sample_id", split: str = "split", text: str = "patient_context") -> DataFrame:
    """(held_id, held_part, train_id): every pair of an evaluation and a training record that is equal or near.

    The links of `class_links`, expanded to records; what holds there of nulls, repeated keys and empty tables holds here.
    """
    members, links = class_links(df, key, split, text)
    return (
        links.join(members.filter("part <> 'train'").select(F.col("class").alias("held"), F.col("id").alias("held_id"), F.col("part").alias("held_part")), "held")
        .join(members.filter("part = 'train'").select(F.col("class").alias("train"), F.col("id").alias("train_id")), "train")
        .select("held_id", "held_part", "train_id")
    )
