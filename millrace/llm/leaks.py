"""Problem 8: passages of held-out items inside training documents.

Method: q-gram lemma filtering. Both sides are reduced to a stream of lower-case letters and digits, so
that layout, marks and spelling of hyphens don't matter. Of the q-grams of a passage an edited word of l
characters takes away at most l + q - 1 that follow each other; of every STEP-th one, which are all that is looked
up in a document, at most one more than that over STEP. What is left when the longest words are edited, as many
as the definition bears, is the fewest that a passage and its source share, all on diagonals (document offset minus
item offset) within the length of what interrupts it. Shared q-grams are therefore counted in overlapping
bands of diagonals, and only regions that reach the bound are looked at: their matches are extended letter by letter, and where
enough running words are kept, dynamic programming confined to the band aligns the region.

The items are a stated query set of bounded size, taken in blocks: each block's q-grams go to all tasks,
which scan every document in full. Documents are neither shuffled nor joined with each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.textarr import HAN, U64, Ngrams, arrow_fields, chunks, codepoints, plain

Q = 8
STEP = 4  # every so many characters of a document, its q-gram is looked up
BAND = 256  # width of a band of diagonals; neighbours overlap by half
RUNNING_WORDS = 24  # about 25; of each so many running ones, one in eight may be edited
MARGIN = 24  # characters around a region that count too
SCORE_SHARE = 0.5  # of an aligned passage's characters: matches less edits
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 26
BLOCK = 20_000

_KEEP = np.array([chr(i).isalnum() for i in range(0x30000)])
_WORD = re.compile(rf"[{HAN}]|[^\W_{HAN}]+")


def stream_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits of all texts in one array, a NUL after each text, and the texts' starts in it."""
    flat, starts = codepoints([plain(t) for t in texts])
    keep = _KEEP[np.minimum(flat, len(_KEEP) - 1)] | (flat == 0)
    at = np.cumsum(keep)
    return flat[keep], np.concatenate([[0], at[starts[1:] - 1]])


@dataclass
class ItemIndex:
    """All q-grams of a block of items, sorted by hash, and what verification needs."""

    ids: list[str]
    stream: np.ndarray  # all items, padded
    starts: np.ndarray
    ends: np.ndarray  # where each word ends in its item's stream, item after item
    lengths: np.ndarray  # of the words
    word_base: np.ndarray  # where each item's words begin in `ends`
    base: np.ndarray  # where each item's offsets begin in `length` and `need`
    least: np.ndarray  # the fewest looked-up q-grams that the lemma asks of one of its passages
    length: np.ndarray  # for each offset, the characters of the passage that begins there
    need: np.ndarray  # for each offset, the q-grams that the lemma asks of that passage
    hashes: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    known: np.ndarray


def _passages(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each offset of an item's stream: length and lemma bound of the passage of RUNNING_WORDS words from its word on.

    Towards the end, and in items of fewer words, the last passage's bound holds.
    """
    lengths = np.diff(ends, prepend=0)
    m = min(RUNNING_WORDS, len(ends))
    window = np.lib.stride_tricks.sliding_window_view(lengths, m)
    edited = np.sort(window, axis=1)[:, m - m // 8 :]
    # An edited word, or an interruption, takes away looked-up q-grams in one run.
    lost = -(-(edited + Q - 1) // STEP)
    bound = (window.sum(axis=1) + 1 - Q) // STEP - lost.sum(axis=1) - -(-(Q - 1) // STEP)
    word = np.repeat(np.arange(len(ends)), lengths)
    of = np.minimum(word, len(bound) - 1)
    until = ends[np.minimum(word + m, len(ends)) - 1]
    return until - np.arange(len(word)), np.maximum(2, bound[of])


def build_index(ids: list[str], texts: list[str]) -> ItemIndex:
    """Index of one block. An item whose text has fewer words than a passage must be held whole."""
    ends, lengths, needs, hs, items, offsets, streams = [], [], [], [], [], [], []
    none = np.zeros(0, dtype=np.int64)
    base, least = np.zeros(len(ids) + 1, dtype=np.int64), np.full(len(ids), 1 << 30)
    for i, t in enumerate(texts):
        e = np.cumsum([len(w) for w in _WORD.findall(plain(t))], dtype=np.int64)
        s = stream_of([t])[0][:-1]
        streams.append(s)
        ends.append(e)
        length, need = _passages(e) if len(e) else (none, none)
        lengths.append(length)
        needs.append(need)
        least[i] = need.min(initial=1 << 30)
        base[i + 1] = base[i] + len(s)
        if len(s) >= Q:
            h = Ngrams(s).of(Q)[Q - 1 :]
            hs.append(h)
            items.append(np.full(len(h), i, dtype=np.int64))
            offsets.append(np.arange(len(h), dtype=np.int64))
    h = np.concatenate(hs) if hs else np.zeros(0, dtype=U64)
    order = np.argsort(h, kind="stable")
    known = np.zeros(min(MOST_BITS, max(LEAST_BITS, 1 << (16 * len(h)).bit_length())), dtype=bool)
    known[(h & U64(len(known) - 1)).view(np.int64)] = True
    pad = np.full(1, 1, dtype=np.uint32)  # no document has the characters 1 and 2
    return ItemIndex(
        ids, np.concatenate([*(x for s in streams for x in (s, pad)), pad]), base[:-1] + np.arange(len(ids)), np.concatenate([none, *ends]), np.concatenate([none, *(np.diff(e, prepend=0) for e in ends)]),
        np.cumsum([0, *map(len, ends)]), base, least, np.concatenate([none, *lengths]), np.concatenate([none, *needs]), h[order], np.concatenate([none, *items])[order], np.concatenate([none, *offsets])[order], known,
    )


def align(items: list[np.ndarray], docs: list[np.ndarray], width: int) -> np.ndarray:
    """Best score of a local alignment of each item part with its document part, all at once, within a band.

    Cell (i, k) stands for item offset i and document offset i + k, 0 <= k < width, of parts cut so that
    the band starts at their beginnings. A match counts 1, an edit -1, but no path loses more than an
    edited passage may, and what interrupts the passage costs no more than one edited word.
    """
    n, rows = len(items), max(map(len, items))
    a = np.full((n, rows), 1, dtype=np.uint32)
    d = np.full((n, rows + width), 2, dtype=np.uint32)
    for i, (x, y) in enumerate(zip(items, docs)):
        a[i, : len(x)] = x
        d[i, : len(y)] = y[: rows + width]
    window = np.lib.stride_tricks.sliding_window_view(d, width, axis=1)
    k = np.arange(width, dtype=np.int16)
    prev = np.zeros((n, width), dtype=np.int16)
    best = np.zeros(n, dtype=np.int16)
    for i in range(rows):
        cell = prev + np.where(window[:, i] == a[:, i : i + 1], np.int16(1), np.int16(-1))
        cell[:, :-1] = np.maximum(cell[:, :-1], prev[:, 1:] - 1)
        cell = np.maximum(cell, np.maximum.accumulate(cell, axis=1) - INTERRUPTION)
        cell = np.maximum.accumulate(cell + k, axis=1) - k
        prev = np.maximum(cell, 0).astype(np.int16)
        best = np.maximum(best, prev.max(axis=1))
    return best.astype(np.int64)


INTERRUPTION = np.int16(12)


def _candidates(pair: np.ndarray, diagonal: np.ndarray, offset: np.ndarray, index: ItemIndex) -> list[tuple[np.ndarray, np.ndarray]]:
    """(region, places) for each half of the bands: the shared q-grams, by place, that lie in a region that reaches the bound.

    A pair is a document's number times the number of items, plus the item's; all documents of a chunk are
    looked at together. Within a band, the q-grams shared from an item's offset on, as far as the
    passage goes that begins there, must be as many as the lemma asks; passages that overlap are one region.
    """
    low, items = int(diagonal.min()), len(index.ids)
    # Half bands first: only where two neighbours together have enough q-grams, repeats included, is it worth more.
    halves = (int(diagonal.max()) - low) // (BAND // 2) + 2
    group = pair * halves + (diagonal - low) // (BAND // 2)
    order = np.argsort(group)
    group = group[order]
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    count, owner = np.diff(np.append(first, len(group))), group[first]
    joined = np.append(owner[1:] == owner[:-1] + 1, False)
    good = count + np.where(joined, np.append(count[1:], 0), 0) >= index.least[owner // halves % items]
    good[1:] |= good[:-1] & joined[:-1]
    order = order[np.repeat(good, count)]
    out = []
    for half in (0, BAND // 2) if len(order) else ():
        band = (diagonal[order] - low + half) // BAND
        key = ((pair[order] * (int(band.max()) + 1) + band) << 24) | offset[order]
        by = np.argsort(key, kind="stable")
        place, key = order[by], key[by]
        # Each offset of a band counts once, however many places of the document share it.
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        at = index.base[pair[place[first]] % items] + (key[first] & 0xFFFFFF)
        own = key[first]
        last = np.searchsorted(own, np.minimum(own + index.length[at], own | 0xFFFFFF), "right")
        enough = np.flatnonzero(last - np.arange(len(own)) >= index.need[at])
        if not len(enough):
            continue
        # Passages of a band that follow each other are one region.
        fresh = np.append(True, (own[enough[1:]] >> 24 != own[enough[:-1]] >> 24) | (enough[1:] >= last[enough[:-1]]))
        begin = first[enough[fresh]]
        end = np.append(first, len(key))[np.maximum.reduceat(last[enough], np.flatnonzero(fresh))]
        region = np.repeat(np.arange(len(begin)), end - begin)
        out.append((region, place[np.repeat(begin - np.cumsum(end - begin) + (end - begin), end - begin) + np.arange(len(region))]))
    return out


def _reach(item: np.ndarray, doc: np.ndarray, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """How many characters further on (step 1) or back (step -1) the item at `a` and the document at `b` agree, up to MARGIN."""
    run = np.zeros(len(a), dtype=np.int64)
    live = np.arange(len(a))
    for i in range(MARGIN):
        x, y = a[live] + step * i, b[live] + step * i
        ok = (x >= 0) & (y >= 0)
        ok[ok] = item[np.minimum(x[ok], len(item) - 1)] == doc[np.minimum(y[ok], len(doc) - 1)]
        live = live[ok]
        if not len(live):
            break
        run[live] += 1
    return run


def kept_words(region: np.ndarray, item: np.ndarray, begin: np.ndarray, end: np.ndarray, index: ItemIndex) -> tuple[np.ndarray, np.ndarray]:
    """(kept, edges): for all words of the item of each region, one after the other, whether the region's matches keep it; and where each region's words begin.

    A match covers an item's characters from `begin` up to `end`. A word is kept if it is covered in full, or but
    for a slip: a third of the characters of words of four or more.
    """
    size = np.diff(index.base)[item] + 1
    at = np.cumsum(size) - size
    marks = np.bincount(at[region] + begin, minlength=size.sum()) - np.bincount(at[region] + np.minimum(end, size[region] - 1), minlength=size.sum())
    run = np.concatenate([[0], np.cumsum(np.cumsum(marks) > 0)])
    count = index.word_base[item + 1] - index.word_base[item]
    edges = np.concatenate([[0], np.cumsum(count)])
    word = np.repeat(index.word_base[item] - edges[:-1], count) + np.arange(edges[-1])
    ends = index.ends[word] + np.repeat(at, count)
    length = index.lengths[word]
    return length - (run[ends] - run[ends - length]) <= np.where(length >= 4, length // 3, 0), edges


def passage_of(kept: np.ndarray) -> tuple[int, int, int]:
    """(words kept, first word, last word + 1) of the longest stretch of windows in which seven words in eight are; zeros where there is none.

    In all, so many words must be kept as a passage has: fewer are also shared by two stock sentences.
    """
    m = min(RUNNING_WORDS, len(kept))
    run = np.concatenate([[0], np.cumsum(kept)])
    good = np.flatnonzero(run[m:] - run[:-m] >= m - m // 8) if m else np.zeros(0, np.int64)
    if not len(good):
        return 0, 0, 0
    # The longest stretch of windows that overlap.
    cut = np.flatnonzero(np.append(True, good[1:] > good[:-1] + m))
    stretches = [(int(run[good[y - 1] + m] - run[good[x]]), int(good[x]), int(good[y - 1]) + m) for x, y in zip(cut, np.append(cut[1:], len(good)))]
    best = max(stretches)
    return best if best[0] >= m else (0, 0, 0)


def scan(texts: list[str], index: ItemIndex, together: int = 64) -> list[list[tuple[str, int, int]]]:
    """For each text the items of which it holds a passage: (item id, words kept, score of their alignment)."""
    found: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
    items = len(index.ids)
    for a, b in chunks(texts):
        stream, starts = stream_of(texts[a:b])
        h = np.ascontiguousarray(Ngrams(stream).of(Q)[Q - 1 :: STEP])
        hit = np.flatnonzero(index.known[(h & U64(len(index.known) - 1)).view(np.int64)])
        low = np.searchsorted(index.hashes, h[hit], "left")
        count = np.searchsorted(index.hashes, h[hit], "right") - low
        which = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        at = np.repeat(hit * STEP, count)  # where the q-gram begins in the stream
        doc = np.searchsorted(starts, at, "right") - 1
        pair, offset = doc * items + index.item[which], index.offset[which]
        # Items with fewer shared q-grams in the whole document than the lemma asks of any of their passages.
        own, inverse, n = np.unique(pair, return_inverse=True, return_counts=True)
        worth = (n >= index.least[own % items])[inverse]
        pair, offset, at = pair[worth], offset[worth], at[worth]
        jobs, taken = [], set()
        for region, place in _candidates(pair, at - starts[pair // items] - offset, offset, index) if len(pair) else ():
            o, p = offset[place], pair[place]
            x = index.starts[p % items] + o
            back = _reach(index.stream, stream, x - 1, at[place] - 1, -1)
            on = Q + _reach(index.stream, stream, x + Q, at[place] + Q, 1)
            edges = np.append(np.flatnonzero(np.append(True, region[1:] != region[:-1])), len(region))
            own = p[edges[:-1]]
            kept, words_at = kept_words(region, own % items, o - back, o + on, index)
            run = np.concatenate([[0], np.cumsum(kept)])
            for r in np.flatnonzero(run[words_at[1:]] - run[words_at[:-1]] >= np.minimum(RUNNING_WORDS, np.diff(words_at))):
                y, z = edges[r], edges[r + 1]
                t, i = divmod(int(own[r]), items)
                words, first, last = passage_of(kept[words_at[r] : words_at[r + 1]])
                ends = index.ends[index.word_base[i] : index.word_base[i + 1]]
                if words and (t, i, first, last) not in taken:  # else the other half of the bands has it
                    taken.add((t, i, first, last))
                    begin, end = int(ends[first - 1]) if first else 0, int(ends[last - 1])
                    used = (o[y:z] >= begin) & (o[y:z] < end)
                    d = at[place[y:z]][used] - starts[t] - o[y:z][used]
                    near, far = int(d.min()) - MARGIN, int(d.max()) + MARGIN
                    start = int(starts[t]) + begin + near
                    part = stream[max(int(starts[t]), start) : min(int(starts[t + 1]) - 1, start + end - begin + far - near + 1)]
                    if start < starts[t]:  # the band begins before the document does
                        part = np.concatenate([np.full(int(starts[t]) - start, 2, dtype=np.uint32), part])
                    jobs.append((far - near + 1, a + t, i, words, index.stream[index.starts[i] + begin : index.starts[i] + end], part))
        jobs.sort(key=lambda j: (j[0] // 32, len(j[4])))
        for g in range(0, len(jobs), together):
            group = jobs[g : g + together]
            for (_, t, i, words, x, _), score in zip(group, align([j[4] for j in group], [j[5] for j in group], max(j[0] for j in group))):
                if score >= SCORE_SHARE * len(x):
                    found[t][i] = max(found[t].get(i, (0, 0)), (words, int(score)))
    return [[(index.ids[i], w, s) for i, (w, s) in f.items()] for f in found]


def find_leaks(docs: DataFrame, doc_key: str, text: str, items: DataFrame, item_key: str, item_text: str, block: int = BLOCK) -> DataFrame:
    """(doc_key, item_id, n_words, score) for each document with each item of which it holds a passage.

    A passage is about `RUNNING_WORDS` running words of the item, of which one in eight may be edited, apart from interruptions of
    less than half a band; of an item with fewer words, all of them; an item
    of fewer than Q letters has no q-gram and is in no document. Null and blank documents and items
    match nothing; equal items under several ids are all reported; repeated document rows give repeated
    results. Items are read to the driver, `block` at a time, so that a block's index has a bounded size.
    """
    doc = docs.select(F.col(doc_key).alias("_key"), F.col(text).alias("_text")).filter("_text is not null")
    schema = T.StructType([T.StructField(doc_key, doc.schema["_key"].dataType), T.StructField("item_id", T.StringType()), T.StructField("n_words", T.IntegerType()), T.StructField("score", T.IntegerType())])
    arrow = pa.schema([pa.field(doc_key, arrow_fields(doc.select("_key"))[0][1]), ("item_id", pa.string()), ("n_words", pa.int32()), ("score", pa.int32())])
    chosen = items.select(F.col(item_key).cast("string").alias("i"), F.col(item_text).alias("t")).filter(r"i is not null and t rlike '(?U)\\w'").dropDuplicates(["i"]).orderBy("i")
    parts: list[DataFrame] = []
    ids: list[str] = []
    texts: list[str] = []

    def close_block() -> None:
        shared = docs.sparkSession.sparkContext.broadcast(build_index(list(ids), list(texts)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = scan(batch.column("_text").to_pylist(), shared.value)
                at = [i for i, f in enumerate(found) for _ in f]
                flat = [x for f in found for x in f]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_key").take(pa.array(at, pa.int64())), pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.int32()), pa.array([x[2] for x in flat], pa.int32())],
                    schema=arrow,
                )

        parts.append(doc.mapInArrow(run, schema))
        ids.clear()
        texts.clear()

    for row in chosen.toLocalIterator():
        ids.append(row.i)
        texts.append(row.t)
        if len(ids) == block:
            close_block()
    if ids or not parts:
        close_block()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
