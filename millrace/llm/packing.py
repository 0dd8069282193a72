"""Problem 7: texts packed whole into training sequences of a fixed number of tokens.

Method: pattern packing by non-negative least squares. A pattern says how many texts of each length class
fill one sequence. Repeat counts of patterns are fitted to the histogram of lengths; patterns of few
documents are enumerated by dynamic programming over the capacity, which yields at each step the
one that fits the rest of the histogram best, until the rest is small. Counts are rounded down, and what is left
of the histogram is packed largest first.

Only the histogram, at most one count for each class, reaches the driver. Documents learn their place from
their rank within their class: a class is cut into buckets of bounded size, ranks are counted within a
bucket and shifted by the sizes of the buckets before it, so that no task sees a whole class.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.llm.textarr import arrow_fields
from millrace.session import cut_lineage

CAPACITY = 2048
CLASS_WIDTH = 4
RANKED_TOGETHER = 200_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: how the byte-level vocabulary cuts a text into words.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, n_tokens) of each text under the vocabulary at `tokenizer`; null texts have 0 tokens."""
    schema = T.StructType([df.schema[key], T.StructField("n_tokens", T.LongType())])
    arrow = pa.schema([*arrow_fields(df.select(key)), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _encoding(tokenizer).encode_ordinary
        for batch in batches:
            n = [len(count(t)) if t else 0 for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(n, pa.int64())], schema=arrow)

    return df.select(key, F.col(text).alias("_text")).mapInArrow(run, schema)


def _best_pattern(worth: np.ndarray, capacity: int) -> np.ndarray | None:
    """How many of each class (1..capacity) fill the capacity exactly with the greatest worth; null if none can."""
    sizes = np.flatnonzero(np.isfinite(worth)) + 1
    value = np.full(capacity + 1, -np.inf)
    value[0] = 0.0
    chosen = np.zeros(capacity + 1, dtype=np.int64)
    w = worth[sizes - 1]
    for c in range(1, capacity + 1):
        n = np.searchsorted(sizes, c, "right")
        if n:
            reach = value[c - sizes[:n]] + w[:n]
            k = int(reach.argmax())
            value[c], chosen[c] = reach[k], sizes[k]
    c = capacity
    while c > 0 and not np.isfinite(value[c]):
        c -= 1
    if c <= 0:
        return None
    out = np.zeros(len(worth), dtype=np.int64)
    while c > 0:
        out[chosen[c] - 1] += 1
        c -= chosen[c]
    return out


def fit_patterns(histogram: np.ndarray, capacity: int, rounds: int = 600, rest: float = 0.002) -> list[tuple[np.ndarray, int]]:
    """Patterns (count of each class) with the repeats that use up the histogram exactly.

    `histogram[i]` is the number of items of size i + 1. The fit ends when the rest is under the share
    `rest` of all items or after `rounds` patterns; what rounding leaves is packed largest first.
    """
    h = histogram.astype(np.float64)
    scale = max(1.0, h.max(initial=0.0))
    target = h / scale
    columns: list[np.ndarray] = []
    gram = np.zeros((rounds, rounds))
    x = np.zeros(rounds)
    residual = target.copy()
    present = h > 0
    for k in range(rounds):
        if np.abs(residual).sum() <= rest * target.sum():
            break
        new = _best_pattern(np.where(present, residual, -np.inf), capacity)
        if new is None or any((new == c).all() for c in columns):
            if new is None or np.abs(residual).sum() <= 0.02 * target.sum():
                break
        column = new.astype(np.float64)
        columns.append(new)
        matrix = np.stack(columns).astype(np.float64)
        gram[k, : k + 1] = gram[: k + 1, k] = matrix @ column
        toward = matrix @ target
        # Coordinate descent on the normal equations with x >= 0.
        g = gram[: k + 1, : k + 1]
        gradient = g @ x[: k + 1] - toward
        for _ in range(4):
            for i in range(k, -1, -1):
                step = max(-x[i], -gradient[i] / g[i, i])
                if step:
                    x[i] += step
                    gradient += g[i] * step
        residual = target - x[: k + 1] @ matrix
    left = histogram.astype(np.int64).copy()
    out: list[tuple[np.ndarray, int]] = []

    def use(pattern: np.ndarray, times: int) -> None:
        on = pattern > 0
        times = min(times, int((left[on] // pattern[on]).min(initial=1 << 60)))
        if times > 0:
            left[on] -= pattern[on] * times
            out.append((pattern, times))

    for i in np.argsort(-x[: len(columns)]):
        use(columns[i], int(x[i] * scale))
    # The rest, largest first: each sequence takes the largest class that is left, then fills up from what is left.
    while left.any():
        pattern, room = np.zeros(len(left), dtype=np.int64), capacity
        while room > 0:
            fitting = np.flatnonzero(left[: min(room, len(left))] > pattern[: min(room, len(left))])
            if not len(fitting):
                break
            size = int(fitting[-1]) + 1
            n = min(int(left[size - 1] - pattern[size - 1]), room // size)
            pattern[size - 1] += n
            room -= size * n
        use(pattern, 1 << 60)
    return out


def pack(sizes: DataFrame, key: str, capacity: int = CAPACITY, class_width: int = CLASS_WIDTH) -> DataFrame:
    """(key, piece, n_tokens, sequence, position): the place of every document, or of each piece of an oversized one.

    `sizes` has a unique key and `n_tokens`; repeated keys count once, with the greatest count. A
    document over the capacity is cut into full sequences and a rest, which is packed like a document.
    Documents without tokens, null counts and null keys are in no sequence: sequence and position are
    null. Sequences are numbered from 0; `position` is the first token's place in the sequence.
    """
    classes = -(-capacity // class_width)
    known = sizes.groupBy(key).agg(F.max("n_tokens").cast("long").alias("n"))
    known = cut_lineage(known)
    pieces = known.filter("n > 0").select(
        key, F.explode(F.expr(f"transform(sequence(0, cast((n - 1) div {capacity} as int)), i -> struct(i as piece, least(n - i * {capacity}, {capacity}L) as n_tokens))")).alias("p")
    ).select(key, "p.piece", "p.n_tokens")
    pieces = pieces.withColumn("class", F.expr(f"cast((n_tokens + {class_width - 1}) div {class_width} as int)"))
    count = {r["class"]: r["count"] for r in pieces.groupBy("class").count().collect()}  # at most `classes` rows
    histogram = np.zeros(classes, dtype=np.int64)
    for c, n in count.items():
        histogram[c - 1] = n
    # With a width that doesn't divide the capacity the last class would overflow it by rounding.
    plan, first, taken = [], 0, np.zeros(classes, dtype=np.int64)
    fits = capacity // class_width
    full = int(histogram[fits:].sum()) if fits < classes else 0
    patterns = fit_patterns(histogram[:fits], fits)
    if full:
        patterns += [(np.eye(1, classes, i, dtype=np.int64)[0], int(histogram[i])) for i in range(fits, classes) if histogram[i]]
    for pattern, times in patterns:
        slot = 0
        for i in np.flatnonzero(pattern):
            n = int(pattern[i]) * times
            plan.append((int(i) + 1, int(taken[i]), int(taken[i]) + n, first, times, slot))
            taken[i] += n
            slot += int(pattern[i])
        first += times
    spark = sizes.sparkSession
    intervals = spark.createDataFrame(plan or [(0, 0, 0, 0, 1, 0)], "class int, low long, high long, first long, times long, slot long")
    # Ranks within a class, by buckets of bounded size.
    buckets = max(1, -(-int(histogram.max(initial=0)) // RANKED_TOGETHER))
    inside = Window.partitionBy("class", "bucket").orderBy(F.xxhash64(key, "piece"), key, "piece")
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64(F.lit(7), key, "piece"), F.lit(buckets)))
    held = bucketed.groupBy("class", "bucket").agg(F.count("*").alias("held"))
    before = held.withColumn("before", F.sum("held").over(Window.partitionBy("class").orderBy("bucket")) - F.col("held")).drop("held")
    ranked = bucketed.withColumn("r", F.row_number().over(inside) - 1).join(before, ["class", "bucket"]).withColumn("rank", F.col("r") + F.col("before"))
    # The plan has at most a few thousand rows, bounded by the classes and rounds.
    placed = ranked.join(F.broadcast(intervals), "class").filter("rank >= low and rank < high").select(
        key, "piece", "n_tokens",
        (F.col("first") + (F.col("rank") - F.col("low")) % F.col("times")).alias("sequence"),
        (F.col("slot") + F.expr("(rank - low) div times")).alias("slot"),
    )
    ahead = Window.partitionBy("sequence").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("position", F.coalesce(F.sum("n_tokens").over(ahead), F.lit(0))).drop("slot")
    nothing = known.filter("n is null or n <= 0").select(
        key, F.lit(0).alias("piece"), F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("long").alias("sequence"), F.lit(None).cast("long").alias("position")
    )
    return placed.unionByName(nothing)


def oversized(packed: DataFrame, key: str) -> DataFrame:
    """The keys of the documents that fill more than one sequence by themselves."""
    return packed.filter("piece > 0").select(key).distinct()
