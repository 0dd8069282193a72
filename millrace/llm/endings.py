"""Problem 4: texts that break off before they are complete.

Method: a backward character n-gram model. The context of a text's end, its last 4 to 64 characters,
is looked up among all places of all texts: how often does a text end right after it, and how often
does it go on? At the longest context with enough evidence the log-odds of end against continuation
decide, with a threshold for each language and column.

Training takes two passes. The first counts the final contexts of all texts (one row a text and order).
The second counts how often those contexts are followed by more text: a bitmap of fixed size of the
hashes seen in the first pass goes to all tasks, which hash every position of every text at once and
count what the bitmap lets through; exact counts by 64-bit hash follow from a grouped sum, so that the
bitmap only saves work. All texts are read in full, nothing is sampled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.sentences import ABBREVIATIONS
from millrace.llm.textarr import HAN, Rolling, arrow_fields, chunks, codepoints
from millrace.session import cut_lineage

ORDERS = (64, 48, 32, 24, 16, 12, 8, 4)
BITMAP_BITS = 1 << 23
#: So many last characters are looked at; the longest context and all marks fit.
TAIL = 400

# What marks a cut, and what may follow a complete text.
CUT_MARKS = re.compile(
    r"(?:\s*(?:\.{3}|…|\[?(?:text )?(?:shortened|truncated|cut)\]|\[text shortened\]|\((?:cut|truncated|continued|more)\)|<\.\.\.>|\[\.\.\.\]|\[…\]"
    r"|-{1,2} ?more ?-{1,2}|\(?read more\)?|[>→]{2,}))+\s*$",
    re.I,
)
BROKEN = re.compile(r"(?:\ufffd+|&(?:#x?[0-9a-f]*|[a-z]{0,7})|(?:%[0-9a-f]{2})*%[0-9a-f]{1,2})$", re.I)
FURNITURE = re.compile(r"(?:\s*(?:\[\d+(?:[,;\-–]\s*\d+)*\]|\[ref \d+\]|\(see (?:table|figure) \d+\)|\n- end of passage|\nsource: [^\n]{1,60}))+\s*$", re.I)
_TERMINAL = re.compile(r"[.!?。！？]+[\"'”’»)\]}」』）】]*$")
_HAN = re.compile(f"[{HAN}]")


def language_of(text: str) -> str:
    """`zh` or `latin`, by the share of Han characters: the groups that get a threshold each."""
    if text.isascii():
        return "latin"
    return "zh" if len(_HAN.findall(text)) * 4 > len(text) else "latin"


def context_of(text: str) -> tuple[str, bool]:
    """The last characters up to the text's end without marks of a cut, and whether it broke inside a character or entity.

    A cut mark is not the end itself: what stands before it decides.
    """
    body = text[-TAIL:].rstrip()
    if not body:
        body = text.rstrip()[-TAIL:]
    stripped = body[:-48] + CUT_MARKS.sub("", body[-48:])  # no mark is longer
    whole = stripped[:-24] + BROKEN.sub("", stripped[-24:])
    broken = len(whole) < len(stripped)
    return whole.rstrip(), broken


def closed(body: str) -> bool | None:
    """Whether a sentence ends here for sure (True), can't (False), or the model must tell (None)."""
    if FURNITURE.search(body[-120:]):
        return True
    m = _TERMINAL.search(body[-12:])
    if not m:
        return False if re.search(r"[,，、;；:：(（\[/\-–—]$", body) else None
    if m[0][0] != ".":
        return True
    head = body[: len(body) - len(m[0])]
    word = re.search(r"[^\W_]+$", head[-24:])
    if word and word[0].lower() in ABBREVIATIONS:
        return False
    if word and word[0].isdigit() and len(m[0]) == 1:
        line = head[head.rfind("\n") + 1 :].strip()
        return False if line == word[0] else None
    return True


def _folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array with room for the longest context before each, all digits alike, and their starts."""
    flat, starts = codepoints(["\n" * max(ORDERS) + t for t in texts])
    flat = flat.copy()
    flat[(flat >= 48) & (flat <= 57)] = 57
    return flat, starts


def _seed(group: str | None, lang: str) -> int:
    """What keeps the counts of languages and columns apart."""
    return xxhash.xxh3_64_intdigest(f"{group}\0{lang}")


def _final_hashes(bodies: list[str], seeds: list[int]) -> list[list[int]]:
    """For each text the hashes of its last n characters, for all orders; shorter texts have fewer."""
    out = []
    own = np.array(seeds, dtype=np.uint64)
    for a, b in chunks(bodies):
        flat, starts = _folded([t[-max(ORDERS) :] for t in bodies[a:b]])
        grams = Rolling(flat)
        last = starts[1:] - 2
        out.append(np.stack([grams.of(n, last) ^ np.uint64(n) ^ own[a:b] for n in ORDERS], axis=1).view(np.int64))
    return np.concatenate(out).tolist() if out else []


def final_contexts(df: DataFrame, keys: list[str], group: str, text: str) -> DataFrame:
    """For each non-blank text: keys, group (language added), `state`, and the hashes of its final context."""
    schema = df.select(*keys, group).schema.add("lang", "string").add("state", "string").add("contexts", T.ArrayType(T.LongType()))
    names = [f.name for f in schema.fields[: len(keys) + 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, langs, states = [], [], []
            for t in batch.column("_text").to_pylist():
                body, broken = context_of(t)
                done = closed(body)
                bodies.append(body)
                langs.append(language_of(t[-TAIL:]))
                states.append("broken" if broken else "closed" if done else "open" if done is None else "cut")
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(langs), pa.array(states), pa.array(_final_hashes(bodies, [_seed(g, x) for g, x in zip(batch.column(group).to_pylist(), langs)]), pa.list_(pa.int64()))],
                schema=batch_schema,
            )

    batch_schema = pa.schema([*arrow_fields(df.select(*keys, group)), ("lang", pa.string()), ("state", pa.string()), ("contexts", pa.list_(pa.int64()))])
    return df.select(*keys, group, F.col(text).alias("_text")).filter(r"_text rlike '(?U)\\S'").mapInArrow(run, schema)


def _bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """A bitmap of fixed size (1 MB) with the hashes of `column`; a full one lets all through, which costs time only."""
    words = (
        hashes.select(F.pmod(F.col(column), F.lit(BITMAP_BITS)).cast("int").alias("b"))
        .groupBy(F.shiftright("b", 6).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, b % 64)")).alias("bits"))
        .toPandas()
    )
    out = np.zeros(BITMAP_BITS // 64, dtype=np.int64)
    out[words["w"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64)
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def continuations(df: DataFrame, group: str, text: str, wanted: np.ndarray) -> DataFrame:
    """(h, n): how often each context that the bitmap knows is followed by more text, over all texts of its column and language.

    White space after a full stop and any line break are neither end nor continuation.
    """
    shared = df.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.unpackbits(shared.value).view(bool)
        pending: list[np.ndarray] = []
        held = 0
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            seeds = np.array([_seed(g, language_of(t[-TAIL:])) for g, t in zip(batch.column("_group").to_pylist(), texts)], dtype=np.uint64)
            for a, b in chunks(texts):
                flat, starts = _folded(texts[a:b])
                grams = Rolling(flat)
                following = np.append(flat[1:], 0)
                stop = (flat == 46) | (flat == 0x3002)
                space = following == 32
                goes_on = (flat != 10) & (flat != 0) & (following != 0) & (following != 10) & (following != 13) & ~(stop & space)
                at = np.flatnonzero(goes_on)
                own = np.repeat(seeds[a:b], np.diff(starts))
                for n in ORDERS[::-1]:
                    h = grams.of(n, at) ^ np.uint64(n) ^ own[at]
                    ok = keep[(h & np.uint64(BITMAP_BITS - 1)).view(np.int64)]
                    pending.append(h[ok])
                    held += len(pending[-1])
                    at = at[ok]  # a context that no text ends with has no longer one that does
                if held > 1 << 21:
                    u, c = np.unique(np.concatenate(pending), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], ["h", "n"])
                    pending, held = [], 0
        if held:
            u, c = np.unique(np.concatenate(pending), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], ["h", "n"])

    counts = df.select(F.col(group).cast("string").alias("_group"), F.col(text).alias("_text")).filter("_text is not null").mapInArrow(run, "h bigint, n bigint")
    return counts.groupBy("h").agg(F.sum("n").alias("n"))


def fit_thresholds(scored: DataFrame, group: str, least: int = 200) -> dict[tuple[str, str], float]:
    """For each (group, lang) the log-odds between -2 and 2 around which the fewest texts lie; the one next to 0 of several.

    Ends and cuts make two heaps with a valley between. With fewer texts than `least` it is 0, end and continuation equally likely.
    Only a histogram by column and language reaches the driver.
    """
    bins = scored.groupBy(F.col(group).alias("g"), "lang", F.round(F.greatest(F.least(F.col("odds"), F.lit(8.0)), F.lit(-8.0)) * 4).cast("int").alias("b")).count().collect()
    heaps: dict[tuple[str, str], np.ndarray] = {}
    for r in bins:
        heaps.setdefault((r.g, r.lang), np.zeros(65))[r.b + 32] += r["count"]
    places = sorted(range(-8, 9), key=abs)
    return {k: min(places, key=lambda b: h[b + 30 : b + 35].sum()) / 4 if h.sum() >= least else 0.0 for k, h in heaps.items()}


def judge_endings(df: DataFrame, keys: list[str], group: str, text: str, support: int = 6, thresholds: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """For each non-blank text: keys, group, lang, `odds` (log-odds of end against continuation) and `truncated`.

    A text is truncated if it breaks inside a character or entity, or ends where a sentence can't; texts
    that close with a full stop or with known furniture are complete; for the others the log-odds at the
    longest context seen at least `support` times, in other texts than its copies, decide. Without such a
    context, the counts at the shortest one and the odds among the supported texts of the same group and
    language do. `thresholds` has the log-odds below which a
    text counts as truncated, by (group, lang); where it names none, `fit_thresholds` does. Null and blank texts give no row, an empty table none; repeated rows of the same keys give one
    row; only the named columns are read.
    """
    finals = cut_lineage(final_contexts(df, keys, group, text).dropDuplicates([*keys, group]))
    asked = finals.filter("state = 'open'")
    # Copies are one piece of evidence: the longest context stands for the text's end.
    tails = finals.select(F.try_element_at("contexts", F.lit(1)).alias("tail"), "contexts").dropDuplicates(["tail"])
    ends = tails.select(F.explode("contexts").alias("h")).groupBy("h").agg(F.count("*").alias("ended"))
    wanted = _bitmap(asked.select(F.explode("contexts").alias("h")), "h")
    going = continuations(df.select(group, text).distinct(), group, text, wanted)
    need = asked.select(F.explode("contexts").alias("h")).distinct()
    model = need.join(ends, "h", "left").join(going, "h", "left").select("h", F.coalesce("ended", F.lit(0)).alias("ended"), F.coalesce("n", F.lit(0)).alias("went_on"))
    scored = (
        asked.select(*keys, group, "lang", F.posexplode("contexts").alias("pos", "h"))
        .join(model, "h")
        .withColumn("ended", F.greatest(F.col("ended") - 1, F.lit(0)))  # the text's own end and its copies' tell nothing
        .withColumn("fits", (F.col("ended") + F.col("went_on") >= support))
        .groupBy(*keys, group, "lang")
        .agg(
            F.min_by(F.struct("ended", "went_on"), F.when(F.col("fits"), F.col("pos")).otherwise(200 - F.col("pos"))).alias("at"),
            F.max("fits").alias("fits"),
        )
        .withColumn("odds", F.log((F.col("at.ended") + 0.5) / (F.col("at.went_on") + 0.5)))
    )
    scored = cut_lineage(scored)
    # Without enough evidence: the shortest context's counts, and the odds among the supported open texts of its kind.
    prior = scored.filter("fits").groupBy(F.col(group).alias("_g"), F.col("lang").alias("_l")).agg(F.log((F.count_if(F.col("odds") >= 0) + 0.5) / (F.count_if(F.col("odds") < 0) + 0.5)).alias("_prior"))
    scored = scored.join(F.broadcast(prior), F.col(group).eqNullSafe(F.col("_g")) & (F.col("lang") == F.col("_l")), "left").select(
        *keys, group, "lang", F.when(F.col("fits"), F.col("odds")).otherwise(F.col("odds") + F.coalesce("_prior", F.lit(0.0))).alias("odds"), "at"
    )
    known = finals.filter("state <> 'open'").select(
        *keys, group, "lang", F.when(F.col("state") == "closed", F.lit(float("inf"))).otherwise(F.lit(float("-inf"))).alias("odds"),
        F.lit(None).cast(scored.schema["at"].dataType).alias("at"),
    )
    both = known.unionByName(scored)
    least = F.lit(0.0)
    for (g, lang), value in (fit_thresholds(scored, group) | (thresholds or {})).items():
        least = F.when(F.col(group).eqNullSafe(F.lit(g)) & (F.col("lang") == lang), float(value)).otherwise(least)
    return both.withColumn("truncated", F.col("odds") < least)
