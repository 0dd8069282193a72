"""Problem 9: the language of each document and of each stretch of a mixed one.

Method: language-bitmask n-gram filters. A bit-sliced Bloom filter holds, in each slot, one bit for each
language; the AND of an n-gram's slots is the set of all languages that may contain it. Every position of
a text is hashed and looked up at once; for each sentence the votes of each language are counted,
corrected by its filter's rate of false positives, and the best one decides. The filters are trained
on a bounded sample of rows with a usable label, whose wrong labels the shares of documents outvote;
everything else, lookup, votes, thresholds, covers all rows and the whole of every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.llm.textarr import U64, Ngrams, arrow_fields, chunks, codepoints, mix, plain

LANGUAGES = ("en", "de", "fr", "es", "pt", "zh")

# Notations of the languages, by the part before any region.
NOTATIONS = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "es": ("es", "spa", "spanish", "español", "espanol"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "zh": ("zh", "zho", "chi", "chinese", "cmn", "中文", "mandarin"),
    "it": ("it", "ita", "italian"),
    "nl": ("nl", "nld", "dut", "dutch"),
    "sv": ("sv", "swe", "swedish"),
    "ja": ("ja", "jpn", "japanese"),
    "ko": ("ko", "kor", "korean"),
    "gl": ("gl", "glg", "galician"),
}
UNUSABLE = ("und", "unknown", "mul", "mis", "zxx", "none", "null", "n/a", "na", "xx", "unk", "multi", "multilingual", "other")

SLOTS = 1 << 20
NGRAM = 5
HASHES = 2
SAMPLE_ROWS = 1000  # labelled rows a language that the filters are fitted on


def label_language(lang: Column) -> Column:
    """Two-letter code of a label in any known notation; an unknown label as it stands; null where it names no language."""
    part = F.lower(F.trim(lang))
    part = F.regexp_replace(F.split_part(F.regexp_replace(part, "[-_ (].*$", ""), F.lit("/"), F.lit(1)), r"[^\p{L}]", "")
    known = {spelled: code for code, all_spelled in NOTATIONS.items() for spelled in all_spelled} | dict.fromkeys(UNUSABLE, "")
    codes = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.nullif(F.coalesce(F.try_element_at(codes, part), part), F.lit(""))


@dataclass
class Filters:
    """The bit-sliced filter, and for each language the share of its slots that are set."""

    slots: np.ndarray
    languages: tuple[str, ...]
    false_rate: np.ndarray


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat code points (letters only, other characters as one blank), n-gram hashes, and text starts.

    Han characters get n-grams of two, as a word is about that long.
    """
    flat, starts = codepoints(texts)
    flat = flat.copy()
    letter = _LETTER[np.minimum(flat, len(_LETTER) - 1)]
    flat[~letter] = 32
    grams = Ngrams(flat)
    h = grams.of(NGRAM)
    han = _is_han(flat)
    if han.any():
        h = np.where(han, grams.of(2), h)
    return flat, h, starts


_LETTER = np.array([chr(i).isalpha() for i in range(0x30000)])


def _is_han(flat: np.ndarray) -> np.ndarray:
    return (flat >= 0x3400) & (flat <= 0x9FFF) | (flat >= 0xF900) & (flat <= 0xFAFF)


def slots_of(h: np.ndarray) -> list[np.ndarray]:
    a = mix(h)
    return [((a >> U64(21 * i)) & U64(SLOTS - 1)).astype(np.int64) for i in range(HASHES)]


def fit_filters(texts: list[str], labels: list[str], languages: tuple[str, ...] = LANGUAGES, least: float = 0.01, against: float = 0.3) -> Filters:
    """Filters from labelled texts: a language contains the n-grams that at least the share `least` of its documents have.

    An n-gram also needs at least `against` times the share that its commonest language has, so that
    wrong labels, a minority in every language, don't carry over. No text gives empty filters. The masks are as
    wide as the number of languages asks, up to 64.
    """
    if len(languages) > 64:
        raise ValueError("at most 64 languages")
    mask = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if len(languages) <= np.iinfo(t).bits)
    keys, langs, sizes = [], [], np.zeros(len(languages))
    for text, label in zip(texts, labels):
        if label in languages:
            _, h, _ = _grams([plain(text)])
            keys.append(np.unique(h))
            langs.append(np.full(len(keys[-1]), languages.index(label)))
            sizes[languages.index(label)] += 1
    slots = np.zeros(SLOTS, dtype=mask)
    if keys:
        k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.zeros((len(k), len(languages)))
        np.add.at(count, (inverse, np.concatenate(langs)), 1)
        share = count / np.maximum(sizes, 1)
        has = (share >= least) & (count >= 2) & (share >= against * share.max(axis=1, keepdims=True))
        bits = np.bitwise_or.reduce(np.where(has, mask(1) << np.arange(len(languages)).astype(mask), mask(0)), axis=1)
        for at in slots_of(k):
            np.bitwise_or.at(slots, at, bits)
    fill = np.array([((slots >> mask(i)) & mask(1)).mean() for i in range(len(languages))])
    return Filters(slots, languages, fill**HASHES)


_STOP = re.compile(r"[.!?。！？][\"'”’»)\]]*\s*$")


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of stretches that end at closing marks followed by space or Han text, or at line ends."""
    out, start = [], 0
    for m in re.finditer(r"[.!?]+[\"'”’»)\]]*(?=\s|$|[㐀-鿿])|[。！？]+|\n+", text):
        if m.end() > start:
            out.append((start, m.end()))
            start = m.end()
    if start < len(text):
        out.append((start, len(text)))
    return [(a, b) for a, b in out if text[a:b].strip()]


def score_spans(texts: list[str], spans: list[list[tuple[int, int]]], filters: Filters) -> list[np.ndarray]:
    """For each text an array (spans, 1 + languages): letters' n-grams looked up, then corrected votes of each language."""
    out = []
    n = len(filters.languages)
    for a, b in chunks(texts):
        flat, h, starts = _grams(texts[a:b])
        mask = filters.slots[slots_of(h)[0]]
        for at in slots_of(h)[1:]:
            mask &= filters.slots[at]
        live = flat != 32
        mask[~live] = 0
        # One running count for each language; a span's votes are a difference.
        running = np.zeros((n + 1, len(flat) + 1), dtype=np.int32)
        np.cumsum(live, out=running[0, 1:])
        for i in range(n):
            np.cumsum((mask >> mask.dtype.type(i)) & mask.dtype.type(1), out=running[i + 1, 1:])
        for t in range(a, b):
            if not spans[t]:
                out.append(np.zeros((0, n + 1)))
                continue
            e = np.array(spans[t]) + starts[t - a]
            votes = (running[:, e[:, 1]] - running[:, e[:, 0]]).T.astype(np.float64)
            votes[:, 1:] = np.maximum(0, (votes[:, 1:] - votes[:, :1] * filters.false_rate) / (1 - filters.false_rate))
            out.append(votes)
    return out


def segments_of(text: str, spans: list[tuple[int, int]], votes: np.ndarray, languages: tuple[str, ...], least_letters: int = 6) -> list[tuple[int, int, str, float, int]]:
    """(start, end, language, confidence, full sentences) of the text's stretches, in order.

    A span whose votes don't tell (few letters, few known n-grams, or two languages alike) joins the
    stretch around it. Only spans that close with a full stop and have a clear language count as full
    sentences.
    """
    total = votes[:, 1:].sum(axis=0)
    best = votes[:, 1:].argmax(axis=1)
    # Ties of related languages go to the one that the text has more of.
    top = votes[np.arange(len(votes)), best + 1]
    for i in range(len(votes)):
        near = np.flatnonzero(votes[i, 1:] >= 0.97 * top[i])
        if len(near) > 1:
            best[i] = near[total[near].argmax()]
    second = np.sort(votes[:, 1:], axis=1)[:, -2] if votes.shape[1] > 2 else np.zeros(len(votes))
    sure = (votes[:, 0] >= least_letters) & (top >= 0.25 * votes[:, 0]) & (top >= 1.15 * second)
    out: list[list] = []
    for i, (a, b) in enumerate(spans):
        if not sure[i]:
            if out:
                out[-1][1] = b
            continue
        full = 1 if _STOP.search(text[max(a, b - 12) : b]) and votes[i, 0] >= 10 else 0
        if out and out[-1][2] == best[i]:
            out[-1][1], out[-1][4] = b, out[-1][4] + full
            out[-1][3] += votes[i]
        else:
            out.append([a if out else 0, b, best[i], votes[i].copy(), full])
    if out:
        out[0][0] = 0
    done = []
    for a, b, lang, v, full in out:
        rest = np.delete(v[1:], lang)
        done.append((a, b, languages[lang], float(v[lang + 1] / max(1e-9, v[lang + 1] + rest.max(initial=0))), full))
    return done


def fit_from(df: DataFrame, key: str, text: str, lang: str, rows: int = SAMPLE_ROWS) -> Filters:
    """Filters fitted on a bounded sample: at most `rows` rows a label, those whose key has the least hash, with their whole texts.

    One pass over keys and labels finds the greatest hash of each label's sample, of which every partition only passes on its
    least `rows` ones; a second pass reads the texts of the sample.
    """
    labelled = df.select(label_language(F.col(lang)).alias("l"), F.xxhash64(key).alias("h"), F.col(text).alias("t"))
    place = F.row_number().over(Window.partitionBy("l").orderBy("h"))
    most = labelled.filter(F.col("l").isin(*LANGUAGES)).select("l", "h").withColumn("place", place).filter(F.col("place") <= rows).groupBy("l").agg(F.max("h").alias("most")).collect()
    if not most:
        return fit_filters([], [])
    last = F.create_map(*(x for r in most for x in (F.lit(r.l), F.lit(r.most).cast("bigint"))))
    got = labelled.filter(F.col("h") <= F.try_element_at(last, F.col("l"))).select("l", "t").filter("t is not null").toPandas()
    return fit_filters(got["t"].tolist(), got["l"].tolist())


def detect(df: DataFrame, keys: list[str], text: str, filters: Filters) -> DataFrame:
    """keys and `segments`: array of (start, end, lang, confidence, sentences) of each text, without a shuffle.

    Null, blank and letterless texts get an empty array. Offsets are code points of the text as it is.
    Repeated rows give repeated results; columns besides the keys and the text are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(filters)
    element = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("sentences", T.IntegerType())])
    schema = T.StructType([*df.select(*keys).schema.fields, T.StructField("segments", T.ArrayType(element))])
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("sentences", pa.int32())]))
    arrow_schema = pa.schema([*arrow_fields(df.select(*keys)), ("segments", arrow)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            lower = [t.lower() if len(t.lower()) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t) for t in texts]
            spans = [sentence_spans(t) for t in texts]
            votes = score_spans(lower, spans, own)
            found = [
                [dict(zip(("start", "end", "lang", "confidence", "sentences"), s)) for s in segments_of(t, sp, v, own.languages)]
                for t, sp, v in zip(texts, spans, votes)
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(found, arrow)], schema=arrow_schema)

    return df.select(*keys, F.col(text).alias("_text")).mapInArrow(run, schema)


def document_languages(detected: DataFrame, keys: list[str], full_sentences: int = 2) -> DataFrame:
    """keys, `langs`: array of (lang, confidence) of a document: those with enough full sentences, else the main one."""
    per = F.expr(
        f"""transform(array_distinct(segments.lang), l -> struct(
            l as lang,
            aggregate(filter(segments, s -> s.lang = l), 0, (a, s) -> a + s.sentences) as sentences,
            aggregate(filter(segments, s -> s.lang = l), 0, (a, s) -> a + s.end - s.start) as chars,
            aggregate(filter(segments, s -> s.lang = l), 0D, (a, s) -> a + s.confidence * (s.end - s.start)) as weight))"""
    )
    chosen = F.expr(f"filter(per, p -> p.sentences >= {full_sentences})")
    main = F.expr("slice(array_sort(per, (a, b) -> case when a.chars <> b.chars then b.chars - a.chars when a.lang < b.lang then -1 else 1 end), 1, 1)")
    return (
        detected.withColumn("per", per)
        .withColumn("chosen", chosen)
        .withColumn("chosen", F.when(F.size("chosen") > 0, F.col("chosen")).otherwise(main))
        .select(*keys, F.expr("transform(chosen, p -> struct(p.lang as lang, p.weight / greatest(p.chars, 1) as confidence))").alias("langs"))
    )
