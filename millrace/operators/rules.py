"""Rule tables as expressions, parsing of loose fields, span repair, and the plug-in for model scores."""

from __future__ import annotations

import difflib
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.functions import text as X

# Ordered rules, the first that holds decides.
MODALITIES = ("mri", "pet", "ct", "mrcp", "ultrasound", "biopsy", "histology", "histopath", "immunohist", "endoscopy", "radiograph", "x-ray", "xray", "fna")
QUERY_RULES = (
    ("differential diagnosis", "differential diagnosis"),
    ("clinical features", "clinical features"),
    ("modality/procedure-heavy", rf"\b(?:{'|'.join(MODALITIES)})\b"),
    ("claimish", r"\b(?:was|were|is|are)\b"),
)
ROLE_RULES = (
    ("C", r"(?i)final answer|most likely diagnosis|therefore|consistent picture"),
    ("W", r"(?i)\b(?:typical|expected|usually|often|unusual|can cause)\b"),
    ("D", r"(?i)\b(?:because|points toward|argues|speaks|makes|supports|reflects|weakens)\b"),
)
META = r"(?i)\b(?:as an ai|rewritten|this rewrite|original reasoning|error type)\b"


def first_rule(text: Column, rules: tuple[tuple[str, str], ...], otherwise: str) -> Column:
    """The name of the first rule whose pattern the text matches."""
    out = F.lit(otherwise)
    for name, pattern in reversed(rules):
        out = F.when(F.coalesce(text, F.lit("")).rlike(pattern), name).otherwise(out)
    return out


def query_bucket(text: Column) -> Column:
    """What a retrieval query looks like by the first rule that holds, else `short<=3` up to three words; null for any other and for a blank one."""
    low = F.lower(X.normalize_text(text))
    short = F.when(F.size(F.split(low, r"(?U)\s+")) <= 3, "short<=3")
    named = short
    for name, pattern in reversed(QUERY_RULES):
        named = F.when(low.rlike(pattern), name).otherwise(named)
    return F.when(low != "", named)


def heuristic_checks(target: Column, source: Column, similarity: Column, same_answer: Column, expected_same: Column) -> Column:
    """The names of the failed checks of a rewrite, in fixed order; a null measure fails none."""
    ratio, new, topic = X.length_ratio(target, source), X.novelty(target, source), X.topic_overlap(target, source)
    rules = {
        "non_empty": X.normalize_text(target) != "",
        "not_identical": X.normalize_answer(target) != X.normalize_answer(source),
        "similarity": similarity.between(0.55, 0.98),
        "length_ratio": ratio.between(0.6, 1.5),
        "novelty": new <= 0.4,
        "topic_overlap": topic >= 0.03,
        "no_meta_language": ~F.coalesce(target, F.lit("")).rlike(META),
        "answer_policy": same_answer == expected_same,
    }
    return F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(True)), name) for name, ok in rules.items())), lambda x: x.isNotNull())


def high_risk(risk: Column, entailment: Column, top: Column, t: float = 0.7, low: float = 0.3, gap: float = 0.15) -> Column:
    """A risk over t, little entailment, and a clear gap between the two largest of `top`."""
    ordered = F.sort_array(top, asc=False)
    return (risk > t) & (entailment < low) & (F.try_element_at(ordered, F.lit(1)) - F.try_element_at(ordered, F.lit(2)) >= gap)


def disagreement(decision1: Column, decision2: Column, score1: Column, score2: Column) -> Column:
    """`decision` if both decide differently, `score` if the scores lie more than one apart, else null."""
    return F.when(decision1 != decision2, "decision").when(F.abs(score1 - score2) > 1, "score")


def list_field(c: Column) -> Column:
    """A list from JSON, `||` or line-separated text, or one value; blank elements are dropped, null is empty."""
    text = X.normalize_text(c)
    parsed = F.from_json(text, T.ArrayType(T.StringType()))
    parts = F.when(text.startswith("["), parsed).when(F.contains(text, F.lit("||")), F.split(text, r"\|\|")).otherwise(F.split(text, r"\n"))
    return F.filter(F.transform(F.coalesce(parts, F.array(text)), lambda x: X.strip(x)), lambda x: x != "")


@F.pandas_udf(T.StringType())
def json_object(s: pd.Series) -> pd.Series:
    """The first JSON object in a text, as compact JSON: fences dropped, from the first brace that decodes; null if none."""
    decoder = json.JSONDecoder()

    def one(t: str | None) -> str | None:
        at = t.find("{") if t else -1
        while at >= 0:
            try:
                found, _ = decoder.raw_decode(t, at)
                return json.dumps(found, sort_keys=True, ensure_ascii=False)
            except ValueError:
                at = t.find("{", at + 1)
        return None

    return s.map(one)


def last_label(text: Column, labels: str = "A-E") -> Column:
    """The option label that a response settles on: the last match of the most explicit pattern that matches."""
    patterns = (rf"(?i)final answer\s*[:：]?\s*\(?([{labels}])\b", rf"(?i)answer\s*(?:is|[:：])\s*\(?([{labels}])\b", rf"(?m)^\s*\(?([{labels}])[).:]?\s*$")
    return F.upper(F.coalesce(*(F.try_element_at(F.regexp_extract_all(text, F.lit(p), 1), F.lit(-1)) for p in patterns)))


def units_of(text: Column) -> Column:
    """Array of (start, end, role, text) of a reasoning's sentences and list lines; offsets are 0-based and half-open."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\n.!?。！？]+(?:[.!?。！？](?![\s\n]|$)[^\n.!?。！？]*)*[.!?。！？]*[ \t]*|\n+"), F.lit(0))
    ends = F.transform(pieces, lambda p, i: F.aggregate(F.slice(pieces, F.lit(1), i + 1), F.lit(0), lambda s, x: s + F.length(x)))
    spans = F.zip_with(pieces, ends, lambda p, e: F.struct((e - F.length(p)).alias("start"), e.alias("end"), first_rule(p, ROLE_RULES, "O").alias("role"), X.strip(p).alias("text")))
    return F.filter(spans, lambda s: s["text"] != "")


def patch_span(text: str, target: str, replacement: str, tolerance: int = 2, least: float = 0.78) -> str | None:
    """`text` with its best match of `target`, exact or in a window of about as many words, replaced once; null below `least`."""
    if not target:
        return None
    if target in text:
        return text.replace(target, replacement, 1)
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    n, best = len(target.split()), (least, -1, -1)
    for size in range(max(1, n - tolerance), n + tolerance + 1):
        for i in range(len(words) - size + 1):
            a, b = words[i][0], words[i + size - 1][1]
            ratio = difflib.SequenceMatcher(None, text[a:b], target).ratio()
            if ratio > best[0] or ratio == best[0] and best[1] < 0:
                best = (ratio, a, b)
    return None if best[1] < 0 else text[: best[1]] + replacement + text[best[2] :]


@F.pandas_udf(T.StringType())
def patch_spans(text: pd.Series, target: pd.Series, replacement: pd.Series) -> pd.Series:
    return pd.Series([patch_span(t, a, b) if t is not None and a and b is not None else None for t, a, b in zip(text, target, replacement)])


def align_fragments(text: str, fragments: list[str]) -> list[tuple[int, int]] | None:
    """(start, end) of all fragments in order, from a cursor that only moves on, white space flexible; null if one is missing."""
    at, out = 0, []
    for f in fragments:
        if not f.split():
            return None
        m = re.compile(r"\s+".join(map(re.escape, f.split()))).search(text, at)
        if not m:
            return None
        out.append((m.start(), m.end()))
        at = m.end()
    return out


def query_variants(text: Column, most: int = 4) -> Column:
    """Distinct retrieval queries from one text: cleaned, its content words, its longest clause; 2 to 40 tokens each."""
    clean = X.squeeze(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r'"[^"]{1,400}"', " "), r"(?i)\b(?:the patient|this case)\b", " "))
    content = F.array_join(F.filter(X.tokens(clean), lambda t: F.length(t) > 3), " ")
    clauses = F.split(clean, r"[,;]\s*")
    longest = F.element_at(F.array_sort(F.transform(clauses, lambda c, i: F.struct((-F.length(c)).alias("l"), i.alias("i"), c.alias("c")))), 1)["c"]
    kept = F.filter(F.array_distinct(F.array(clean, content, longest)), lambda v: F.size(X.tokens(v)).between(2, 40))
    return F.slice(kept, 1, most)


def priority_fill(df: DataFrame, bucket: str, order: list[str], quotas: dict[str, int], total: int, tie: list[Column]) -> DataFrame:
    """Up to the quota of each bucket, then what is left in the order of the buckets until `total` rows; `fill_rank` counts them.

    The second ranking runs over at most `total` rows a bucket, not over the table.
    """
    place = F.array_position(F.array(*map(F.lit, order)), F.col(bucket))
    quota = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in quotas.items() for x in p)), F.col(bucket)), F.lit(0))
    ranked = df.filter(F.col(bucket).isin(*order)).withColumn("_r", F.row_number().over(Window.partitionBy(bucket).orderBy(*tie))).filter(F.col("_r") <= total)
    filled = ranked.withColumn("_late", (F.col("_r") > quota).cast("int"))
    w = Window.orderBy("_late", place, "_r")
    return filled.withColumn("fill_rank", F.row_number().over(w)).filter(F.col("fill_rank") <= total).drop("_r", "_late")


def best_sentences(text: Column, query: Column, n: int = 2) -> Column:
    """The n sentences that share most words with the query, ties to the earlier one, in the order of the text."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?。！？])\s+"), lambda s: s != "")
    wanted = F.array_distinct(X.tokens(query))
    scored = F.transform(parts, lambda s, i: F.struct((-F.size(F.array_intersect(X.tokens(s), wanted))).alias("o"), i.alias("i"), s.alias("s")))
    top = F.slice(F.array_sort(scored), 1, n)
    return F.array_join(F.transform(F.array_sort(F.transform(top, lambda t: F.struct(t["i"].alias("i"), t["s"].alias("s")))), lambda t: t["s"]), " ")


def score_pairs(pairs: DataFrame, keys: list[str], premise: str, claim: str, model: Callable[[], Callable[[list[str], list[str]], list[tuple[float, float, float]]]]) -> DataFrame:
    """(keys, entailment, neutral, contradiction) of each pair with text on both sides, by any model.

    `model` is called once a task and gives a function from two lists of texts to probabilities; rows are
    keyed, so that the order in which batches end doesn't matter. Blank pairs give no row.
    """
    own = pairs.select(*keys, F.col(premise).alias("_p"), F.col(claim).alias("_c")).filter("trim(_p) <> '' and trim(_c) <> ''")
    schema = T.StructType([*own.drop("_p", "_c").schema.fields, *(T.StructField(n, T.DoubleType()) for n in ("entailment", "neutral", "contradiction"))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = model()
        for pdf in batches:
            got = pd.DataFrame(score(pdf["_p"].tolist(), pdf["_c"].tolist()), columns=["entailment", "neutral", "contradiction"])
            yield pd.concat([pdf[keys].reset_index(drop=True), got], axis=1)

    return own.mapInPandas(run, schema)


def overlap_stub() -> Callable[[list[str], list[str]], list[tuple[float, float, float]]]:
    """A deterministic stand-in for a model: entailment is the share of the claim's words that the premise has."""

    def score(premises: list[str], claims: list[str]) -> list[tuple[float, float, float]]:
        out = []
        for p, c in zip(premises, claims):
            words = set(c.lower().split())
            e = len(words & set(p.lower().split())) / max(1, len(words))
            out.append((e, (1 - e) * 0.75, (1 - e) * 0.25))
        return out

    return score
