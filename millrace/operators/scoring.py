"""Unit and row scores from model probabilities, risk tags, and the bounded look-back of claims."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the scoring policy.
NEUTRAL_OBSERVED, NEUTRAL_CLAIM, NO_EVIDENCE, CLAIM_FACTOR = 0.2, 0.8, 0.8, 0.5
PEAK, COVERAGE, MEAN, TAU = 0.6, 0.4, 0.1, 0.1
MARGIN_FACTOR, MARGIN_CAP = 3.0, 2.5
HISTORY, HISTORY_QUOTA, HISTORY_MOST, RECENT, FALLBACK = 8, {"O": 4, "T": 2, "C": 1}, 6, 2, 2
THEORY_SCORE, CONCLUSION_SCORE = 0.5, 0.35
TAG_WEIGHTS = {"answer_changed": 5, "label_mismatch": 5, "very_high_similarity": 3, "low_topic_overlap": 2, "length_outlier": 1}

# Phrases that mark what a unit says.
PLACEHOLDERS = ("a differential diagnosis", "differential diagnosis", "differential diagnoses", "a radiological differential diagnosis", "radiological differential diagnosis", "in the differential", "the findings", "the immunohistochemical profile", "the diagnosis was excluded")
PREPOSITIONS = ("in", "of", "because", "by", "after", "given", "since", "as")
COMPLETING = ("considered", "suspected", "excluded", "ruled out", "supported", "showed", "revealed", "demonstrated", "confirmed", "unlikely", "less likely")
TEST_NAMES = ("ct", "cta", "mri", "emg", "ncs", "ecg", "echo", "angiogram", "scan", "imaging", "biopsy", "pathology", "ultrasound", "xray")
CARRYING = ("supported", "supporting", "favored", "favoured", "less likely", "unlikely", "arguing against", "against", "not definitively", "not diagnostic", "not consistent", "consistent with", "inconsistent with")
CONSIDERED = ("considered", "suspected", "possible", "favored", "favoured")
MANAGEMENT = ("considered", "suspected", "possible", "favored", "favoured", "provisional clinical diagnosis", "was given", "ruled out", "excluded", "less likely", "unlikely", "diagnosis was")
CATALOGUE = ("can mimic", "may mimic", "other uncommon", "other differentials", "other differential", "differential diagnosis includes", "differential diagnoses include")
EXCLUSION = ("ruled out", "excluded", "less likely", "unlikely", "arguing against", "not consistent", "negative for")
EXCLUDING = ("negative", "no evidence", "without", "normal", "nondiagnostic", "did not", "absence of", "lack of", "ruled out", "excluded", "not detected")
MEASURED = ("activity", "titer", "titre", "count", "level", "ratio", "adamts13", "coombs", "rpr", "western blot", "igg", "igm")


def unit_score(kind: Column, entailment: Column, neutral: Column, contradiction: Column, evidence: Column) -> Column:
    """The defect of a unit by its kind: observation, warrant, derivation or claim; 0 for any other.

    Null probabilities count as 0.
    """
    e, n, c = (F.coalesce(x, F.lit(0.0)) for x in (entailment, neutral, contradiction))
    return (
        F.when(kind == "O", F.greatest(c, NEUTRAL_OBSERVED * n))
        .when((kind == "W") & ~evidence, F.lit(NO_EVIDENCE))
        .when(kind == "W", F.greatest(c, NEUTRAL_CLAIM * n))
        .when(kind == "D", F.greatest(c, NEUTRAL_CLAIM * n * F.when(evidence, 1.0).otherwise(CLAIM_FACTOR)))
        .when(kind == "C", F.greatest(c, CLAIM_FACTOR * NEUTRAL_OBSERVED * F.greatest(n - e, F.lit(0.0))))
        .otherwise(F.lit(0.0))
    )


def row_risk(scores: Column, mode: str = "code") -> Column:
    """Peak, share over the threshold and mean of an array of scores in one number in 0..1; 0 for an empty array.

    `code` caps the weighted sum at 1, `paper` divides it by the sum of the weights.
    """
    from millrace.functions.arrays import mean, share_over

    raw = PEAK * F.coalesce(F.array_max(scores), F.lit(0.0)) + COVERAGE * share_over(scores, TAU) + MEAN * mean(scores)
    return raw / (PEAK + COVERAGE + MEAN) if mode == "paper" else F.least(raw, F.lit(1.0))


def coverage_risk(scores: Column, covered: Column, target: Column, excused: Column) -> Column:
    """Peak, missing coverage and mean of an array of scores in one number, at most 1.

    What `covered` lacks of `target` is the penalty; half as much again, at most 1, for rows that excuse themselves by prevalence.
    """
    from millrace.functions.arrays import mean

    lacking = F.greatest(target - covered, F.lit(0.0))
    penalty = F.when(excused, F.least(F.lit(1.0), 1.5 * lacking)).otherwise(lacking)
    return F.least(PEAK * F.coalesce(F.array_max(scores), F.lit(0.0)) + COVERAGE * penalty + MEAN * mean(scores), F.lit(1.0))


def margin(risk: Column) -> Column:
    return F.least(MARGIN_FACTOR * risk, F.lit(MARGIN_CAP))


def risk_tags(similarity: Column, length_ratio: Column, topic: Column, expected: Column, actual: Column, matched: Column) -> Column:
    """The tags that hold, in fixed order; a null measure holds none."""
    rules = {
        "answer_changed": expected & ~actual,
        "label_mismatch": ~matched,
        "very_high_similarity": similarity > 0.97,
        "low_topic_overlap": topic < 0.1,
        "length_outlier": (length_ratio < 0.6) | (length_ratio > 1.5),
    }
    return F.filter(F.array(*(F.when(F.coalesce(rule, F.lit(False)), tag) for tag, rule in rules.items())), lambda x: x.isNotNull())


def tag_score(tags: Column) -> Column:
    weights = F.create_map(*(F.lit(x) for pair in TAG_WEIGHTS.items() for x in pair))
    return F.aggregate(tags, F.lit(0), lambda s, t: s + F.coalesce(F.try_element_at(weights, t), F.lit(0)))


def _has(text: str, markers: tuple[str, ...]) -> bool:
    return any(m in text.lower() for m in markers)


def _fragment(text: str, kind: str) -> bool:
    """Too little said to serve as a premise: no word, a verb at the end, a few words from a preposition on, or names of tests only."""
    low = text.lower().strip(" .;,:!?")
    words = re.findall(r"[a-z0-9']+", low)
    if not words or low in PLACEHOLDERS or re.search(r"\b(?:was|were|is|are)$", low):
        return True
    if len(words) <= 4 and words[0] in PREPOSITIONS and not _has(low, COMPLETING):
        return True
    return kind == "O" and len(words) <= 2 and all(w in TEST_NAMES for w in words)


def _concluded(text: str) -> str:
    """What a conclusion is about: the words before its verdict, without an article."""
    m = re.search(r"^(?:an?\s+|the\s+)?(.+?)\s+(?:was\s+(?:considered|suspected|favou?red|ruled out|excluded|deemed unlikely|less likely|unlikely)|(?:remains|was)\s+the most likely diagnosis)\b", text.strip(), re.I)
    m = m or re.search(r"^(?:an?\s+)?provisional clinical diagnosis of\s+['\"]?(.+?)['\"]?\s+was given\b", text.strip(), re.I)
    return re.sub(r"^(?:an?|the)\s+", "", m[1].lower().strip(" '\".,;:")) if m else ""


def premise_of(history: list[tuple[str, str, float, bool]], claim: str) -> str:
    """The premise that earlier units (kind, text, score, contradicted) give a claim, one unit a line, in their order.

    Of the last eight units, from the last one back: at most four observations, two theories (warrants and
    derivations together, score 0.5 at most) and one conclusion (score 0.35 at most, one of the last two units or
    carrying a verdict forward), six in all. Contradicted and fragmentary units don't count, nor what would let a claim about handling a
    diagnosis support itself. If none is left, the last two of any kind serve. A claim of exclusion needs a unit that excludes.
    """
    managing = _has(claim, MANAGEMENT)
    allowed = []
    for i in range(len(history) - 1, max(0, len(history) - HISTORY) - 1, -1):
        kind, text, score, contradicted = history[i]
        if kind not in "OWDC" or not text.strip() or contradicted or _fragment(text, kind):
            continue
        if score > {"W": THEORY_SCORE, "D": THEORY_SCORE, "C": CONCLUSION_SCORE}.get(kind, float("inf")):
            continue
        about = _concluded(claim)
        if kind == "C" and (about and about == _concluded(text) or managing and _has(text, MANAGEMENT)):
            continue
        if managing and (kind == "D" and _has(text, CONSIDERED) or kind == "W" and _has(text, CATALOGUE)):
            continue
        allowed.append((i, kind, text))
    left = dict(HISTORY_QUOTA)
    chosen = []
    for i, kind, text in allowed:
        pool = "T" if kind in "WD" else kind
        if kind == "C" and i < len(history) - RECENT and not _has(text, CARRYING):
            continue
        if left[pool] and len(chosen) < HISTORY_MOST:
            left[pool] -= 1
            chosen.append((i, f"[{kind}] {text}"))
    chosen = chosen or [(i, f"[{kind}] {text}") for i, kind, text in allowed[:FALLBACK]]
    if _has(claim, EXCLUSION) and not any(_has(t, EXCLUDING) or re.search(r"[<>]|\d+%|\d+\.\d+|\d+/\d+", t) and _has(t, MEASURED) for _, t in chosen):
        return ""
    return "\n".join(t for _, t in sorted(chosen))


def claim_history(units: DataFrame, key: str, pos: str, kind: str, score: str, text: str, contradicted: str | None = None) -> DataFrame:
    """(key, pos, premise) of each claim (kind C): what earlier units serve as its premise, by `premise_of`.

    Sequential within a row, which has a bounded number of units; rows are independent. Null texts and scores count as
    blank and 0.
    """
    flag = F.coalesce(F.col(contradicted), F.lit(False)) if contradicted else F.lit(False)
    own = units.select(F.col(key).alias("k"), F.col(pos).cast("int").alias("pos"), F.upper(F.substring(kind, 1, 1)).alias("kind"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("score"), F.coalesce(F.trim(text), F.lit("")).alias("text"), flag.alias("contradicted"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        history: list[tuple[str, str, float, bool]] = []
        out = []
        for r in pdf.sort_values("pos", kind="stable").itertuples():
            if r.kind == "C":
                out.append((r.k, r.pos, premise_of(history, r.text)))
            if not _fragment(r.text, r.kind or ""):
                history.append((r.kind or " ", r.text, r.score, bool(r.contradicted)))
        return pd.DataFrame(out, columns=["k", "pos", "premise"])

    key_type = own.schema["k"].dataType.simpleString()
    return own.groupBy("k").applyInPandas(walk, f"k {key_type}, pos int, premise string").withColumnRenamed("k", key)
