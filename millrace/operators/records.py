"""Rows of many origins in one form: field aliases, evidence of several shapes, ids, answers, and flags within a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.functions import text as X

# The names under which a field can stand, in order of preference.
ALIASES = {
    "id": ("id", "question_id", "sample_id", "example_id", "uid", "source_id"),
    "prompt": ("patient_context", "case_prompt", "question", "prompt", "input", "context"),
    "reasoning": ("reasoning", "negative_reasoning", "predicted_reasoning", "diagnostic_reasoning"),
    "final_answer": ("negative_final_answer", "predicted_answer_text", "final_answer", "answer"),
    "gold_answer": ("gold_answer", "correct_answer_text", "reference_answer", "target_answer"),
}
RESPONSES = ("response", "output", "completion")
TRUNCATED = "\n\n[...patient context truncated for span extraction...]\n\n"


def aliased(df: DataFrame, field: str, override: str | None = None) -> Column:
    """The first non-empty one of the field's names that the table has; "" where none is."""
    names = [override] if override else [n for n in ALIASES[field] if n in df.columns]
    return F.coalesce(X.first_non_empty(*map(F.col, names)), F.lit("")) if names else F.lit("")


def canonical_rows(df: DataFrame, model_id: str, overrides: dict[str, str] | None = None, response: str | None = None) -> DataFrame:
    """(id, model_id, prompt, reasoning, final_answer, gold_answer, raw) of rows whatever their fields are called.

    Reasoning and answer that stand in no field of their own come out of the response, split at its answer line.
    `raw` is the whole row as JSON. Missing fields are "". A table without any id gets the place of the row in
    the order of its JSON, so that the id doesn't depend on partitions.
    """
    own = overrides or {}
    responses = [response] if response else [n for n in RESPONSES if n in df.columns]
    parts = X.response_parts(F.coalesce(X.first_non_empty(*map(F.col, responses)), F.lit(""))) if responses else F.struct(F.lit("").alias("reasoning"), F.lit("").alias("final_answer"))
    get = lambda f: aliased(df, f, own.get(f))
    or_part = lambda f: F.coalesce(F.nullif(get(f), F.lit("")), parts[f], F.lit(""))
    out = df.select(
        get("id").alias("id"), F.lit(model_id).alias("model_id"), get("prompt").alias("prompt"), or_part("reasoning").alias("reasoning"),
        or_part("final_answer").alias("final_answer"), get("gold_answer").alias("gold_answer"), F.to_json(F.struct("*")).alias("raw"),
    )
    if own.get("id") or any(n in df.columns for n in ALIASES["id"]):
        return out
    return out.withColumn("id", (F.row_number().over(Window.orderBy("raw")) - 1).cast("string"))


def build_response(reasoning: Column, answer: Column) -> Column:
    """Reasoning, a blank line, and the answer line; only the one that isn't blank where one is."""
    r, a = X.normalize_text(reasoning), X.normalize_text(answer)
    return F.concat_ws("\n\n", F.nullif(r, F.lit("")), F.when(a != "", F.concat(F.lit("Final Answer: "), a)))


def ordered_concat(parts: Column, separator: str = "\n") -> Column:
    """The distinct non-blank texts of an array, trimmed, in the order of their first place; "" for null."""
    kept = F.filter(F.transform(F.coalesce(parts, F.array().cast("array<string>")), X.normalize_text), lambda x: x != "")
    return F.array_join(F.array_distinct(kept), separator)


def evidence_texts(df: DataFrame, column: str, field: str = "text") -> Column:
    """The non-blank texts of evidence in any shape: array of texts, array of structs, struct, or text."""
    kind = df.schema[column].dataType
    c = F.col(column)
    if isinstance(kind, T.ArrayType):
        items = F.transform(c, lambda x: x[field]) if isinstance(kind.elementType, T.StructType) else c
    else:
        items = F.array(c[field] if isinstance(kind, T.StructType) else c)
    clean = F.transform(F.coalesce(items.cast("array<string>"), F.array().cast("array<string>")), X.normalize_text)
    return F.filter(clean, lambda x: x != "")


def answer_match(gold_label: Column, predicted_label: Column, gold: Column, predicted: Column) -> Column:
    """(method, exact_match): by choice label where both are there, else by normalised text, else unavailable and null."""
    g, p = F.upper(X.normalize_text(gold_label)), F.upper(X.normalize_text(predicted_label))
    a, b = X.normalize_text(gold), X.normalize_text(predicted)
    labels, texts = (g != "") & (p != ""), (a != "") & (b != "")
    return F.struct(
        F.when(labels, "choice_label").when(texts, "normalized_text").otherwise("none").alias("method"),
        F.when(labels, g == p).when(texts, X.normalize_answer(gold) == X.normalize_answer(predicted)).alias("exact_match"),
    )


def slug(c: Column) -> Column:
    """Lower case, everything but letters and digits as single dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(X.normalize_text(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def format_fraction(numerator: Column, denominator: Column) -> Column:
    """`n/d (p%)` with the percentage rounded half up to one digit, exactly; n/a for no denominator."""
    share = F.round(F.lit(100).cast("decimal(18,0)") * numerator.cast("decimal(18,0)") / F.nullif(denominator.cast("decimal(18,0)"), F.lit(0)), 1)
    shown = F.concat(numerator.cast("string"), F.lit("/"), denominator.cast("string"), F.lit(" ("), share.cast("decimal(18,1)").cast("string"), F.lit("%)"))
    return F.coalesce(shown, F.lit("n/a"))


def head_and_tail(c: Column, limit: int, mark: str = TRUNCATED) -> Column:
    """At most `limit` characters of a text, half from its beginning and half from its end, with a mark between."""
    head = limit // 2
    cut = F.concat(F.rtrim(F.substring(c, 1, head)), F.lit(mark), F.ltrim(F.right(c, F.lit(limit - head))))
    return F.when(F.length(c) > limit, cut).otherwise(c)


def any_match(candidates: Column, targets: Column, least: float = 0.8) -> Column:
    """Whether any candidate text matches any target with the score `least` or more."""
    return F.exists(candidates, lambda c: F.exists(targets, lambda t: X.match_score(c, t) >= least))


def winner(items: Column, score, length, least: float = 1.0) -> Column:
    """The place of the item with the greatest score, then length, then the first; null where none has the score `least`."""
    ranked = F.transform(items, lambda x, i: F.struct(score(x).cast("double").alias("s"), length(x).alias("n"), (-i).alias("at")))
    best = F.array_max(F.filter(ranked, lambda r: r["s"] >= least))
    return -best["at"]


def with_terminal(df: DataFrame, items: str) -> DataFrame:
    """One row an item with its place and whether it is the row's last; rows without items are left out."""
    rest = [c for c in df.columns if c != items]
    return df.select(*rest, F.size(items).alias("_n"), F.posexplode(items).alias("place", "item")).withColumn("terminal", F.col("place") == F.col("_n") - 1).drop("_n")


def split_by_length(df: DataFrame, column: str, most: int, recorded: DataFrame | None = None, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows within the limit, longer ones that `recorded` hasn't yet); null is within."""
    over = F.coalesce(F.length(column) > most, F.lit(False))
    long = df.filter(over).withColumn("length", F.length(column))
    return df.filter(~over), long if recorded is None else long.join(recorded.select(key).distinct(), key, "left_anti")
