"""Character spans: overlap, containment, matching, alignment and token masks."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def locate(text: Column, span: Column) -> Column:
    """0-based half-open (start, end) of the first occurrence; null where there is none or the span is empty."""
    at = F.instr(text, span) if isinstance(span, str) else F.call_function("locate", span, text)
    found = (at > 0) & (F.length(span) > 0)
    return F.when(found, F.struct((at - 1).alias("start"), (at - 1 + F.length(span)).alias("end")))


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap over hull of two half-open spans; 0 for disjoint or empty ones."""
    inner = F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0))
    hull = F.greatest(e1, e2) - F.least(s1, s2)
    return F.coalesce(F.try_divide(inner.cast("double"), hull.cast("double")), F.lit(0.0))


def drop_contained(df: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """Spans without those that lie inside an earlier starting or longer one of their group; equal ones stay once.

    A running maximum of the ends in the order of start and length replaces the self-join.
    """
    once = df.dropDuplicates([group, start, end])
    w = Window.partitionBy(group).orderBy(F.col(start), F.col(end).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return once.withColumn("_m", F.max(end).over(w)).filter(F.col("_m").isNull() | (F.col("_m") < F.col(end))).drop("_m")


def token_mask(text: Column, spans: Column, alpha: float = 1.0, background: float = 0.1) -> Column:
    """A weight for each white-space token: 1 + alpha * the score of the span that its middle lies in, else `background`.

    `spans` is an array of (start, end, score).
    """
    words = F.split(text, " ")
    ends = F.transform(words, lambda w, i: F.aggregate(F.slice(words, F.lit(1), i + 1), F.lit(0), lambda s, x: s + F.length(x) + 1) - 1)
    mids = F.zip_with(words, ends, lambda w, e: e - F.length(w) / 2.0)
    best = lambda m: F.array_max(F.transform(F.filter(spans, lambda s: (s["start"] <= m) & (m < s["end"])), lambda s: s["score"]))
    return F.transform(mids, lambda m: F.coalesce(1 + alpha * best(m), F.lit(background)))


@F.pandas_udf(T.DoubleType())
def sequence_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio of matching blocks of two texts (Ratcliff-Obershelp); 0 if either is null."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else 0.0 for x, y in zip(a, b)])


def bipartite_match(df: DataFrame, item: str, gold: str, predicted: str) -> DataFrame:
    """(item, n_matched): the size of a maximum matching of the admissible pairs of each item.

    Items are independent and have a bounded number of spans; augmenting paths run within one.
    """
    own = df.select(F.col(item).alias("item"), F.col(gold).alias("g"), F.col(predicted).alias("p"))

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        links: dict = {}
        for g, p in zip(pdf["g"], pdf["p"]):
            links.setdefault(g, []).append(p)
        owner: dict = {}

        def place(g, seen: set) -> bool:
            for p in links[g]:
                if p not in seen:
                    seen.add(p)
                    if p not in owner or place(owner[p], seen):
                        owner[p] = g
                        return True
            return False

        n = sum(place(g, set()) for g in sorted(links, key=lambda g: len(links[g])))
        return pd.DataFrame({"item": pdf["item"].head(1), "n_matched": [n]})

    kind = own.schema["item"].dataType.simpleString()
    return own.groupBy("item").applyInPandas(match, f"item {kind}, n_matched int").withColumnRenamed("item", item)


