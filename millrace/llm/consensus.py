"""Problem 6: a consensus from the labels of several annotators who disagree.

Method: a mean-field variational confusion model. Each item has a hidden class; each annotator has, for
each class, a distribution over the decisions and one over the scores that they give. All distributions
have Dirichlet priors; the updates of the items' posteriors and of the annotators' parameters alternate,
the expectations of the logarithms being differences of digammas. Equal ratings of an item are counted once with their
number and laid out by item; an update of items is a sum over that layout, an update of annotators a grouped sum
with partial aggregation, of which one row an annotator remains. Only these are written between rounds, so that the
plan of a round doesn't grow; rounds end when no annotator's expected counts move by more than a tolerance.

An item can so get another decision than the majority's: annotators who invert, lean, repeat themselves or
guess are recognised by their own distributions and count accordingly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import cut_lineage

DECISIONS = ("accept", "minor_revision", "reject")
SCORES = (1, 2, 3, 4, 5)
MOST_ROUNDS, TOLERANCE = 200, 1e-3  # of the greatest change of an expected count, as a share of the annotator's ratings
DRAWS = 4000  # of a posterior, for its quantiles
BROADCAST_ROWS = 100_000  # annotators up to which their table is sent to all tasks
PRIOR_CLASS, PRIOR_OWN, PRIOR_OTHER, PRIOR_SCORE = 1.0, 1.5, 0.5, 1.0


def decision_of(spelled: Column) -> Column:
    """accept, minor_revision or reject in any case, spacing and separator; null for anything else."""
    key = F.regexp_replace(F.lower(F.regexp_replace(spelled, r"(?U)^\s+|\s+$", "")), r"[-_\s]+", "_")
    return F.when(key.isin(*DECISIONS), key)


def score_of(spelled: Column) -> Column:
    """1 to 5 from spellings such as `4`, ` 4`, `4.0` and `4/5`; null for anything else."""
    return F.regexp_extract(F.coalesce(spelled, F.lit("")), r"^\s*([1-5])(?:\.0+)?(?:\s*/\s*5)?\s*$", 1).try_cast("int")


def ratings(df: DataFrame, item: str = "id", sequence: str = "review_round", sides: tuple[str, ...] = ("reviewer1", "reviewer2")) -> DataFrame:
    """(item, reviewer, decision, score): each readable rating once.

    A row of an item and round that was delivered twice counts once; a side without reviewer, or with
    neither a readable decision nor a score, gives no rating. A reviewer who rates an item in several
    rounds has several ratings. Only the named columns are read.
    """
    side = lambda s: F.struct(
        F.regexp_replace(F.col(f"{s}_id"), r"(?U)^\s+|\s+$", "").alias("reviewer"), decision_of(F.col(f"{s}_final_decision")).alias("decision"), score_of(F.col(f"{s}_clinical_plausibility")).alias("score")
    )
    long = df.select(F.col(item).alias("item"), F.col(sequence).alias("round"), F.inline(F.array(*map(side, sides))))
    return long.filter("item is not null and reviewer <> '' and (decision is not null or score is not null)").dropDuplicates(["item", "round", "reviewer"]).drop("round")


def digamma(x: np.ndarray) -> np.ndarray:
    """The digamma function of positive numbers, to about 1e-10: recurrence up to x + 6, then the asymptotic series."""
    x = np.asarray(x, dtype=np.float64)
    y = x + 6
    return np.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) - sum(1 / (x + i) for i in range(6))


_CELLS = [(kind, label, k) for kind, labels in (("d", DECISIONS), ("s", SCORES)) for label in labels for k in range(len(DECISIONS))]


def _cell(kind: str, label: str | int, k: int) -> str:
    return f"{kind}_{label}_{k}"


def _prior(kind: str, label: str | int, k: int) -> float:
    if kind == "s":
        return PRIOR_SCORE
    return PRIOR_OWN if label == DECISIONS[k] else PRIOR_OTHER


def _expectations(counts: pd.DataFrame) -> pd.DataFrame:
    """reviewer, said, gave: for each label and class, labels first, the expected log probability of the label under the class."""
    out = {"reviewer": counts["reviewer"]}
    for name, kind, labels in (("said", "d", DECISIONS), ("gave", "s", SCORES)):
        cells = np.stack([[counts[_cell(kind, x, k)].to_numpy(dtype=np.float64) + _prior(kind, x, k) for k in range(len(DECISIONS))] for x in labels])
        out[name] = (digamma(cells) - digamma(cells.sum(axis=0))).reshape(len(labels) * len(DECISIONS), len(counts)).T.tolist()
    return pd.DataFrame(out)


class Consensus:
    """What the model has after its last round."""

    def __init__(self, rated: DataFrame, posteriors: DataFrame, counts: DataFrame) -> None:
        self.rated = rated  # item, reviewer, decision, score, n
        self.posteriors = posteriors  # item, q0, q1, q2
        self.counts = counts  # reviewer and its expected counts

    def items(self) -> DataFrame:
        """(item, decision, confidence, score, n_reviewers): the consensus of each item with a readable decision.

        The score is the mean of the item's scores, weighted by how far each reviewer's reliability lies
        above guessing; of equal posteriors the more lenient decision wins. Items with scores only have no
        decision and are not listed.
        """
        trust = self.reviewers().select("reviewer", F.greatest(F.col("reliability") - 1 / len(DECISIONS), F.lit(0.01)).alias("trust"))
        per = self.rated.join(trust, "reviewer").groupBy("item").agg(
            (F.sum(F.col("score") * F.col("trust") * F.col("n")) / F.sum(F.when(F.col("score").isNotNull(), F.col("trust") * F.col("n")))).alias("score"),
            F.count_distinct(F.when(F.col("decision").isNotNull(), F.col("reviewer"))).alias("n_reviewers"),
        ).join(self.posteriors, "item")
        best = F.array_max(F.array(*(F.struct(F.round(F.col(f"q{k}"), 12).alias("q"), F.lit(-k).alias("k")) for k in range(3))))
        return per.filter("n_reviewers > 0").withColumn("best", best).select(
            "item", F.element_at(F.array(*map(F.lit, DECISIONS)), 1 - F.col("best.k")).alias("decision"), F.col("best.q").alias("confidence"), "score", "n_reviewers"
        )

    def reviewers(self) -> DataFrame:
        """(reviewer, n_ratings, reliability, low, high): the posterior chance of a right decision and its 2.5 % and 97.5 % quantiles.

        The chance is the sum over the classes of share times rate, a Dirichlet and Beta variables; its quantiles are
        those of DRAWS seeded draws an annotator.
        """
        n = len(DECISIONS)
        own = [(F.col(_cell("d", DECISIONS[k], k)) + PRIOR_OWN).alias(f"own{k}") for k in range(n)]
        rest = [(reduce(lambda a, b: a + b, (F.col(_cell("d", d, k)) for j, d in enumerate(DECISIONS) if j != k)) + (n - 1) * PRIOR_OTHER).alias(f"rest{k}") for k in range(n)]
        rated = reduce(lambda a, b: a + b, (F.col(_cell("d", d, k)) for d in DECISIONS for k in range(n)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for r in pdf.itertuples(index=False):
                    draw = np.random.default_rng(xxhash.xxh3_64_intdigest(r.reviewer))
                    a, b = (np.array([getattr(r, f"{s}{k}") for k in range(n)]) for s in ("own", "rest"))
                    chance = (draw.dirichlet(a + b, DRAWS) * draw.beta(a, b, (DRAWS, n))).sum(axis=1)
                    out.append((r.reviewer, round(r.n_ratings), float(((a + b) / (a + b).sum() * a / (a + b)).sum()), *map(float, np.quantile(chance, [0.025, 0.975]))))
                yield pd.DataFrame(out, columns=["reviewer", "n_ratings", "reliability", "low", "high"])

        return self.counts.select("reviewer", rated.alias("n_ratings"), *own, *rest).mapInPandas(run, "reviewer string, n_ratings long, reliability double, low double, high double")


_NAMES = [_cell(*c) for c in _CELLS]


class _Counts:
    """The annotators' expected counts: in the driver where they are few, else written to the checkpoint folder."""

    def __init__(self, computed: DataFrame, few: bool) -> None:
        self.few = few
        self.rows = computed.toPandas().sort_values("reviewer", ignore_index=True) if few else None
        self.frame = computed.sparkSession.createDataFrame(self.rows, computed.schema) if few else cut_lineage(computed)

    def expectations(self) -> DataFrame:
        schema = "reviewer string, said array<double>, gave array<double>"
        if self.few:
            return F.broadcast(self.frame.sparkSession.createDataFrame(_expectations(self.rows), schema))
        return self.frame.mapInPandas(lambda parts: map(_expectations, parts), schema)

    def sizes(self) -> np.ndarray:
        """The expected number of decisions of each class."""
        own = [[_cell("d", d, k) for d in DECISIONS] for k in range(len(DECISIONS))]
        if self.few:
            return np.array([self.rows[c].to_numpy(dtype=np.float64).sum() for c in own])
        row = self.frame.agg(*(F.sum(reduce(lambda a, b: a + b, map(F.col, c))).alias(str(k)) for k, c in enumerate(own))).first()
        return np.array([float(x or 0.0) for x in row])

    def moved_from(self, before: _Counts) -> float:
        """The greatest change of a count, as a share of the annotator's ratings."""
        if self.few:
            a, b = (x.rows[_NAMES].to_numpy(dtype=np.float64) for x in (self, before))
            return float((np.abs(a - b).max(axis=1) / (a.sum(axis=1) + 1)).max()) if len(a) else 0.0
        old = before.frame.select("reviewer", *(F.col(c).alias(f"{c}_before") for c in _NAMES))
        change = F.greatest(*(F.abs(F.col(c) - F.col(f"{c}_before")) for c in _NAMES)) / (reduce(lambda a, b: a + b, map(F.col, _NAMES)) + 1)
        return float(self.frame.join(old, "reviewer").agg(F.max(change).alias("x")).first().x or 0.0)


def fit(rated: DataFrame, rounds: int = MOST_ROUNDS, tolerance: float = TOLERANCE) -> Consensus:
    """Alternate both updates from the shares of each item's own labels until they settle, at most `rounds` times.

    A table without ratings gives an empty result. Repeated rows must be gone (`ratings` does that); ties
    stay undecided between the classes in proportion. An item with very many ratings has one row for each
    different one.
    """
    n = len(DECISIONS)
    layout = cut_lineage(rated.groupBy("item", "reviewer", "decision", "score").agg(F.count("*").alias("n")).repartition("item"))
    place = lambda column, labels: F.array_position(F.array(*map(F.lit, labels)), F.col(column)).cast("int")

    def weighted(posteriors: DataFrame) -> DataFrame:
        """Expected counts of each annotator's labels under each class."""
        both = layout.join(posteriors.hint("merge"), "item")
        sums = [F.sum(F.when(F.col("decision" if kind == "d" else "score") == label, F.col(f"q{k}") * F.col("n")).otherwise(0.0)).alias(_cell(kind, label, k)) for kind, label, k in _CELLS]
        return both.groupBy("reviewer").agg(*sums)

    def judged(counts: _Counts) -> DataFrame:
        """Posteriors of the items under what the annotators' expected counts tell."""
        told = layout.join(counts.expectations(), "reviewer")
        base = digamma(counts.sizes() + PRIOR_CLASS)
        part = lambda name, at, k: F.coalesce(F.get(name, (at - 1) * n + k), F.lit(0.0))
        sums = [(F.sum((part("said", place("decision", DECISIONS), k) + part("gave", place("score", SCORES), k)) * F.col("n")) + float(base[k])).alias(f"l{k}") for k in range(n)]
        top = F.greatest(*(F.col(f"l{k}") for k in range(n)))
        raw = [F.exp(F.col(f"l{k}") - top) for k in range(n)]
        return told.groupBy("item").agg(*sums).select("item", *((r / reduce(lambda a, b: a + b, raw)).alias(f"q{k}") for k, r in enumerate(raw)))

    seen = [F.sum(F.when(F.col("decision") == d, F.col("n")).otherwise(0)) + 0.3 for d in DECISIONS]
    posteriors = layout.groupBy("item").agg(*((s / reduce(lambda a, b: a + b, seen)).alias(f"q{k}") for k, s in enumerate(seen)))
    few = layout.select("reviewer").distinct().count() <= BROADCAST_ROWS
    counts = _Counts(weighted(posteriors), few)
    for _ in range(rounds):
        new = _Counts(weighted(judged(counts)), few)
        moved = new.moved_from(counts)
        counts = new
        if moved <= tolerance:
            break
    return Consensus(layout, judged(counts), counts.frame)


def krippendorff(rated: DataFrame) -> DataFrame:
    """One row (n_items, n_ratings, alpha): nominal agreement of the decisions over items with two or more.

    Null where nothing can be paired or all ratings are the same class.
    """
    per = rated.filter("decision is not null").groupBy("item").agg(*(F.count_if(F.col("decision") == d).alias(f"n{k}") for k, d in enumerate(DECISIONS)), F.count("*").alias("m")).filter("m >= 2")
    pairs = reduce(lambda a, b: a + b, (F.col(f"n{k}") * (F.col(f"n{k}") - 1) for k in range(3)))
    total = per.agg(F.count("*").alias("n_items"), F.sum("m").alias("n_ratings"), F.sum(pairs / (F.col("m") - 1)).alias("same"), *(F.sum(f"n{k}").alias(f"n{k}") for k in range(3)))
    n = F.col("n_ratings")
    observed = 1 - F.try_divide(F.col("same"), n)
    expected = 1 - F.try_divide(pairs, n * (n - 1))
    return total.select("n_items", F.coalesce(n, F.lit(0)).alias("n_ratings"), (1 - F.try_divide(observed, expected)).alias("alpha"))
