"""Confusion, calibration, agreement and paired statistics as grouped aggregates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, gold: str, predicted: str, domain: list[str]) -> DataFrame:
    """(gold, predicted, n) over the whole fixed domain, zeros included; rows outside it don't count."""
    spark = df.sparkSession
    cells = spark.createDataFrame([(g, p) for g in domain for p in domain], "gold string, predicted string")
    counts = df.groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("c"))
    return cells.join(counts, ["gold", "predicted"], "left").select("gold", "predicted", F.coalesce("c", F.lit(0)).alias("n"))


def precision_recall(matrix: DataFrame) -> DataFrame:
    """(label, precision, recall, f1) of a confusion table; 0 where a denominator is."""
    hit = F.sum(F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0))
    gold = matrix.groupBy(F.col("gold").alias("label")).agg(F.sum("n").alias("g"), hit.alias("h"))
    pred = matrix.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("p"))
    pr, rc = F.coalesce(F.try_divide("h", "p"), F.lit(0.0)), F.coalesce(F.try_divide("h", "g"), F.lit(0.0))
    return gold.join(pred, "label").select("label", pr.alias("precision"), rc.alias("recall"), F.coalesce(F.try_divide(2 * pr * rc, pr + rc), F.lit(0.0)).alias("f1"))


def reliability_bins(df: DataFrame, confidence: str, correct: Column, bins: int = 10) -> DataFrame:
    """(bin, n, mean_confidence, accuracy) of equal-width bins; the last one is closed."""
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("mean_confidence"), F.avg(correct.cast("double")).alias("accuracy"))


def calibration_error(bins: DataFrame) -> DataFrame:
    """One row (ece): the gaps of the bins weighted by their rows."""
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("mean_confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, observed, expected, kappa): agreement of two raters beyond chance; 1 if chance agrees fully."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = both.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    left, right = cells.groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("na")), cells.groupBy(F.col("b").alias("k")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, "k").agg(F.sum(F.col("na") * F.col("nb")).alias("e"))
    seen = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    # Two one-row tables.
    one = seen.withColumn("_", F.lit(1)).join(chance.withColumn("_", F.lit(1)), "_")
    n, o = F.col("n").cast("double"), F.col("same") / F.col("n")
    e = F.col("e") / (n * n)
    return one.select("n", o.alias("observed"), e.alias("expected"), F.when(e >= 1, 1.0).otherwise((o - e) / (1 - e)).alias("kappa"))


def wilson(successes: Column, n: Column, z: float = 1.959964) -> tuple[Column, Column]:
    """The bounds of the Wilson interval; null for n = 0."""
    p = F.try_divide(successes.cast("double"), n.cast("double"))
    d = 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / d
    return mid - half, mid + half


def sign_test_p(b: int, c: int) -> float:
    """The exact two-sided binomial p of discordant counts (McNemar, sign test); 1 without any."""
    n, k = b + c, min(b, c)
    if n == 0:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
    return min(1.0, 2 * sum(math.exp(x) for x in log))


def mcnemar(df: DataFrame, group: str, a: Column, b: Column) -> DataFrame:
    """(group, only_a, only_b, p): discordant counts of two systems and their exact p."""
    counts = df.groupBy(group).agg(F.count_if(a & ~b).alias("only_a"), F.count_if(b & ~a).alias("only_b"))

    @F.pandas_udf("double")
    def exact(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([sign_test_p(int(i), int(j)) for i, j in zip(x, y)])

    return counts.withColumn("p", exact("only_a", "only_b"))


def paired_shift(df: DataFrame, group: list[str], before: str, after: str) -> DataFrame:
    """Mean and median change, and how many improved (fell), worsened and tied; nulls on either side don't count."""
    d = F.col(after) - F.col(before)
    return df.filter(d.isNotNull()).groupBy(*group).agg(
        F.count("*").alias("n"), F.avg(d).alias("mean_delta"), F.median(d).alias("median_delta"),
        F.count_if(d < 0).alias("improved"), F.count_if(d > 0).alias("worsened"), F.count_if(d == 0).alias("tied"),
    )


def paired_t(df: DataFrame, group: list[str], before: str, after: str) -> DataFrame:
    """(group, n, t) of the paired t test; null for fewer than two pairs or no variance."""
    d = F.col(after) - F.col(before)
    s = df.filter(d.isNotNull()).groupBy(*group).agg(F.count("*").alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s"))
    return s.select(*group, "n", F.try_divide(F.col("m"), F.nullif(F.col("s") / F.sqrt("n"), F.lit(0.0))).alias("t"))


_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def _uniform(key: np.ndarray, draws: int) -> np.ndarray:
    """A number in 0..1 for each key and draw (splitmix64 of both)."""
    x = key.astype(np.uint64)[:, None] + np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def resampled_means(df: DataFrame, group: list[str], value: str, key: str, resamples: int, seed: int) -> DataFrame:
    """(group, b, m): the mean of each of the Poisson resamples.

    Each row draws its weights from a hash of its key, so that the result doesn't depend on partitioning. Every
    batch passes on one vector of sums a group, so that rows are never multiplied and no group is gathered.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("v"), F.xxhash64(F.lit(seed), key).alias("k"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*group).schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, part in pdf.groupby(group, dropna=False, sort=False):
                w = np.zeros(resamples)
                wv = np.zeros(resamples)
                for s in range(0, len(part), 4096):
                    some = part.iloc[s : s + 4096]
                    weight = np.searchsorted(_POISSON, _uniform(some["k"].to_numpy(), resamples), "right")
                    w += weight.sum(axis=0)
                    wv += some["v"].to_numpy() @ weight
                yield pd.DataFrame({**{g: [x] * resamples for g, x in zip(group, name)}, "b": np.arange(resamples), "w": w, "wv": wv})

    sums = rows.mapInPandas(run, f"{fields}, b int, w double, wv double")
    return sums.groupBy(*group, "b").agg(F.try_divide(F.sum("wv"), F.sum("w")).alias("m"))


def bootstrap_mean(df: DataFrame, group: list[str], value: str, key: str, resamples: int = 200, seed: int = 7, floor_index: bool = False) -> DataFrame:
    """(group, n, mean, low, high, p): percentile interval of the mean, and the two-sided p of a mean of zero.

    The ends are interpolated, or with `floor_index` the resamples at places floor(.025 B) and floor(.975 B).
    """
    means = resampled_means(df, group, value, key, resamples, seed)
    ends = [F.percentile("m", F.lit(q)) for q in (0.025, 0.975)]
    if floor_index:
        ends = [F.sort_array(F.collect_list("m"))[int(q * resamples)] for q in (0.025, 0.975)]  # one number a resample
    tail = lambda c: (F.count_if(c) + 1) / (F.count("*") + 1)
    p = F.least(F.lit(1.0), 2 * F.least(tail(F.col("m") <= 0), tail(F.col("m") >= 0)))
    got = means.groupBy(*group).agg(ends[0].alias("low"), ends[1].alias("high"), p.alias("p"))
    return df.filter(F.col(value).isNotNull()).groupBy(*group).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).join(got, group)


def macro_bootstrap(df: DataFrame, strata: list[str], value: str, key: str, resamples: int = 200, seed: int = 7) -> DataFrame:
    """One row (n_strata, mean, low, high): the mean of the strata's means, resampled within strata."""
    means = resampled_means(df, strata, value, key, resamples, seed).groupBy("b").agg(F.avg("m").alias("m"))
    whole = df.filter(F.col(value).isNotNull()).groupBy(*strata).agg(F.avg(value).alias("x")).agg(F.count("*").alias("n_strata"), F.avg("x").alias("mean")).withColumn("_", F.lit(1))
    ends = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high")).withColumn("_", F.lit(1))
    return whole.join(ends, "_").drop("_")  # two one-row tables


def label_bootstrap(df: DataFrame, group: list[str], label: str, labels: list[str], key: str, resamples: int = 200, seed: int = 7) -> DataFrame:
    """(group, label, n, mean, low, high) of the share of each label; null labels don't count."""
    long = df.filter(F.col(label).isNotNull()).select(*group, key, F.explode(F.array(*(F.struct(F.lit(x).alias("label"), (F.col(label) == x).cast("double").alias("v")) for x in labels))).alias("e")).select(*group, key, "e.*")
    return bootstrap_mean(long, [*group, "label"], "v", key, resamples, seed).drop("p")


def signed_rank_p(differences: np.ndarray) -> tuple[float, float]:
    """(W of the positive differences, exact two-sided p); zeros must be gone.

    The distribution of the sum of doubled ranks is a polynomial product, of n (n + 1) / 2 steps a rank.
    """
    rank = np.rint(2 * pd.Series(np.abs(differences)).rank().to_numpy()).astype(np.int64)
    w = int(rank[differences > 0].sum())
    chance = np.zeros(int(rank.sum()) + 1)
    chance[0] = 1.0
    for r in rank:
        chance[r:] = 0.5 * (chance[r:] + chance[: len(chance) - r])
        chance[:r] *= 0.5
    return w / 2, float(min(1.0, 2 * min(chance[: w + 1].sum(), chance[w:].sum())))


def wilcoxon_exact(df: DataFrame, group: list[str], difference: str) -> DataFrame:
    """(group, n, w, p): exact signed-rank test; differences of zero don't count, a group without others gives no row.

    A group's differences are gathered in one task, as numbers: the test is for paired results of a sample, and
    its work grows with the cube of their number.
    """
    known = df.filter((F.col(difference) != 0) & F.col(difference).isNotNull()).select(*group, F.col(difference).cast("double").alias("d"))
    gathered = known.groupBy(*group).agg(F.count("*").alias("n"), F.collect_list("d").alias("_d"))

    @F.pandas_udf("struct<w double, p double>")
    def test(d: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([signed_rank_p(np.asarray(x)) for x in d], columns=["w", "p"])

    return gathered.select(*group, "n", test("_d").alias("t")).select(*group, "n", "t.w", "t.p")


def overall_scores(matrix: DataFrame) -> DataFrame:
    """One row (n, accuracy, macro_f1) of a confusion table; the mean of F1 over all labels of its domain."""
    labels = precision_recall(matrix).agg(F.avg("f1").alias("macro_f1")).withColumn("_", F.lit(1))
    total = matrix.agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy")).withColumn("_", F.lit(1))
    return total.join(labels, "_").drop("_")


def confusion_wide(matrix: DataFrame, domain: list[str]) -> DataFrame:
    """gold and one column for each predicted label."""
    return matrix.groupBy("gold").pivot("predicted", domain).agg(F.sum("n"))


def nearest_rank(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """The value at rank round(q (n - 1)), half to even, counted from 0, for each named share; nulls don't count."""
    v = F.col(value)
    sizes = df.filter(v.isNotNull()).groupBy(*group).agg(F.count("*").alias("_n"))
    at = {n: F.bround(q * (F.col("_n") - 1)) for n, q in shares.items()}
    counts = df.filter(v.isNotNull()).groupBy(*group, v.alias("_v")).agg(F.count("*").alias("_c"))
    # Distinct values with their counts: the first one whose running count is over the rank.
    from pyspark.sql.window import Window

    run = counts.withColumn("_run", F.sum("_c").over(Window.partitionBy(*group).orderBy("_v"))).join(sizes, group)
    return run.groupBy(*group).agg(*(F.min(F.when(F.col("_run") > p, F.col("_v"))).alias(n) for n, p in at.items()))


def strata(df: DataFrame, group: list[str], a: Column, b: Column) -> DataFrame:
    """(group, both_right, only_a, only_b, both_wrong) of two systems' correctness."""
    return df.groupBy(*group).agg(F.count_if(a & b).alias("both_right"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.count_if(~a & ~b).alias("both_wrong"))
