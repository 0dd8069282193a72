"""Seeded sampling and splitting by the order of a hash: stable under repartitioning and mergeable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def seeded_order(key: Column, seed: str) -> Column:
    """MD5 of seed and key: the same order in any engine."""
    return F.md5(F.concat(F.lit(seed), F.lit(":"), key.cast("string")))


def largest_remainder(counts: dict[str, int], total: int, least: int = 0) -> dict[str, int]:
    """Quotas in proportion to the counts, none over its count, that add up to `total` where the counts allow.

    Every non-empty key gets `least` first; what rounding leaves goes to the largest fractions, then to the
    larger counts, then by key. For small tables of strata.
    """
    quota = {k: min(least, n) for k, n in counts.items()}
    left = min(total, sum(counts.values())) - sum(quota.values())
    while left > 0:
        room = {k: n - quota[k] for k, n in counts.items() if n > quota[k]}
        whole = sum(room.values())
        exact = {k: left * r / whole for k, r in room.items()}
        given = {k: min(room[k], int(x)) for k, x in exact.items()}
        rest = left - sum(given.values())
        for k in sorted(room, key=lambda k: (given[k] - exact[k], -room[k], k)):
            if rest <= 0:
                break
            if given[k] < room[k]:
                given[k] += 1
                rest -= 1
        for k, n in given.items():
            quota[k] += n
        left = rest
    return quota


def stratified(df: DataFrame, stratum: str, key: str, total: int, seed: str, least: int = 1) -> DataFrame:
    """A proportional sample: the quota of each stratum from the counts, its rows by hash order.

    The counts of strata reach the driver; a stratum is a column of few values.
    """
    counts = {r[0]: r[1] for r in df.filter(F.col(stratum).isNotNull()).groupBy(stratum).count().collect()}
    quotas = largest_remainder(counts, total, least)
    small = df.sparkSession.createDataFrame(list(quotas.items()) or [("", 0)], "stratum string, quota int")
    w = Window.partitionBy(stratum).orderBy(seeded_order(F.col(key), seed), key)
    ranked = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max([0, *quotas.values()]))
    return ranked.join(F.broadcast(small), ranked[stratum] == small.stratum).filter("_r <= quota").drop("_r", "stratum", "quota")


def bucket_sample(df: DataFrame, bucket: str, key: str, n: int, seed: str) -> DataFrame:
    """The n rows of least hash in each bucket, a sample without replacement that merges over partitions."""
    w = Window.partitionBy(bucket).orderBy(seeded_order(F.col(key), seed), key)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def nested_stages(df: DataFrame, group: str, key: str, sizes: dict[str, int], seed: str) -> DataFrame:
    """`stage`: the first (smallest) stage that has the row; each stage holds the ones before it."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(seeded_order(F.col(key), seed), key))
    stage = F.lit(None).cast("string")
    for name, n in sorted(sizes.items(), key=lambda x: -x[1]):
        stage = F.when(rank <= n, name).otherwise(stage)
    return df.withColumn("stage", stage).filter("stage is not null")


def hash_split(df: DataFrame, key: str, shares: list[tuple[str, float]], seed: str) -> DataFrame:
    """`part` by the place of the key's hash in 0..1: no shuffle, and a row keeps its part when others come."""
    u = F.conv(F.substring(seeded_order(F.col(key), seed), 1, 8), 16, 10).cast("double") / 4294967296.0
    part, reached = F.lit(shares[-1][0]), sum(s for _, s in shares[:-1])
    for name, s in reversed(shares[:-1]):
        part = F.when(u < reached, name).otherwise(part)
        reached -= s
    return df.withColumn("part", part)


def calibration_split(df: DataFrame, stratum: str, key: str, share: float, seed: str) -> DataFrame:
    """`part`: in each stratum round(n * share) rows for calibration, at least one and never all, the rest for evaluation."""
    own = Window.partitionBy(stratum)
    n = F.count("*").over(own)
    take = F.when(n < 2, 0).otherwise(F.least(F.greatest(F.round(n * share), F.lit(1)), n - 1))
    rank = F.row_number().over(own.orderBy(seeded_order(F.col(key), seed), key))
    return df.withColumn("part", F.when(rank <= take, "calibration").otherwise("evaluation"))


def equal_quota(df: DataFrame, buckets: list[str], key: str, total: int, seed: str) -> DataFrame:
    """`total` rows shared out equally at every level of `buckets`, what a small bucket can't give going to the others.

    A round-robin: within the finest bucket rows follow their hash, at every level the buckets take turns, and the
    first `total` rows of that order are the sample. Buckets may be null. No counts reach the driver.
    """
    out = df.withColumn("_r", seeded_order(F.col(key), seed))
    order: list = ["_r", key]
    for level in range(len(buckets), 0, -1):
        w = Window.partitionBy(*buckets[:level]).orderBy(*order)
        # No row over the total at any level can be in the sample; the engine limits groups before it sorts them.
        out = out.withColumn("_turn", F.row_number().over(w)).filter(F.col("_turn") <= total)
        out = out.withColumn("_r", F.col("_turn")).drop("_turn")
        order = ["_r", F.col(buckets[level - 1]).asc_nulls_first(), key]
    return out.orderBy(*order).limit(total).drop("_r")


def exact_sample(df: DataFrame, key: str, n: int, seed: str, allow_short: bool = False) -> DataFrame:
    """The n rows of least hash; an error if there are fewer, unless that is allowed."""
    if not allow_short and df.limit(n).count() < n:
        raise ValueError(f"fewer than {n} rows")
    return df.orderBy(seeded_order(F.col(key), seed), key).limit(n)


def balanced_calibration(df: DataFrame, strata: list[str], key: str, share: float, seed: str) -> DataFrame:
    """`part` like `calibration_split`, brought to round(n * share) calibration rows of all.

    Where the strata give more, the calibration rows of least hash stay; where they give fewer, the other rows of least
    hash are added. Ranks are counted by hash bucket, so that no task sees all rows.
    """
    total = df.count()
    target = max(1, min(total - 1, round(total * share))) if total > 1 and share > 0 else 0
    own = Window.partitionBy(*strata)
    n = F.count("*").over(own)
    take = F.when(n < 2, 0).otherwise(F.least(F.greatest(F.round(n * share), F.lit(1)), n - 1))
    order = seeded_order(F.col(key), seed)
    chosen = df.withColumn("_h", order).withColumn("_first", F.row_number().over(own.orderBy("_h", key)) <= take)
    # Chosen rows come first in the order that the target cuts; the hash's first digits make the buckets.
    placed = chosen.withColumn("_b", F.concat(F.when(F.col("_first"), "0").otherwise("1"), F.substring("_h", 1, 3)))
    sizes = placed.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))  # at most 8,192 rows
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    return placed.join(F.broadcast(before), "_b").withColumn("part", F.when(rank <= target, "calibration").otherwise("evaluation")).drop("_h", "_first", "_b", "_before")
