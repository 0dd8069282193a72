"""Joins with accounting, ordered set operations, and windows that the data model needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_by(df: DataFrame, keys: list[str], order: list[Column], columns: list[str] | None = None) -> DataFrame:
    """One row a key, the last in `order` (give a total one); as an aggregate, so that it combines before the shuffle."""
    rest = [c for c in (columns or df.columns) if c not in keys]
    picked = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, *(F.col("_row")[c].alias(c) for c in rest))


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of both, the delta's before the base's, of the same side the later one; null keys pass through."""
    both = base.withColumn("_side", F.lit(0)).unionByName(delta.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    kept = latest_by(both.filter(known), keys, [F.col("_side"), F.col(order)])
    return kept.unionByName(both.filter(~known)).drop("_side")


def classify_joins(left: DataFrame, key: str, others: dict[str, DataFrame]) -> DataFrame:
    """(key, skip_reason) of each left row: the first other table without its key, or null if all have it.

    Keys of the other tables are made distinct first, so that repeated ones don't multiply rows; a null
    key on the left is reported as `null_key`.
    """
    out = left.select(key)
    for name, other in others.items():
        out = out.join(other.select(F.col(key)).distinct().withColumn(f"_{name}", F.lit(True)), key, "left")
    reason = F.when(F.col(key).isNull(), "null_key")
    for name in others:
        reason = reason.when(F.col(f"_{name}").isNull(), f"missing_{name}")
    return out.select(key, reason.alias("skip_reason"))


def side_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys in both, only left and only right, by one full outer join."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    both = x.join(y, key, "full_outer")
    return both.agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_both"),
        F.count_if(F.col("_b").isNull()).alias("n_left_only"),
        F.count_if(F.col("_a").isNull()).alias("n_right_only"),
    )


def override(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left outer join in which the right side's values replace the left's where they aren't null."""
    r = right.select(key, *(F.col(c).alias(f"_r_{c}") for c in columns))
    rest = [c for c in left.columns if c not in columns]
    return left.join(r, key, "left").select(*rest, *(F.coalesce(f"_r_{c}", c).alias(c) for c in columns))


def exact_or_normal_overlap(held: DataFrame, train: DataFrame, key: str, exact: str, normal: str) -> DataFrame:
    """(key, match): held rows with an equal row in `train`, `exact` before `normalized`.

    Keys are joined as hashed distinct sides, never expanded: one row a held row, whatever the copies.
    Empty normalised texts match each other.
    """
    e = train.select(F.col(exact).alias(exact)).distinct().withColumn("_e", F.lit(True))
    n = train.select(F.col(normal).alias(normal)).distinct().withColumn("_n", F.lit(True))
    joined = held.join(e, exact, "left").join(n, normal, "left")
    match = F.when(F.col("_e"), "exact").when(F.col("_n"), "normalized")
    return joined.select(key, match.alias("match")).filter("match is not null")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; give a total order. The engine limits within partitions before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def mid_ranks(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """`mid_rank`: the mean of the ranks that equal values share."""
    own = Window.partitionBy(*group).orderBy(value)
    return df.withColumn("mid_rank", F.rank().over(own) + (F.count("*").over(Window.partitionBy(*group, value)) - 1) / 2.0)


def holm(df: DataFrame, group: list[str], p: str, tie: str) -> DataFrame:
    """`p_holm`: the step-down adjusted p value within the group; null p values stay null and don't count."""
    known = df.filter(F.col(p).isNotNull() & ~F.isnan(p))
    own = Window.partitionBy(*group)
    step = own.orderBy(p, tie)
    m = F.count("*").over(own)
    raw = known.withColumn("_x", (m - F.row_number().over(step) + 1) * F.col(p))
    running = F.max("_x").over(step.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    done = raw.withColumn("p_holm", F.least(F.lit(1.0), running)).drop("_x")
    return done.unionByName(df.filter(F.col(p).isNull() | F.isnan(p)).withColumn("p_holm", F.lit(None).cast("double")))


def history(df: DataFrame, group: list[str], order: list[str], text: str, out: str = "history") -> DataFrame:
    """All earlier texts of the group joined with a blank; "" for the first."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.array_join(F.collect_list(text).over(w), " "))


def quota_labels(df: DataFrame, order: list[Column], quotas: list[tuple[str, int]], group: list[str]) -> DataFrame:
    """`label`: within each group the first n rows get the first label, the next ones the second, and so on."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    label, reached = F.lit(None).cast("string"), 0
    bounds = []
    for name, n in quotas:
        reached += n
        bounds.append((name, reached))
    for name, upto in reversed(bounds):
        label = F.when(rank <= upto, name).otherwise(label)
    return df.withColumn("label", label)


def keep_or_best(df: DataFrame, group: list[str], score: str, least: float, tie: list[str]) -> DataFrame:
    """Rows with a score of at least `least`; where a group has none, its best row, ties by `tie`."""
    own = Window.partitionBy(*group)
    best = F.row_number().over(own.orderBy(F.col(score).desc_nulls_last(), *tie))
    top = F.max(score).over(own)
    return df.withColumn("_b", best).withColumn("_t", top).filter((F.col(score) >= least) | ((F.coalesce(F.col("_t"), F.lit(-1.0)) < least) & (F.col("_b") == 1))).drop("_b", "_t")


def pivot_first(df: DataFrame, row: str, column: str, value: str, order: str, columns: list[str]) -> DataFrame:
    """row x column with the first value in `order`; "" where there is none. The columns are stated, so no pass finds them."""
    firsts = [F.coalesce(F.min_by(value, F.when(F.col(column) == c, F.col(order))).cast("string"), F.lit("")).alias(c) for c in columns]
    return df.groupBy(row).agg(*firsts)


def join_all(left: DataFrame, key: str, others: dict[str, DataFrame], order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(joined rows, reasons): each left row that all other tables have, with their columns, and (key, skip_reason) of the rest.

    Of repeated keys in another table the last in `order` counts; without an order the greatest row. Columns of the others are
    named after their table.
    """
    out = left
    for name, other in others.items():
        rest = [c for c in other.columns if c != key]
        by = [F.col(order)] if order else [F.struct(*rest)]
        one = latest_by(other.filter(F.col(key).isNotNull()), [key], by)
        out = out.join(one.select(key, *(F.col(c).alias(f"{name}_{c}") for c in rest), F.lit(True).alias(f"_{name}")), key, "left")
    reason = F.when(F.col(key).isNull(), "null_key")
    for name in others:
        reason = reason.when(F.col(f"_{name}").isNull(), f"missing_{name}")
    marked = out.withColumn("skip_reason", reason).drop(*(f"_{n}" for n in others))
    return marked.filter("skip_reason is null").drop("skip_reason"), marked.filter("skip_reason is not null").select(key, "skip_reason")


def paired(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, side, before, after): rows of both tables as structs; side is `both`, `before` or `after`, the one that has it."""
    a = before.select(F.col(key), F.struct(*[c for c in before.columns if c != key]).alias("before"))
    b = after.select(F.col(key), F.struct(*[c for c in after.columns if c != key]).alias("after"))
    side = F.when(F.col("before").isNull(), "after").when(F.col("after").isNull(), "before").otherwise("both")
    return a.join(b, key, "full_outer").select(key, side.alias("side"), "before", "after")


def collisions(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """(key, n_base, n_delta) of the keys that are in both or more than once in either."""
    n = base.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(delta.select(key, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    counts = n.groupBy(key).agg(F.sum("_a").alias("n_base"), F.sum("_b").alias("n_delta"))
    return counts.filter("n_base + n_delta > 1")


def merge_disjoint(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """The union of both; an error that names a key if one is in both or repeated."""
    first = collisions(base, delta, key).limit(1).collect()
    if first:
        raise ValueError(f"{key} {first[0][0]!r} is not unique")
    return base.unionByName(delta)


def bands(df: DataFrame, score: str, key: str, n: int, middle: float = 0.5) -> DataFrame:
    """`band` and `place`: the n highest, the n lowest and the n nearest to `middle`, ties by key; a row may be in several."""
    parts = []
    for name, order in (("high", F.desc(score)), ("low", F.asc(score)), ("middle", F.abs(F.col(score) - middle).asc())):
        top = df.filter(F.col(score).isNotNull()).orderBy(order, key).limit(n)
        parts.append(top.withColumn("band", F.lit(name)).withColumn("place", F.row_number().over(Window.orderBy(order, key))))  # n rows
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
