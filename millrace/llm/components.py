"""Problem 2: splits that keep all records of a source together.

Method: frontier breadth-first components. Records that name several sources link them; the adjacency
list is partitioned by the node's hash. Every node whose hash is the least among its neighbours is a
seed, and all seeds expand at once, one step a round, each round touching only the frontier. Where two
seeds' regions meet, a link between the two seed labels goes into a smaller graph, which is merged the
same way until nothing collides; as seeds are never neighbours, each level has at most half the nodes.
Components are put into splits in the order of a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.session import cut_lineage, stored

# Spellings of the three splits.
SPLIT_NAMES = {
    "train": ("train", "trn", "training", "tr"),
    "val": ("val", "valid", "validation", "dev", "eval_dev", "development", "eval"),
    "test": ("test", "testing", "heldout_test", "held_out_test", "tst", "heldout"),
}
SPLIT_PREFIXES = (("train", "train"), ("val", "val"), ("test", "test"), ("trn", "train"), ("dev", "val"), ("heldout", "test"))

# What may stand between prefix and number, and what marks a version instead of a prefix.
SEPARATORS = r"[\s:_\x{ad}\x{2010}-\x{2015}\x{2212}\x{ff0d}-]"
VERSION_MARKS = ("V", "VER", "VERSION", "REV", "PART")


def split_name(spelled: Column) -> Column:
    """train, val or test for the many spellings of a split; null where it names none."""
    key = F.trim(F.regexp_replace(F.lower(spelled), r"(?U)[\s\-_]+", "_"), F.lit("_"))
    out = F.lit(None).cast("string")
    for prefix, name in reversed(SPLIT_PREFIXES):
        out = F.when(key.startswith(prefix), name).otherwise(out)
    for name, spellings in SPLIT_NAMES.items():
        out = F.when(key.isin(*spellings), name).otherwise(out)
    return out


def source_refs(spelled: Column) -> Column:
    """The sources that a `source_id` names, as PREFIX-NUMBER, in order and without repeats.

    The prefix is upper case, the number, of any number of digits, has no leading zeros; what stands around
    them (addresses, `id=`, version suffixes, separators) doesn't count. A value without any such pair is a source by itself,
    trimmed and in upper case; null and blank values name none.
    """
    up = F.upper(spelled)
    pattern = rf"(?<![A-Z0-9])(?!(?:{'|'.join(VERSION_MARKS)}){SEPARATORS}*[0-9])([A-Z]+){SEPARATORS}*([0-9]+)"
    prefixes, numbers = F.regexp_extract_all(up, F.lit(pattern), 1), F.regexp_extract_all(up, F.lit(pattern), 2)
    refs = F.array_distinct(F.zip_with(prefixes, numbers, lambda p, n: F.concat_ws("-", p, F.regexp_replace(n, "^0+(?=.)", ""))))
    bare = F.regexp_replace(up, r"(?U)^\s+|\s+$", "")
    return F.when(F.size(refs) > 0, refs).when(F.length(bare) > 0, F.array(bare)).otherwise(F.array().cast("array<string>"))


def _order(node: Column) -> Column:
    return F.struct(F.xxhash64(node).alias("h"), node.alias("n"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of the undirected `edges`; the component is one of its nodes.

    Links to null, to itself and repeated ones don't matter; no edge gives an empty result. The number of
    rounds depends on the distance of a node from the next local least hash, which is logarithmic for
    chains, not on the diameter. Each round is written to the checkpoint folder.
    """
    links = edges.select(F.col(a).cast("string").alias("src"), F.col(b).cast("string").alias("dst")).filter("src <> dst")
    adjacency = cut_lineage(links.union(links.select("dst", "src")).distinct().repartition("src"))
    least = adjacency.groupBy("src").agg(F.min(_order(F.col("dst"))).alias("m"))
    seeds = least.filter(_order(F.col("src")) < F.col("m")).select(F.col("src").alias("node"), F.col("src").alias("label"))
    empty = adjacency.sparkSession.createDataFrame([], T.StructType([T.StructField("x", T.StringType()), T.StructField("y", T.StringType())]))
    labels = frontier = cut_lineage(seeds)
    meetings = empty
    while not frontier.isEmpty():
        sent = frontier.join(adjacency, frontier.node == adjacency.src).select(F.col("dst").alias("node"), F.col("label").alias("new")).distinct()
        arrived = sent.groupBy("node").agg(F.min("new").alias("least"))
        settled = cut_lineage(arrived.join(labels, "node", "left").select("node", F.col("label").alias("old"), F.coalesce("label", "least").alias("label")))
        met = sent.join(settled, "node").filter("new <> label").select(F.least("new", "label").alias("x"), F.greatest("new", "label").alias("y"))
        meetings = cut_lineage(meetings.union(met).distinct())
        frontier = settled.filter("old is null").select("node", "label")
        labels = cut_lineage(labels.unionByName(frontier))
    if meetings.isEmpty():
        return labels.withColumnRenamed("label", "component")
    merged = connected_components(meetings, "x", "y").select(F.col("node").alias("label"), "component")
    return labels.join(merged, "label", "left").select("node", F.coalesce("component", "label").alias("component"))


def source_components(df: DataFrame, key: str, source: str) -> DataFrame:
    """(ref, component): the group of each source that is named together with another one; its name is its least source.

    Sources named together in a record are one group, and so on through other records.
    """
    refs = df.select(F.col(key).alias("k"), source_refs(F.col(source)).alias("refs"))
    several = refs.filter(F.size("refs") > 1).select("refs").distinct()
    edges = several.select(F.explode(F.transform(F.slice("refs", 2, 1 << 20), lambda r: F.struct(F.col("refs")[0].alias("a"), r.alias("b")))).alias("e")).select("e.*")
    parts = connected_components(edges)
    named = parts.groupBy("component").agg(F.min("node").alias("least"))
    return parts.join(named, "component").select(F.col("node").alias("ref"), F.col("least").alias("component"))


def grouped_records(df: DataFrame, key: str = "sample_id", source: str = "source_id", split: str = "split") -> DataFrame:
    """Each record once with its `component` and its `given` split.

    Repeated rows of a key count once; records whose source is null or blank are groups by themselves.
    A key with several spellings of its split keeps the least, so that the result is defined. Other
    columns are not read. The join with the sources that were merged is on the record's first source:
    the table of merged sources is only as large as the links, and hot sources are split by the engine's
    handling of skewed joins.
    """
    named = F.try_element_at(source_refs(F.col(source)), F.lit(1))
    alone = F.concat(F.lit("record "), F.col(key).cast("string"))
    rows = df.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("record"), F.coalesce(named, alone).alias("ref"), split_name(F.col(split)).alias("given")
    )
    once = rows.groupBy("record").agg(F.min("ref").alias("ref"), F.min("given").alias("given"))
    return (
        once.join(source_components(df, key, source), "ref", "left")
        .select("record", F.coalesce("component", "ref").alias("component"), "given")
    )


def torn_components(records: DataFrame) -> DataFrame:
    """(component, n_records, n_train, n_val, n_test) of the groups with records in more than one split."""
    count = lambda s: F.count_if(F.col("given") == s).alias(f"n_{s}")
    sizes = records.groupBy("component").agg(F.count("*").alias("n_records"), count("train"), count("val"), count("test"))
    return sizes.filter((F.col("n_train") > 0).cast("int") + (F.col("n_val") > 0).cast("int") + (F.col("n_test") > 0).cast("int") > 1)


def torn_records(records: DataFrame) -> DataFrame:
    """The records with a split whose group has records in more than one split."""
    return records.filter("given is not null").join(torn_components(records).select("component"), "component", "left_semi")


def _place_large(groups: list[tuple[str, int]], targets: dict[str, float]) -> tuple[dict[str, str], dict[str, float]]:
    """(split of each group, records used of each split): each group in turn goes where most of the target is left and half of it fits; train where it fits nowhere."""
    used = dict.fromkeys(targets, 0.0)
    placed = {}
    for name, n in groups:
        fitting = [s for s in targets if targets[s] - used[s] >= n / 2]
        placed[name] = split = max(fitting, key=lambda s: 1 - used[s] / targets[s], default="train")
        used[split] += n
    return placed, used


def assign_splits(records: DataFrame, val: float = 0.1, test: float = 0.1, large: float = 0.02) -> DataFrame:
    """(component, n_records, split): every group in one split, by the order of its hash.

    Groups with more than the share `large` of all records, at most 1/large of them, are placed first, in
    the order of their hash, where most room is left. The others are laid out in the order of their hash and cut
    so that test and val fill up to their share of all records. The running total is kept by the hash's first three digits,
    then among groups that share them, so that no task sees all groups. No record gives an empty result.
    """
    total = records.count()
    key = F.md5(F.concat(F.lit("split:"), F.col("component")))
    sizes = stored(records.groupBy("component").agg(F.count("*").alias("n_records")).withColumn("h", key))
    is_large = F.col("n_records") > total * large
    rows = sizes.filter(is_large).orderBy("h").collect()  # at most 1/large
    placed, used = _place_large([(r.component, r.n_records) for r in rows], {"train": total * (1 - val - test), "val": total * val, "test": total * test})
    room = {s: max(0.0, total * share - used[s]) for s, share in (("test", test), ("val", val))}
    small = sizes.filter(~is_large).withColumn("bucket", F.substring("h", 1, 3))
    by_bucket = small.groupBy("bucket").agg(F.sum("n_records").alias("in_bucket"))
    before = by_bucket.select("bucket", (F.sum("in_bucket").over(Window.orderBy("bucket")) - F.col("in_bucket")).alias("before"))
    within = Window.partitionBy("bucket").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A group's place is where its middle lies, so that a group across a border falls to the side with more of it.
    place = F.col("before") + F.sum("n_records").over(within) - F.col("n_records") / 2
    laid = small.join(F.broadcast(before), "bucket").withColumn("at", place)
    named = F.when(F.col("at") < room["test"], "test").when(F.col("at") < room["test"] + room["val"], "val").otherwise("train")
    big = F.create_map(*(F.lit(x) for pair in placed.items() for x in pair)) if placed else F.create_map().cast("map<string,string>")
    return laid.select("component", "n_records", named.alias("split")).unionByName(
        sizes.filter(is_large).select("component", "n_records", F.try_element_at(big, F.col("component")).alias("split"))
    )
