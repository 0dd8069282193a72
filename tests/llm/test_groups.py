"""Components and splits, and the consensus of annotators, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import components as C
from millrace.llm import consensus as K


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    groups = {}
    for x in parent:
        groups.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    rng = random.Random(5)
    edges = {"chain": [(str(i), str(i + 1)) for i in range(40)], "star": [("hub", str(i)) for i in range(40)], "random": [(str(rng.randrange(60)), str(rng.randrange(60))) for _ in range(45)]}[shape]
    df = spark.createDataFrame(edges + edges[:3] + [("q", None), ("s", "s")], "a string, b string")
    groups = {}
    for r in C.connected_components(df).collect():
        groups.setdefault(r.component, set()).add(r.node)
    assert {frozenset(g) for g in groups.values()} == {g for g in brute(edges) if len(g) > 1}


def test_spellings(spark):
    spelled = ["NWC-01112413", "nwc_1112413.v4", "https://cases.example.org/NWC 01112413", "id=Nwc:1112413#a", "NWC–01112413"]
    got = {tuple(r.x) for r in spark.createDataFrame([(s,) for s in spelled], "s string").select(C.source_refs(F.col("s")).alias("x")).collect()}
    assert got == {("NWC-1112413",)}
    short = [tuple(r.x) for r in spark.createDataFrame([("NWC-0042.v4",), ("nwc 42",), ("NWC_00000042#b",), ("id=NWC-0",)], "s string").select(C.source_refs(F.col("s")).alias("x")).collect()]
    assert short == [("NWC-42",)] * 3 + [("NWC-0",)]
    two = spark.createDataFrame([("A-12345;B-12345",), (" odd ",), (None,), ("  ",)], "s string").select(C.source_refs(F.col("s")).alias("x")).collect()
    assert [r.x for r in two] == [["A-12345", "B-12345"], ["ODD"], [], []]


def test_torn_through_a_link(spark):
    rows = [(1, "A-11111", "train"), (2, "A-11111;B-22222", None), (3, "b 22222", "TEST"), (4, "C-33333", "dev"), (5, None, "train"), (5, None, "train"), (6, "C-33333", "")]
    df = spark.createDataFrame(rows, "sample_id long, source_id string, split string")
    g = C.grouped_records(df)
    assert {r.record for r in C.torn_records(g).collect()} == {1, 3}
    s = {r.component: r.split for r in C.assign_splits(g).collect()}
    assert len(s) == 3 and sum(r.n_records for r in C.assign_splits(g).collect()) == 6
    assert C.assign_splits(g.limit(0)).count() == 0


def test_split_shares(spark):
    df = spark.range(4000).select(F.col("id").alias("sample_id"), F.when(F.col("id") < 1300, "A-00001").otherwise(F.concat(F.lit("B-1000"), F.col("id"))).alias("source_id"), F.lit("train").alias("split"))
    got = {r.split: r.n for r in C.assign_splits(C.grouped_records(df)).groupBy("split").agg(F.sum("n_records").alias("n")).collect()}
    assert abs(got["val"] - 400) <= 5 and abs(got["test"] - 400) <= 5 and sum(got.values()) == 4000


def test_splits_of_thirty_equal_sources(spark):
    df = spark.range(6000).select(F.col("id").alias("sample_id"), F.concat(F.lit("S-"), F.col("id") % 30).alias("source_id"), F.lit("train").alias("split"))
    got = {r.split: r.n for r in C.assign_splits(C.grouped_records(df)).groupBy("split").agg(F.sum("n_records").alias("n")).collect()}
    assert got == {"train": 4800, "val": 600, "test": 600}


def test_consensus_sees_through_inverted_reviewers(spark):
    rng = random.Random(2)
    rows, truth = [], {}
    flip = {"accept": "reject", "reject": "accept", "minor_revision": "minor_revision"}
    for i in range(150):
        truth[f"i{i}"] = t = rng.choice(K.DECISIONS)
        for r in ("g1", "g2", "g3", "g4", "bad1", "bad2"):
            if rng.random() < 0.7:
                said = t if rng.random() < 0.9 else rng.choice(K.DECISIONS)
                rows.append((f"i{i}", r, flip[said] if r.startswith("bad") else said, None))
    rated = spark.createDataFrame(rows, "item string, reviewer string, decision string, score int")
    fitted = K.fit(rated, rounds=6)
    longer = {r["item"]: r.decision for r in K.fit(rated, rounds=20, tolerance=0.0).items().collect()}
    assert longer == {r["item"]: r.decision for r in fitted.items().collect()}
    got = {r["item"]: r.decision for r in fitted.items().collect()}
    assert sum(got[i] == t for i, t in truth.items() if i in got) >= 0.95 * len(got)
    few, K.BROADCAST_ROWS = K.BROADCAST_ROWS, 0
    try:
        assert {r["item"]: r.decision for r in K.fit(rated, rounds=6).items().collect()} == longer
    finally:
        K.BROADCAST_ROWS = few
    trust = {r.reviewer: r for r in fitted.reviewers().collect()}
    assert trust["g1"].reliability > 0.8 > 0.5 > trust["bad1"].reliability and trust["g1"].low < trust["g1"].reliability < trust["g1"].high


def test_ratings_and_agreement_edges(spark):
    cols = "id string, review_round string, reviewer1_id string, reviewer1_final_decision string, reviewer1_clinical_plausibility string, reviewer2_id string, reviewer2_final_decision string, reviewer2_clinical_plausibility string, item string"
    rows = [("a", "r1", "x", " Minor-Revision", "4/5", "y", "?", "", "z"), ("a", "r1", "x", " Minor-Revision", "4/5", "y", "?", "", "z"), ("a", "r2", " x ", "ACCEPT", "n/a", None, "reject", "3", "z")]
    got = sorted((r["item"], r.reviewer, r.decision, r.score) for r in K.ratings(spark.createDataFrame(rows, cols)).collect())
    assert got == [("a", "x", "accept", None), ("a", "x", "minor_revision", 4)] or got == [("a", "x", "minor_revision", 4), ("a", "x", "accept", None)]
    empty = K.ratings(spark.createDataFrame([], cols))
    assert K.fit(empty, 2).items().count() == 0 and K.krippendorff(empty).first().alpha is None


def test_digamma():
    assert K.digamma(1.0) == pytest.approx(-0.5772156649, abs=1e-8) and K.digamma(0.5) == pytest.approx(-1.9635100260, abs=1e-8)
