"""Canonical rows, quotas, intervals, joins and file forms on small tables with edge cases."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import metrics as M
from millrace.operators import records as C
from millrace.operators import relational as R
from millrace.operators import sampling as S
from millrace.sources import files as I


def test_canonical_rows(spark):
    df = spark.createDataFrame([(" a ", None, "why", "So it is.\nFINAL answer: gout", 1), (None, "b", None, None, 2)], "id string, uid string, question string, output string, extra int")
    got = {r.id: r for r in C.canonical_rows(df, "m").collect()}
    assert got["a"].reasoning == "So it is." and got["a"].final_answer == "gout" and got["a"].prompt == "why" and json.loads(got["a"].raw)["extra"] == 1
    assert got["b"].reasoning == got["b"].prompt == got["b"].gold_answer == ""
    bare = C.canonical_rows(spark.createDataFrame([("x",), ("y",)], "answer string"), "m").collect()
    assert sorted((r.id, r.final_answer) for r in bare) == [("0", "x"), ("1", "y")]
    assert C.canonical_rows(df.limit(0), "m").count() == 0


def test_record_columns(spark):
    row = spark.range(1).select(
        C.build_response(F.lit(" r "), F.lit("")).alias("r"), C.build_response(F.lit(None), F.lit("a")).alias("a"), C.ordered_concat(F.array(F.lit("b"), F.lit(" "), F.lit(None), F.lit("a"), F.lit("b "))).alias("o"),
        C.format_fraction(F.lit(1), F.lit(16)).alias("f"), C.format_fraction(F.lit(0), F.lit(0)).alias("z"), C.head_and_tail(F.lit("abcdefgh"), 4, "~").alias("h"), C.slug(F.lit(" A b__C! ")).alias("s"),
        C.answer_match(F.lit("a"), F.lit("A"), F.lit("x"), F.lit("y")).alias("m"), C.answer_match(F.lit(""), F.lit("A"), F.lit(None), F.lit("y")).alias("n"),
        C.winner(F.array(F.lit(1.0), F.lit(2.0), F.lit(2.0)), lambda x: x, lambda x: F.lit(0)).alias("w"), C.winner(F.array(F.lit(0.5)), lambda x: x, lambda x: F.lit(0)).alias("v"),
    ).first()
    assert (row.r, row.a, row.o, row.f, row.z, row.h, row.s) == ("r", "Final Answer: a", "b\na", "1/16 (6.3%)", "n/a", "ab~gh", "a-b-c")
    assert (row.m.method, row.m.exact_match, row.n.method, row.n.exact_match, row.w, row.v) == ("choice_label", True, "none", None, 1, None)


def test_evidence_in_all_shapes(spark):
    for value, kind in (([("a",), (" ",), (None,)], "array<struct<text string>>"), (["a", None], "array<string>"), (("a",), "struct<text string>"), ("a", "string")):
        df = spark.createDataFrame([(value,), (None,)], f"e {kind}")
        assert [r.x for r in df.select(C.evidence_texts(df, "e").alias("x")).collect()] == [["a"], []]


def test_quotas(spark):
    df = spark.createDataFrame([(f"i{i}", "abc"[min(i // 10, 2)] if i < 33 else None) for i in range(36)], "id string, b string")
    got = {r.b: r["count"] for r in S.equal_quota(df, ["b"], "id", 14, "s").groupBy("b").count().collect()}
    assert got == {None: 3, "a": 4, "b": 4, "c": 3}
    assert S.equal_quota(df, ["b"], "id", 100, "s").count() == 36 and S.equal_quota(df.limit(0), ["b"], "id", 5, "s").count() == 0
    with pytest.raises(ValueError):
        S.exact_sample(df, "id", 37, "s")
    assert S.exact_sample(df, "id", 37, "s", allow_short=True).count() == 36
    part = {r.part: r["count"] for r in S.balanced_calibration(df, ["b"], "id", 0.3, "s").groupBy("part").count().collect()}
    assert part == {"calibration": 11, "evaluation": 25}


def test_intervals(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([("g", str(i), rng.gauss(0.2, 1.0)) for i in range(400)] + [("h", "x", None), (None, "n", 1.0)], "g string, k string, v double").repartition(5)
    got = {r.g: r for r in M.bootstrap_mean(df.filter("g is not null"), ["g"], "v", "k", 400).collect()}
    x = np.array([r.v for r in df.filter("g = 'g'").collect()])
    half = 1.96 * x.std() / 20
    assert set(got) == {"g"} and got["g"].low == pytest.approx(x.mean() - half, abs=0.03) and got["g"].high == pytest.approx(x.mean() + half, abs=0.03) and 0 < got["g"].p < 0.05
    again = M.bootstrap_mean(df.repartition(2).filter("g = 'g'"), ["g"], "v", "k", 400).first()
    assert again.low == pytest.approx(got["g"].low, abs=1e-9)
    whole = M.macro_bootstrap(df.filter("g is not null"), ["g"], "v", "k").first()
    assert whole.n_strata == 1 and whole.low < whole["mean"] < whole.high
    share = M.label_bootstrap(df.withColumn("l", F.when(F.col("v") > 0, "up").otherwise("down")).filter("g = 'g'"), ["g"], "l", ["up", "down", "none"], "k").collect()
    assert {r.label for r in share} == {"up", "down", "none"} and sum(r["mean"] for r in share) == pytest.approx(1)


def test_signed_ranks_of_many_pairs():
    rng = np.random.default_rng(2)
    d = rng.normal(0.1, 1, 150)
    w, p = M.signed_rank_p(d)
    rank = np.argsort(np.argsort(np.abs(d))) + 1
    mean, sd = 150 * 151 / 4, np.sqrt(150 * 151 * 301 / 24)
    assert w == rank[d > 0].sum() and p == pytest.approx(2 * (1 - 0.5 * (1 + __import__("math").erf(abs(w - mean) / sd / 2**0.5))), abs=0.01)


def test_joins_with_all_sides(spark):
    a = spark.createDataFrame([("x",), ("y",), ("z",), (None,)], "id string")
    b = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "id string, v int")
    rows, reasons = R.join_all(a, "id", {"b": b, "c": b.filter("v < 3")}, "v")
    assert [tuple(r) for r in rows.collect()] == [("x", 2, 2)]
    assert {(r.id, r.skip_reason) for r in reasons.collect()} == {("y", "missing_c"), ("z", "missing_b"), (None, "null_key")}
    assert {(r.id, r.side) for r in R.paired(a.filter("id is not null").withColumn("q", F.lit(1)), b.filter("v > 1"), "id").collect()} == {("x", "both"), ("y", "both"), ("z", "before")}
    assert R.collisions(b, b.limit(0), "id").collect()[0].n_base == 2
    with pytest.raises(ValueError):
        R.merge_disjoint(b, b, "id")
    assert R.merge_disjoint(a, a.limit(0), "id").count() == 4


def test_long_and_terminal_rows(spark):
    df = spark.createDataFrame([("a", "xx", ["p", "q"]), ("b", "xxxx", []), ("c", None, None), ("d", "yyyy", ["r"])], "id string, t string, items array<string>")
    short, long = C.split_by_length(df, "t", 3, df.filter("id = 'd'"))
    assert {r.id for r in short.collect()} == {"a", "c"} and [(r.id, r.length) for r in long.collect()] == [("b", 4)]
    assert {(r.id, r.item, r.terminal) for r in C.with_terminal(df, "items").collect()} == {("a", "p", False), ("a", "q", True), ("d", "r", True)}


def test_file_forms(spark, tmp_path):
    lines = tmp_path / "rows.txt"
    lines.write_text("".join(f"line {i}\n" for i in range(20)))
    assert [r.ordinal for r in I.read_window(spark, str(lines), 5, 8).orderBy("ordinal").collect()] == [5, 6, 7] and I.read_window(spark, str(lines), 18).count() == 2
    ids = tmp_path / "ids.jsonl"
    ids.write_text('{"id": "b"}\n{"id": " a "}\n{"id": "b"}\n{"id": ""}\n')
    assert [r.id for r in I.read_ids(spark, str(ids)).orderBy("ord").collect()] == ["b", "a"]
    I.write_document({"a": float("nan"), "b": [1.5, float("inf")], "c": {"d": 2}}, str(tmp_path / "x" / "doc.json"))
    assert I.read_config(str(tmp_path / "x" / "doc.json"), {"c": {"e": 3}, "f": 4}) == {"a": None, "b": [1.5, None], "c": {"d": 2, "e": 3}, "f": 4}
    a, b = spark.createDataFrame([(1, [2])], "z int, y array<int>"), spark.createDataFrame([("q", 5)], "x string, z int")
    I.write_union([a, b], str(tmp_path / "u"), "sorted")
    assert I.read_csv(spark, str(tmp_path / "u")).columns == ["x", "y", "z"]
    assert I.annotation_sheet(a, ["z", "y"], ["verdict"]).first().asDict() == {"z": 1, "y": "[2]", "verdict": ""}
    assert [r.x for r in I.open_jobs(b.union(b), b.limit(0), "x").collect()] == ["q"]
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"z": 1}\nnot json\n')
    good, wrong = I.split_bad_rows(I.read_jsonl(spark, str(bad), a.select("z").schema, tolerant=True).cache())
    assert good.count() == 1 and I.bad_row_report(wrong).first().asDict() == {"n_bad": 1, "preview": ["not json"]}
