"""Rules, loose fields and span repair."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import rules as U


def test_list_field(spark):
    cells = ['["a", " b ", ""]', "a||b", "one\ntwo\n", "single", None, "  "]
    got = spark.createDataFrame([(c,) for c in cells], "c string").select(U.list_field(F.col("c")).alias("x")).collect()
    assert [r.x for r in got] == [["a", "b"], ["a", "b"], ["one", "two"], ["single"], [], []]


def test_json_object(spark):
    cells = ['```json\n{"b": 1, "a": [2]}\n```', "no {broken} {\"x\": 1} tail", "[1]", None]
    got = spark.createDataFrame([(c,) for c in cells], "c string").select(U.json_object("c").alias("x")).collect()
    assert [r.x for r in got] == ['{"a": [2], "b": 1}', '{"x": 1}', None, None]


def test_units_cover_their_text(spark):
    text = "1. Fever is typical. It was 37.5 degrees, because of X.\n- Final answer: 肺炎。\n\n"
    units = spark.createDataFrame([(text,), ("",), (None,)], "t string").select("t", U.units_of(F.col("t")).alias("u")).collect()
    assert all(text[u.start : u.end].strip() == u.text for u in units[0].u)
    assert "".join(text[u.start : u.end] for u in units[0].u).replace("\n", "") == text.replace("\n", "")
    assert units[0].u[-1].role == "C" and units[1].u == units[2].u == []


def test_patch_span():
    assert U.patch_span("a b c b", "b", "X") == "a X c b"
    assert U.patch_span("the fever had gone away then", "fever has gone", "Y") == "the Y away then"
    assert U.patch_span("nothing here", "something else entirely", "Y") is None


def test_align_fragments():
    assert U.align_fragments("a  b\nc a b", ["a b", "a b"]) == [(0, 4), (7, 10)]
    assert U.align_fragments("a b", ["b", "a"]) is None
    assert U.align_fragments("a b", [" "]) is None


def test_last_label(spark):
    cells = ["A or B? Answer: b. Answer is (C)", "Final answer: D", "A\nB", "none"]
    got = spark.createDataFrame([(c,) for c in cells], "c string").select(U.last_label(F.col("c")).alias("x")).collect()
    assert [r.x for r in got] == ["C", "D", "B", None]


def test_priority_fill(spark):
    df = spark.createDataFrame([(f"{b}{i}", b, i) for b in "xy" for i in range(5)] + [("z0", "z", 0)], "id string, b string, s int")
    got = {r.id: r.fill_rank for r in U.priority_fill(df, "b", ["y", "x"], {"x": 2, "y": 1}, 5, [F.col("s")]).collect()}
    assert got == {"y0": 1, "x0": 2, "x1": 3, "y1": 4, "y2": 5}


def test_best_sentences(spark):
    df = spark.createDataFrame([("One liver. Two fever cough. Three. Four fever.", "fever cough"), (None, "x")], "t string, q string")
    assert [r.x for r in df.select(U.best_sentences(F.col("t"), F.col("q")).alias("x")).collect()] == ["Two fever cough. Four fever.", ""]


def test_score_pairs(spark):
    df = spark.createDataFrame([(1, "a b", "a c"), (2, "", "x"), (3, None, "x")], "id long, p string, c string")
    got = U.score_pairs(df, ["id"], "p", "c", U.overlap_stub).collect()
    assert [(r.id, r.entailment) for r in got] == [(1, pytest.approx(0.5))]


def test_high_risk_and_disagreement(spark):
    r = spark.range(1).select(
        U.high_risk(F.lit(0.9), F.lit(0.1), F.array(F.lit(0.1), F.lit(0.8), F.lit(0.2))).alias("a"), U.disagreement(F.lit("x"), F.lit("x"), F.lit(1), F.lit(3)).alias("b"), U.disagreement(F.lit("x"), F.lit(None), F.lit(1), F.lit(2)).alias("c")
    ).first()
    assert r.a is True and r.b == "score" and r.c is None
