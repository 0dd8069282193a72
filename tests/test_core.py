"""Operators on small hand-made rows: edges, ties, nulls."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import arrays as A
from millrace.functions import text as X
from millrace.operators import metrics as M
from millrace.operators import relational as R
from millrace.operators import retrieval as V
from millrace.operators import sampling as S
from millrace.operators import scoring as C
from millrace.operators import spans as P
from millrace.sources import files
from millrace.streaming import ledger


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


def test_normalize_answer_collapses_before_dropping(spark):
    assert one(spark, X.normalize_answer(F.col("a")), a=" A -  Élève.\t") == "a  élève"
    assert one(spark, X.normalize_answer(F.col("a")), a=None) == ""


def test_match_score(spark):
    score = X.match_score(F.col("a"), F.col("b"))
    assert one(spark, score, a="Lung abscess.", b="lung  abscess") == 1.0
    assert one(spark, score, a="acute lung abscess", b="lung abscess") == 0.95
    assert one(spark, score, a="", b="x") == 0.0
    assert one(spark, score, a="a b", b="b c") == pytest.approx(1 / 3)


def test_response_parts(spark):
    p = X.response_parts(F.col("a"))
    assert tuple(one(spark, p, a="Because.\nFINAL answer: x\nFinal answer: y")) == ("Because.", "x\nFinal answer: y")
    assert tuple(one(spark, p, a="no marker")) == ("no marker", "")


def test_truncate_counts_code_points(spark):
    assert one(spark, X.truncate(F.col("a"), 6), a="ab cdefg") == "ab..."
    assert one(spark, X.truncate(F.col("a"), 6), a="😀😀😀😀😀😀") == "😀😀😀😀😀😀"


def test_array_functions(spark):
    df = spark.createDataFrame([([0.2, 0.9, 0.9],), ([],), ([0.0, 0.0],)], "a array<double>")
    rows = df.select(A.first_argmax(F.col("a")).alias("i"), A.mean(F.col("a")).alias("m"), A.normalized_weights(F.col("a")).alias("w")).collect()
    assert [r.i for r in rows] == [1, None, 0]
    assert rows[1].m == 0
    assert sum(rows[0].w) == pytest.approx(3) and rows[2].w == [1.0, 1.0]


def test_upsert_passes_null_keys(spark):
    base = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), (None, 9, 1)], "id string, v int, t int")
    delta = spark.createDataFrame([("a", 5, 0), ("a", 6, 1)], "id string, v int, t int")
    got = sorted((r.id or "", r.v) for r in R.upsert(base, delta, ["id"], "t").collect())
    assert got == [("", 9), ("a", 6), ("b", 2)]


def test_classify_joins_keeps_row_counts(spark):
    left = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "id string")
    other = spark.createDataFrame([("a",), ("a",)], "id string")
    got = sorted(str(r.skip_reason) for r in R.classify_joins(left, "id", {"x": other}).collect())
    assert got == ["None", "None", "missing_x", "null_key"]


def test_mid_ranks_and_holm(spark):
    df = spark.createDataFrame([("g", 1.0, "a"), ("g", 1.0, "b"), ("g", 2.0, "c")], "g string, v double, k string")
    assert sorted(r.mid_rank for r in R.mid_ranks(df, ["g"], "v").collect()) == [1.5, 1.5, 3.0]
    p = spark.createDataFrame([("g", 0.01, "a"), ("g", 0.04, "b"), ("g", 0.03, "c"), ("g", None, "d")], "g string, p double, k string")
    got = {r.k: r.p_holm for r in R.holm(p, ["g"], "p", "k").collect()}
    assert got["a"] == pytest.approx(0.03) and got["c"] == pytest.approx(0.06) and got["b"] == pytest.approx(0.06) and got["d"] is None


def test_keep_or_best(spark):
    df = spark.createDataFrame([("s", "a", 0.9), ("s", "b", 0.1), ("t", "c", 0.2), ("t", "d", 0.2), ("u", "e", None)], "s string, id string, r double")
    assert {r.id for r in R.keep_or_best(df, ["s"], "r", 0.5, ["id"]).collect()} == {"a", "c", "e"}


def test_published_mcnemar_values():
    pairs = [(17, 22), (16, 22), (14, 20), (13, 20), (13, 19), (11, 17)]
    assert [round(M.sign_test_p(*x), 3) for x in pairs] == [0.522, 0.418, 0.392, 0.296, 0.377, 0.345]
    assert M.sign_test_p(0, 0) == 1.0


def test_published_confusion(spark):
    counts = [[60, 4, 0], [6, 46, 6], [2, 8, 28]]
    rows = [(str(i), str(j)) for i in range(3) for j in range(3) for _ in range(counts[i][j])]
    m = M.confusion(spark.createDataFrame(rows, "g string, p string"), "g", "p", ["0", "1", "2"])
    got = {r.label: r for r in M.precision_recall(m).collect()}
    assert round(got["0"].precision, 3) == 0.882 and round(got["0"].recall, 4) == 0.9375
    assert round(sum(r.f1 for r in got.values()) / 3, 3) == 0.827


def test_wilcoxon_against_enumeration(spark):
    d = [1.5, -0.5, 2.0, 3.0, -1.0, 0.0]
    got = M.wilcoxon_exact(spark.createDataFrame([("g", x) for x in d], "g string, d double"), ["g"], "d").first()
    assert got.n == 5 and got.w == 12 and got.p == pytest.approx(0.3125)


def test_bootstrap_contains_mean(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([("g", str(i), rng.random()) for i in range(200)], "g string, k string, v double")
    r = M.bootstrap_mean(df, ["g"], "v", "k", 100).first()
    assert r.low < r["mean"] < r.high and r.high - r.low < 0.2


def test_largest_remainder():
    assert S.largest_remainder({"a": 60, "b": 30, "c": 10}, 10) == {"a": 6, "b": 3, "c": 1}
    q = S.largest_remainder({"a": 100, "b": 2, "c": 0}, 50, 1)
    assert sum(q.values()) == 50 and q["b"] >= 1 and q["c"] == 0
    assert S.largest_remainder({"a": 3}, 10) == {"a": 3}


def test_nested_stages(spark):
    df = spark.createDataFrame([("g", str(i)) for i in range(50)], "g string, id string")
    small = {r.id for r in S.nested_stages(df, "g", "id", {"s": 3}, "x").collect()}
    both = {r.id: r.stage for r in S.nested_stages(df, "g", "id", {"s": 3, "l": 20}, "x").collect()}
    assert small == {k for k, v in both.items() if v == "s"} and len(both) == 20


def test_dense_top_k_against_brute_force(spark):
    rng = random.Random(3)
    vecs = {i: [rng.uniform(-1, 1) for _ in range(8)] for i in range(60)}
    df = spark.createDataFrame([(i, v) for i, v in vecs.items()] + [(99, None)], "id long, v array<float>")
    got = {(r["query"], r["rank"]): r.doc for r in V.dense_top_k(df.filter("id < 7"), df, "id", "v", 5, block=3).collect()}
    for q in range(7):
        order = sorted((i for i in vecs if i != q), key=lambda i: -sum(a * b for a, b in zip(vecs[q], vecs[i])))
        assert [got[(q, r)] for r in range(1, 6)] == order[:5]


def test_tfidf_join_finds_equal_texts(spark):
    held = spark.createDataFrame([("h", "lung abscess")], "k string, t string")
    train = spark.createDataFrame([("a", "Lung abscess"), ("b", "thyroid storm")], "k string, t string")
    got = V.tfidf_join(held, train, "k", "t").collect()
    assert [(r.held, r.train) for r in got] == [("h", "a")] and got[0].cosine == pytest.approx(1.0)


def test_tfidf_join_against_brute_force(spark):
    def grams(t):
        out = {}
        for word in t.lower().split():
            w = f" {word} "
            for n in (3, 4, 5):
                for i in range(max(1, len(w) - n + 1)):
                    out[w[i : i + n]] = out.get(w[i : i + n], 0) + 1
                if len(w) <= n:
                    break
        return out

    rng = random.Random(6)
    listed = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(60)] + ["".join(rng.choice("咳发热痛肝肾肺心") for _ in range(12)) for _ in range(20)]
    train = [(i, " ".join(rng.choice(listed) for _ in range(rng.randrange(3, 30)))) for i in range(80)] + [(900, None), (901, "")]
    train += [(200 + i, train[3][1].upper()) for i in range(7)]
    held = [(1000 + i, " ".join(w for w in train[i][1].split() if rng.random() < 0.85)) for i in range(40)] + [(2000, None), (2001, "zzzz")]
    count = {}
    for _, t in train:
        for g in grams(t or ""):
            count[g] = count.get(g, 0) + 1
    idf = {g: math.log((1 + len(train)) / (1 + n)) + 1 for g, n in count.items()}

    def vector(t):
        v = {g: c * idf[g] for g, c in grams(t or "").items() if g in idf}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {g: x / norm for g, x in v.items()}

    vectors = [(j, vector(t)) for j, t in train]
    expected = {}
    for i, t in held:
        x = vector(t)
        scores = sorted((-round(sum(w * y.get(g, 0) for g, w in x.items()), 9), j) for j, y in vectors)
        expected |= {(i, j): (-s, r) for r, (s, j) in enumerate(scores[:5], 1) if -s >= 0.75}
    frames = (spark.createDataFrame(rows, "k long, t string") for rows in (held + held[:2], train))
    got = {(r.held, r.train): (r.cosine, r.rank) for r in V.tfidf_join(*frames, "k", "t", block=16).collect()}
    assert got.keys() == expected.keys() and len({j for _, j in got}) > 20
    assert all(r == expected[p][1] and c == pytest.approx(expected[p][0], abs=1e-8) for p, (c, r) in got.items())


def test_tfidf_bounds_keep_near_pairs_of_all_scripts_and_few_others():
    rng = random.Random(3)
    latin, han = (["".join(rng.choice(c) for _ in range(n)) for _ in range(150)] for c, n in (("abcdefghijklmnop", 7), ("咳发热痛肝肾肺心血压脑胃", 5)))
    texts = [" ".join(rng.choice(w) for _ in range(40)) for w in (latin, han, latin + han) for _ in range(100)]
    texts += [t.replace(t.split()[0], "é", 1) for t in texts[::4]] + ["", "zz"]
    grams = np.concatenate([np.unique(np.concatenate([V._word_grams(w, (3, 4, 5)) for w in t.split()])) for t in texts if t])
    hashes, n = np.unique(grams, return_counts=True)
    weights = V._Weights(hashes, np.log((1 + len(texts)) / (1 + n)) + 1, (3, 4, 5))
    for script in (0, 1):
        weights.fit(script, texts)
    x = np.zeros((len(texts), len(hashes)))
    for i, t in enumerate(texts):
        u, w = weights.vector(t)
        x[i, u] = w
    z = [[None if v is None else v.astype(np.float16).tobytes() for v in weights.coordinates(t)] for t in texts]
    side = V._Side([[v[s] for v in z] for s in (0, 1)])
    left = {p for i, j in side.near(side, 0.75 - V.SLACK) for p in zip(i.tolist(), j.tolist())}
    near = set(zip(*(v.tolist() for v in np.nonzero(x @ x.T >= 0.75))))
    assert near <= left and len(near) > len(texts) and len(left) < 2 * len(near)


def test_claim_history_quotas(spark):
    said = ["fever of two weeks", "chest pain at rest", "anemia often causes fatigue", "weight loss points to cancer", "iron loss explains pallor", "it is gastric cancer", "it is colon cancer", "the colon cancer is consistent with pallor"]
    units = [("x", i, k, s, t) for i, ((k, s), t) in enumerate(zip([("O", 0.1), ("O", 0.9), ("W", 0.0), ("D", 0.5), ("W", 0.6), ("C", 0.2), ("C", 0.4), ("C", 0.3)], said))]
    got = {r.pos: r.premise.split("\n") for r in C.claim_history(spark.createDataFrame(units, "id string, pos int, kind string, score double, text string"), "id", "pos", "kind", "score", "text").collect()}
    theories = ["[O] " + said[0], "[O] " + said[1], "[W] " + said[2], "[D] " + said[3]]
    assert got == {5: theories, 6: [*theories, "[C] " + said[5]], 7: [*theories, "[C] " + said[5]]}


def test_premise_gates():
    assert C.premise_of([("O", "scan", 0.0, False), ("O", "in the liver", 0.0, False), ("O", "fever", 0.0, True)], "it is gout") == ""
    assert C.premise_of([("O", "cultures grew nothing", 0.0, False)], "sepsis was ruled out") == ""
    assert C.premise_of([("O", "cultures were negative today", 0.0, False)], "sepsis was ruled out") == "[O] cultures were negative today"
    old = [("C", "gout comes first", 0.1, False), ("W", "x likes y", 0.9, False), ("W", "y likes z", 0.9, False)]
    assert C.premise_of(old, "it is gout") == "[C] gout comes first"  # too far back but for the fallback


def test_sequence_similarity_compares_canonical_reasoning(spark, tmp_path):
    from millrace.plans.registry import QUERIES

    assert one(spark, X.similarity_text(F.col("c")), c=" 1. The “Liver”\n 12) isn’t 3.5 cm; see (2) here. 4. Then") == 'the "liver" isn\'t 3.5 cm; see ( here. then'
    long = "The patient’s fever began. " * 12
    rows = [("a", long, long.upper().replace("’", "'"), "x", "y"), ("b", "1. abcd", "bcde", "x", "x"), ("c", "abcd", None, "x", "x")]
    df = spark.createDataFrame(rows, "id string, reasoning string, negative_reasoning string, final_answer string, negative_final_answer string").withColumn("ingested_at", F.lit(0))
    df.union(df).write.parquet(f"{tmp_path}/negative_pair.parquet")
    got = {r.id: r.ratio for r in QUERIES["sequence_similarity"](spark, str(tmp_path)).collect()}
    assert got == {"a": 1.0, "b": pytest.approx(0.75), "c": 0.0}


def test_drop_contained(spark):
    df = spark.createDataFrame([("g", 0, 10), ("g", 2, 5), ("g", 0, 10), ("g", 8, 12), ("h", 2, 5)], "g string, s int, e int")
    assert {(r.g, r.s, r.e) for r in P.drop_contained(df, "g", "s", "e").collect()} == {("g", 0, 10), ("g", 8, 12), ("h", 2, 5)}


def test_bipartite_matching(spark):
    df = spark.createDataFrame([("i", 1, 1), ("i", 1, 2), ("i", 2, 1), ("i", 3, 1)], "i string, g int, p int")
    assert P.bipartite_match(df, "i", "g", "p").first().n_matched == 2


def test_row_risk_bounds(spark):
    df = spark.createDataFrame([([1.0, 1.0],), ([],)], "a array<double>")
    got = df.select(C.row_risk(F.col("a")).alias("r"), C.row_risk(F.col("a"), "paper").alias("p")).collect()
    assert got[0].r == 1.0 and got[0].p == pytest.approx(1.0) and got[1].r == 0


def test_readers(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType())])
    (tmp_path / "a.jsonl").write_text('{"id":"x","n":1}\n\nbroken\n{"id":"y"}\n')
    good, bad = files.split_bad_rows(files.read_jsonl(spark, str(tmp_path / "a.jsonl"), schema, tolerant=True))
    assert {r.id for r in good.collect()} == {"x", "y"} and [r._corrupt_record for r in bad.collect()] == ["broken"]
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "a.jsonl"), schema).collect()
    (tmp_path / "b.csv").write_text('a,b\n"1\n2",\n')
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "b.csv")).collect()] == [("1\n2", "")]
    (tmp_path / "c.json").write_text('{"records":[{"id":"x"},{"id":"y"}]}')
    assert files.read_records(spark, str(tmp_path / "c.json")).count() == 2
    assert files.read_optional(spark, str(tmp_path / "none"), schema).count() == 0


def test_stream_takes_up_where_it_ended(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    spark.sql("select 'a' id, timestamp '2025-01-01 00:00:00' ts, 'ok' status union all select 'a', timestamp '2025-01-01 00:01:00', 'ok'").write.parquet(src)
    schema = spark.read.parquet(src).schema
    run = lambda: ledger.run_available(ledger.first_attempts(ledger.attempts(spark, src, schema), "id", "ts"), out, cp, "status")
    run()
    spark.sql("select 'b' id, timestamp '2025-01-02 00:00:00' ts, 'failed' status").write.mode("append").parquet(src)
    run()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_kappa_of_perfect_agreement(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "b"), ("a", None)], "x string, y string")
    r = M.kappa(df, "x", "y").first()
    assert r.n == 2 and r.kappa == 1.0 and not math.isnan(r.expected)
