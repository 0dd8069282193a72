"""Endings, defects, languages, leaks, near pairs and packing on small made-up texts."""

import random

import numpy as np
import pytest

from millrace.llm import crosssplit as N
from millrace.llm import defects as D
from millrace.llm import endings as E
from millrace.llm import langid as L
from millrace.llm import leaks as Q
from millrace.llm import packing as P

WORDS = "fever cough liver kidney renal biopsy patient history tender nausea lesion marrow median trial stroke apex murmur joint serum sodium potassium rash vision pulse gait tremor sweat urine ankle spine lobe valve".split()


def sentence(rng, n=9):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def test_endings(spark):
    rng = random.Random(4)
    rows = [(str(i), "f", " ".join(sentence(rng) for _ in range(4)) + "\nFinal answer: " + rng.choice(["lung abscess", "renal stroke"])) for i in range(60)]
    rows += [("cut", "f", sentence(rng) + " The patient hist"), ("marked", "f", sentence(rng) + " Tender liv [truncated]"), ("broken", "f", "Fever and co�"), ("entity", "f", "It was &#x2"), ("comma", "f", "He came,"), ("full", "f", "He came."), ("null", "f", None), ("blank", "f", "  ")]
    got = {r.k: r.truncated for r in E.judge_endings(spark.createDataFrame(rows + rows[:2], "k string, g string, t string"), ["k"], "g", "t").collect()}
    assert {k for k, v in got.items() if v} == {"cut", "marked", "broken", "entity", "comma"}
    assert len(got) == 66
    assert E.judge_endings(spark.createDataFrame([], "k string, g string, t string"), ["k"], "g", "t").count() == 0


def test_copies_are_no_evidence_of_an_ending(spark):
    rng = random.Random(8)
    rows = [(str(i), "f", " ".join(sentence(rng) for _ in range(4)) + " The patient history told it") for i in range(30)]
    rows += [(str(100 + i), "f", " ".join(sentence(rng) for _ in range(4)) + " Seen by the patient histology " + rng.choice(WORDS) + ".") for i in range(30)]
    cut = sentence(rng) + " Tremor and sweat, then rash and pulse, for which the patient hist"
    rows += [(f"cut{i}", "f", cut) for i in range(12)]
    got = {r.k: r.truncated for r in E.judge_endings(spark.createDataFrame(rows, "k string, g string, t string"), ["k"], "g", "t").collect()}
    assert {k for k, v in got.items() if v} == {f"cut{i}" for i in range(12)}
    lone = [(str(i), "f", " ".join(sentence(rng) for _ in range(3)) + " The patient hist") for i in range(5)] + [(f"full{i}", "f", sentence(rng) * 2 + " The patient history.") for i in range(20)] + [("odd", "f", sentence(rng) + " qzxv")]
    got = {r.k: r.truncated for r in E.judge_endings(spark.createDataFrame(lone, "k string, g string, t string"), ["k"], "g", "t").collect()}
    assert got["odd"] and not got["full0"]


def test_defect_kinds():
    asked = D.Prompt("A man of 45 years presents with fever and a cough after a trial of lithium for two weeks at home.")
    assert D.defect_of(asked, None) == D.defect_of(asked, " ​") == D.defect_of(asked, "N/A") == "empty"
    assert D.defect_of(asked, asked.text.upper()) == "copy"
    assert D.defect_of(asked, "I'm sorry, but I can't provide medical advice.") == "refusal"
    assert D.defect_of(asked, "Der Patient ist 45 Jahre alt und klagt seit zwei Wochen über Fieber und Husten.") == "language"
    assert D.defect_of(asked, "患者因发热来诊，考虑肺脓肿的可能性较大。") == "language"
    assert D.defect_of(asked, "Lung abscess.") is None
    assert D.defect_of(asked, "I am unable to confirm lung abscess from imaging alone. The patient declined a biopsy, so it stays open.") is None
    assert D.defect_of(None, "Lung abscess.") is None


def test_suffix_automaton_against_brute_force():
    rng = random.Random(7)
    for _ in range(60):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(14))] for _ in range(2))
        runs = {tuple(a[i : i + 3]) for i in range(len(a) - 2)}
        covered = {j for i in range(len(b) - 2) if tuple(b[i : i + 3]) in runs for j in range(i, i + 3)}
        assert D.SuffixAutomaton(a).covered(b, 3) == len(covered)


def test_pair_defects_edges(spark):
    rows = [("a", None, None, "Fine then."), ("a", None, None, "Fine then."), ("b", "Why?", "", "null")]
    got = sorted((r.id, r.field, r.defect) for r in D.pair_defects(spark.createDataFrame(rows, "id string, prompt string, chosen string, rejected string")).collect())
    assert got == [("a", "chosen", "empty"), ("b", "chosen", "empty"), ("b", "rejected", "empty")]


SPOKEN = {
    "en": "The patient was seen in the morning and the fever had gone. There was no sign of the infection that they had feared. ",
    "de": "Der Patient wurde am Morgen gesehen und das Fieber war verschwunden. Es gab kein Zeichen der Infektion, die man befürchtet hatte. ",
    "fr": "Le patient a été vu le matin et la fièvre avait disparu. Il n'y avait aucun signe de l'infection que l'on craignait. ",
    "zh": "患者于早晨就诊，发热已经消退。没有发现所担心的感染的迹象。",
}


def test_languages(spark):
    rows = [(i, t * 3, lang) for i, (lang, t) in enumerate(list(SPOKEN.items()) * 4)]
    rows += [(100, SPOKEN["en"] * 2 + SPOKEN["zh"], "en"), (101, SPOKEN["de"], "English"), (102, "", "en"), (103, None, None), (104, "123 ...", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = L.fit_from(df, "doc_id", "text", "lang")
    got = {r.doc_id: {x.lang for x in r.langs} for r in L.document_languages(L.detect(df, ["doc_id"], "text", filters), ["doc_id"]).collect()}
    assert all(got[i] == {lang} for i, _, lang in rows[:16])
    assert got[100] == {"en", "zh"} and got[101] == {"de"} and got[102] == got[103] == got[104] == set()
    labels = spark.createDataFrame([(x,) for x in ("en_US", "ZH-Hans", "German", "und", "??", " ", None, "nl")], "l string").select(L.label_language(L.F.col("l")).alias("x")).collect()
    assert [r.x for r in labels] == ["en", "zh", "de", None, None, None, None, "nl"]


def test_leaks(spark):
    rng = random.Random(9)
    items = [(f"q{i}", " ".join(sentence(rng) for _ in range(8))) for i in range(6)]
    passage = " ".join(items[2][1].split()[10:42])
    noisy = passage.upper().replace(" ", "\n", 3).replace("e", "é", 1)
    docs = [(1, sentence(rng) + " " + noisy + " " + sentence(rng)), (2, " ".join(items[3][1].split()[:10])), (3, sentence(rng) * 5), (4, None), (5, items[4][1]), (5, items[4][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in Q.find_leaks(frame, "doc_id", "text", spark.createDataFrame([*items, ("null", None)], "id string, question string"), "id", "question", block=4).collect()}
    assert got == {(1, "q2"), (5, "q4")}
    assert Q.find_leaks(frame.limit(0), "doc_id", "text", spark.createDataFrame(items, "id string, question string"), "id", "question").count() == 0


def found_share(docs, items):
    index = Q.build_index([str(i) for i in range(len(items))], items)
    return sum(str(i) in {x[0] for x in f} for i, f in enumerate(Q.scan(docs, index))) / len(docs)


@pytest.mark.parametrize("running,every", [(26, 0), (26, 26), (30, 15), (40, 12), (40, 8)])
def test_edited_passages_are_leaks(running, every):
    rng = random.Random(running + every)
    listed = ["".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randrange(3, 11))) for _ in range(3000)]
    items = [" ".join(rng.choice(listed) for _ in range(90)) for _ in range(60)]
    docs = []
    for t in items:
        at = rng.randrange(90 - running)
        passage = t.split()[at : at + running]
        for i in range(0, running - every + 1, every) if every else ():
            passage[i + rng.randrange(every)] = rng.choice(listed)
        if running == 40:  # an interruption
            passage.insert(20, "page 7 of 31")
        docs.append(" ".join([rng.choice(listed) for _ in range(30)] + passage + [rng.choice(listed) for _ in range(30)]))
    assert found_share(docs, items) >= 0.9
    assert found_share(docs[1:], items[:-1]) == 0


def test_a_chinese_passage_is_a_leak():
    rng = random.Random(5)
    items = ["".join(chr(0x4E00 + rng.randrange(900)) + ("，" if rng.random() < 0.1 else "") for _ in range(400)) for _ in range(30)]
    docs = ["".join(chr(0x4E00 + rng.randrange(900)) for _ in range(200)) + t[100:190] + "".join(chr(0x4E00 + rng.randrange(900)) for _ in range(200)) for t in items]
    assert found_share(docs, items) == 1 and found_share([d[:200] + d[270:] for d in docs], items) == 0


def test_items_shorter_than_a_passage():
    index = Q.build_index(["a", "b", "c"], ["Which drug should be started first in gout?", "", "x"])
    got = Q.scan(["Asked: which drug should be started first in gout? None.", "which drug should be started", "", "x"], index)
    assert [[x[0] for x in f] for f in got] == [["a"], [], [], []]


def edit(rng, words, share):
    out = list(words)
    for _ in range(int(len(words) * share)):
        out[rng.randrange(len(out))] = "x" + rng.choice(WORDS)
    return out


def test_near_pairs_against_brute_force(spark):
    rng = random.Random(11)
    base = [[w for _ in range(8) for w in sentence(rng, 12).lower().rstrip(".").split()] for _ in range(30)]
    rows = [(i, "train", " ".join(b)) for i, b in enumerate(base)]
    expected = set()
    for i in range(0, 30, 3):
        rows.append((100 + i, "val", " ".join(edit(rng, base[i], 0.06)).upper()))
        rows.append((200 + i, "Test", " ".join(base[i][12:])))
        rows.append((300 + i, "test", " ".join(base[i][12:60] + base[i][:12] + base[i][60:])))
        rows.append((400 + i, "val", " ".join(base[i][:48] + [rng.choice(WORDS) for _ in range(48)])))
        expected |= {(100 + i, i), (200 + i, i), (300 + i, i)}
    rows += [(900, "val", None), (901, "train", ""), (902, None, rows[0][2]), (903, "dev", "short text"), (904, "train", "Short, text!"), (904, "train", "Short, text!")]
    got = {(r.held_id, r.train_id) for r in N.cross_split_overlaps(spark.createDataFrame(rows, "sample_id long, split string, patient_context string")).collect()}
    assert got == expected | {(903, 904)}


def test_near_copies_whose_edits_others_share(spark):
    rng = random.Random(12)
    listed = [f"w{i}" for i in range(4000)]
    rows, expected = [], set()
    for f in range(12):
        plain = [rng.choice(listed) for _ in range(140)]
        edited = list(plain)
        for i in range(rng.randrange(9), 140, 9):  # one word in nine
            edited[i] = rng.choice(listed)
        rows += [(f, "val", " ".join(edited)), (100 + f, "train", " ".join(edited) + " end"), (200 + f, "train", " ".join(plain))]
        expected |= {(f, 100 + f), (f, 200 + f)}
    got = {(r.held_id, r.train_id) for r in N.cross_split_overlaps(spark.createDataFrame(rows, "sample_id long, split string, patient_context string")).collect()}
    assert got == expected


def test_one_segment_more_than_the_edits_fits():
    for n in range(8, 2000):
        k, q = int(N.edits_borne(n)), int(N.segment_length(np.array([n]))[0])
        assert n // 8 <= k <= n // 8 + 1 and q in N.LENGTHS and (k + 1) * q <= n and (n < N.LONG * 0.5 or q == 7)


def test_segments_and_their_number(spark):
    rows = [(n, list(range(n)), 10) for n in (5, 8, 14, 30, 140)]
    taken = N.cut_segments(spark.createDataFrame(rows, "class long, tokens array<int>, reach int")).groupBy("cut").count().collect()
    assert {r["cut"]: r["count"] for r in taken} == {n: int(N.edits_borne(n)) + 1 for n, _, _ in rows if n >= 8}


def changed(rng, words, every):
    """The words with one in `every` changed, at places drawn anew for each stretch."""
    out = list(words)
    for i in range(0, len(out) - every + 1, every):
        out[i + rng.randrange(every)] = f"x{rng.randrange(10**9)}"
    return out


@pytest.mark.parametrize("cut", ["train", "held"])
@pytest.mark.parametrize("every", [8, 12])
def test_near_copies_at_the_limit_among_stock_sentences(spark, every, cut):
    rng = random.Random(every)
    stock = [sentence(rng, 14).lower() for _ in range(12)]
    rows, expected = [], set()
    for f in range(80):
        plain = " ".join(s.replace(".", f" {rng.randrange(90)}.") for s in rng.sample(stock, 8)).split()
        rows += [(f, "val", " ".join(changed(rng, plain, every))), (1000 + f, "train", " ".join(plain))]
        expected.add((f, 1000 + f))
    _, classes = N.classes_of(spark.createDataFrame(rows, "sample_id long, split string, patient_context string"), "sample_id", "split", "patient_context")
    assert expected <= {(r.held, r.train) for r in N.near_classes(classes, cut).collect()}


def test_one_long_chinese_sentence_more(spark):
    rng = random.Random(3)
    han = [chr(0x4E00 + i) for i in range(400)]
    speak = lambda n: "".join(rng.choice(han) for _ in range(n)) + "。"
    rows = []
    for f in range(10):
        parts = [speak(30) for _ in range(6)]
        at = rng.randrange(7)
        rows += [(f, "test", "".join([*parts[:at], speak(60), *parts[at:]])), (100 + f, "train", "".join(parts))]
    got = {(r.held_id, r.train_id) for r in N.cross_split_overlaps(spark.createDataFrame(rows, "sample_id long, split string, patient_context string")).collect()}
    assert got == {(f, 100 + f) for f in range(10)}


def test_sentence_left_out_or_moved_by_dynamic_programming():
    rng = random.Random(6)
    for _ in range(40):
        parts = [[rng.randrange(500) for _ in range(14)] for _ in range(7)]
        whole = np.array(sum(parts, []), dtype=np.int32)
        i, j = rng.sample(range(7), 2)
        less = np.array(sum(parts[:i] + parts[i + 1 :], []), dtype=np.int32)
        order = [p for p in range(7) if p != i]
        moved = np.array(sum((parts[p] for p in [*order[:j], i, *order[j:]]), []), dtype=np.int32)
        half = np.array(sum(parts[:4], []) + [rng.randrange(500, 900) for _ in range(42)], dtype=np.int32)
        assert N.near([whole, less, whole, whole], [less, whole, moved, half], [14] * 4).tolist() == [True, True, True, False]


def test_banded_distance():
    rng = random.Random(1)
    for _ in range(80):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 15))] for _ in range(2))
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                if not i or not j:
                    d[i][j] = i + j
                    continue
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        assert N.banded_distance([np.array(a, dtype=np.int32)], [np.array(b, dtype=np.int32)], 16)[0] == d[-1][-1]


@pytest.mark.parametrize("capacity", [32, 100])
def test_patterns_use_up_the_histogram(capacity):
    rng = np.random.default_rng(0)
    h = np.bincount(np.minimum(rng.geometric(0.1, 3000), capacity), minlength=capacity + 1)[1:]
    patterns = P.fit_patterns(h, capacity)
    assert (sum(p * n for p, n in patterns) == h).all()
    assert all((p * np.arange(1, capacity + 1)).sum() <= capacity for p, _ in patterns)
    sequences = sum(n for _, n in patterns)
    assert sequences <= 1.03 * (h * np.arange(1, capacity + 1)).sum() / capacity + 1


def test_pack_places(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(1, 70)) for i in range(300)] + [(1000, 250), (1001, 100), (1002, 0), (1003, None), (5, 1)]
    got = P.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), "doc_id", capacity=100, class_width=4).collect()
    used = {}
    for r in got:
        if r.sequence is not None:
            used.setdefault(r.sequence, []).append((r.position, r.position + r.n_tokens))
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 100 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert sum(r.n_tokens for r in got if r.doc_id == 1000) == 250 and len([r for r in got if r.doc_id == 1000]) == 3
    assert {r.doc_id for r in got if r.sequence is None} == {1002, 1003} and len({r.doc_id for r in got}) == 304
    assert {r.doc_id for r in P.oversized(spark.createDataFrame(got), "doc_id").collect()} == {1000}


def test_rolling_hashes_equal_those_of_ngrams():
    from millrace.llm.textarr import Ngrams, Rolling

    flat = np.random.default_rng(1).integers(0, 99, 5000).astype(np.uint32)
    at = np.arange(64, 5000)
    for n in (1, 2, 3, 8, 48, 64):
        assert (Rolling(flat).of(n, at) == Ngrams(flat).of(n)[at]).all()
