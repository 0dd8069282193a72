"""Problem 5: responses that are no proper answer to their prompt.

Method: the suffix automaton of the prompt's words is traversed with the response, which gives the
share of the response that runs of copied words cover; an Aho-Corasick automaton finds phrases that
decline; votes of stop words, and of scripts, tell the language of both sides; a stack of delimiters
and the model of endings tell what breaks off. All of it reads whole texts. The automaton of a prompt is built only
where enough of the response's words stand in the prompt at all: the others can't be covered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.endings import judge_endings
from millrace.llm.textarr import HAN, INVISIBLE, arrow_fields, words

# Answers that say nothing, phrases that decline, stop words.
PLACEHOLDERS = frozenset(
    "null none nil n/a na nan tbd tba todo empty blank [] {} () <empty> <null> <none> [empty] [none] unknown undefined no answer 无 暂无 空 待定".split() + ["no answer", "not available", "to be done"]
)
DECLINING = ("can't", "cannot", "can not", "won't", "will not", "unable to", "not able to", "won't be able to", "must decline to", "have to decline to", "rather not", "prefer not to", "refuse to", "not going to", "not allowed to", "not permitted to", "does not", "do not", "don't")
ANSWERING = ("provide", "give", "offer", "assist", "help", "answer", "comment", "diagnose", "interpret", "discuss", "speculate", "advise", "suggest a", "respond", "comply", "share", "engage", "name a", "make a diagnosis", "opine", "fulfil", "fulfill")
REFUSALS = (
    "falls outside what i", "outside the scope of what i", "outside my scope", "beyond what i may", "guidelines keep me", "guidelines prevent", "guidelines do not allow",
    "against my usage", "against my rules", "against my guidelines", "against my policy", "against policy", "against our policy", "inappropriate for me", "not appropriate for me", "would be unsafe", "would be unethical",
    "would be irresponsible", "no diagnosis can be", "no answer can be", "no advice can be", "no opinion can be", "so none is given", "have to stop here", "not something i offer", "not something i can",
    "leave this question to", "leave this to the treating", "as an ai", "as a language model", "must decline", "i decline to", "have to decline", "decline to answer",
    "人工智能模型", "作为ai", "作为一个ai", "语言模型", "恕我", "抱歉，我", "对不起，我", "我不便", "但我不便", "我无法提供", "我无法回答", "我无法给出", "无法协助", "无法为您", "我不能回答", "我不能提供", "我不能给出", "不能给出任何",
    "超出了我", "超出我", "不在我的服务范围", "不在我的范围", "拒绝回答", "请求超出",
    "ich kann leider keine", "kann ich leider nicht", "kann ich nicht beantworten", "darf ich nicht", "je ne peux pas", "je ne suis pas en mesure", "no puedo dar", "no puedo ofrecer", "no puedo ayudar", "no puedo responder", "não posso dar", "não posso ajudar", "não posso responder",
)
STOPWORDS = {
    "en": "the of and in is was with for to on by that which but not from are were has had this than should after because",
    "de": "der die das und ist nicht mit von den dem ein eine bei nach zu im auf wurde werden sich oft über wir bis hat",
    "fr": "le la les des du et est une dans avec pour par sur pas aux nous chez sont plus après reste au ne l'absence",
    "es": "el los las del y es una con por para en que se fue sin como no más tras desde todavía su la",
    "pt": "o os as do da dos das e é uma com por para em que se foi não como mais depois ainda nas ao",
}
_PLAIN_REFUSALS = frozenset(REFUSALS)
COPY_SHARE, COPY_OF_PROMPT, COPY_RUN = 0.7, 0.5, 3

_HAN_RUN = re.compile(f"[{HAN}]+")


@cache
def refusal_automaton() -> ahocorasick.Automaton:
    """One automaton over the fixed phrases and all pairs of declining and answering."""
    out = ahocorasick.Automaton()
    for phrase in (*REFUSALS, *(f"{a} {b}" for a in DECLINING for b in ANSWERING)):
        out.add_word(phrase, phrase)
    out.make_automaton()
    return out


@cache
def _votes() -> dict[str, tuple[str, ...]]:
    out: dict[str, tuple[str, ...]] = {}
    for lang, listed in STOPWORDS.items():
        for w in listed.split():
            out[w] = (*out.get(w, ()), lang)
    return out


def is_empty(text: str | None) -> bool:
    """Nothing, only white space or invisible characters, only marks, or a placeholder."""
    if text is None:
        return True
    if len(text) > 40:
        return not INVISIBLE.sub("", text).strip()
    bare = INVISIBLE.sub("", text).strip().lower()
    return bare.rstrip(".") in PLACEHOLDERS or not any(c.isalnum() for c in bare)


_SENTENCE_EDGE = re.compile(r"[.!?。！？]\s|[。！？\n]")
_SPEAKER = re.compile(r"\b(?:i|i'm|i'd|we|this assistant|this service)\b")


def _sentence_around(low: str, at: int) -> str:
    """The sentence of `low` that holds the place `at`."""
    begin = max((low.rfind(mark, 0, at) for mark in (". ", "! ", "? ", "。", "！", "？", "\n")), default=-1) + 1
    end = _SENTENCE_EDGE.search(low, at)
    return low[begin : end.start() if end else len(low)]


def declines(text: str) -> bool:
    """Whether a phrase that declines stands anywhere in the text; phrases that clinical texts also use must have a speaker in their sentence."""
    low = text.lower().replace("’", "'")
    for end, phrase in refusal_automaton().iter(low):
        if phrase in _PLAIN_REFUSALS:
            return True
        sentence = _sentence_around(low, end)
        if "assistant" in sentence if phrase.startswith(("does not", "do not", "don't")) else _SPEAKER.search(sentence):
            return True
    return False


def language_of(text: str) -> str | None:
    """Two-letter code by script and stop-word votes; null where they don't tell."""
    listed = text.lower().split()
    if not text.isascii():
        han = sum(map(len, _HAN_RUN.findall(text)))
        if han >= 8 and han > 2 * sum(w.isascii() and w.isalpha() for w in listed):
            return "zh"
    count = dict.fromkeys(STOPWORDS, 0)
    votes = _votes()
    for w in listed:
        if w in votes:
            for lang in votes[w]:
                count[lang] += 1
    first, second = sorted(count.values(), reverse=True)[:2]
    if first < 3 or first < 1.25 * second:
        return None
    return max(count, key=count.__getitem__)


class SuffixAutomaton:
    """Suffix automaton of a sequence, for the longest match that ends at each place of another."""

    def __init__(self, seq: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for x in seq:
            cur = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and x not in self.next[p]:
                self.next[p][x] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][x]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(x) == q:
                        self.next[p][x] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def covered(self, seq: list[str], run: int) -> int:
        """How many elements of `seq` lie in runs of at least `run` that the automaton's sequence has."""
        state = matched = total = 0
        edge = 0  # everything before it is counted
        for i, x in enumerate(seq):
            while state and x not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if x in self.next[state]:
                state, matched = self.next[state][x], matched + 1
            else:
                matched = 0
            if matched >= run:
                total += i + 1 - max(edge, i + 1 - matched)
                edge = i + 1
        return total


class Prompt:
    """A prompt with what is only built when a response needs it."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.words = words(text)
        self.vocabulary = set(self.words)
        self._automaton: SuffixAutomaton | None = None
        self._lang: str | None = ""

    @property
    def lang(self) -> str | None:
        if self._lang == "":
            self._lang = language_of(self.text)
        return self._lang

    def copied_by(self, text: str) -> bool:
        least = max(1, COPY_OF_PROMPT * len(self.words))
        if len(text) < least:  # a word has a character at least
            return False
        theirs = words(text)
        need = max(least, COPY_SHARE * len(theirs))
        # Words that the prompt has not at all can't be covered.
        if len(theirs) < least or sum(map(self.vocabulary.__contains__, theirs)) < need:
            return False
        if self._automaton is None:
            self._automaton = SuffixAutomaton(self.words)
        return self._automaton.covered(theirs, min(COPY_RUN, len(self.words))) >= need


_DELIMITER = re.compile(r"[()\[\]{}（）【】“”「」]")
_CLOSING = {")": "(", "]": "[", "}": "{", "）": "（", "】": "【", "”": "“", "」": "「"}
_FULL_STOP = re.compile(r"[.!?][\"'”’)\]]*\s|[。！？]")


def unclosed(text: str) -> bool:
    """Whether a bracket or quotation opened in the text's last sentence is still open at the end, or a code block anywhere."""
    stack: list[tuple[str, int]] = []
    for m in _DELIMITER.finditer(text):
        c = m[0]
        if c not in _CLOSING:
            stack.append((c, m.start()))
        elif stack and stack[-1][0] == _CLOSING[c]:
            stack.pop()
    if text.count("```") % 2:
        return True
    return bool(stack) and not _FULL_STOP.search(text, stack[-1][1])


def defect_of(prompt: Prompt | None, text: str | None) -> str | None:
    """The defect that the pair shows by itself: empty, copy, refusal, language, or truncated by its delimiters."""
    if is_empty(text):
        return "empty"
    if prompt and prompt.copied_by(text):
        return "copy"
    if declines(text):
        return "refusal"
    if prompt:
        theirs = language_of(text)
        if theirs and prompt.lang and theirs != prompt.lang:
            return "language"
    return "truncated" if unclosed(text) else None


def pair_defects(df: DataFrame, key: str = "id", prompt: str = "prompt", fields: tuple[str, ...] = ("chosen", "rejected")) -> DataFrame:
    """(key, field, defect) of each response that is no proper answer, at most one a response.

    Null, blank and placeholder responses are `empty`; a null or blank prompt allows no copy and no
    language defect. The first of empty, copy, refusal, language, truncated holds. Repeated rows of a key
    give one result. Only the key, prompt and fields are read; an empty table gives none.
    """
    own = df.select(F.col(key).alias("_key"), F.col(prompt).alias("_prompt"), *(F.col(f).alias(f"_{i}") for i, f in enumerate(fields)))
    schema = T.StructType([own.schema["_key"], T.StructField("field", T.StringType()), T.StructField("defect", T.StringType())])
    arrow = pa.schema([*arrow_fields(own.select("_key")), ("field", pa.string()), ("defect", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prompts = batch.column("_prompt").to_pylist()
            sides = [batch.column(f"_{i}").to_pylist() for i in range(len(fields))]
            at, named, found = [], [], []
            for i, p in enumerate(prompts):
                asked = Prompt(p) if p and p.strip() else None
                for f, side in zip(fields, sides):
                    if d := defect_of(asked, side[i]):
                        at.append(i)
                        named.append(f)
                        found.append(d)
            yield pa.RecordBatch.from_arrays([batch.column("_key").take(pa.array(at, pa.int64())), pa.array(named, pa.string()), pa.array(found, pa.string())], schema=arrow)

    own_defects = own.mapInArrow(run, schema)
    sides = own.select("_key", F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"_{i}").alias("text")) for i, f in enumerate(fields)))))
    ends = judge_endings(sides, ["_key"], "field", "text").filter("truncated").select("_key", "field", F.lit("truncated").alias("defect"))
    order = F.array_position(F.array(*map(F.lit, ("empty", "copy", "refusal", "language", "truncated"))), F.col("defect"))
    return own_defects.unionByName(ends).groupBy(F.col("_key").alias(key), "field").agg(F.min_by("defect", order).alias("defect"))
