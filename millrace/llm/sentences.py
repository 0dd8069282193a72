"""Where paragraphs and sentences end, as character offsets."""

from __future__ import annotations

import re

# Words whose full stop doesn't close a sentence.
ABBREVIATIONS = frozenset(
    """approx vs no nos dr mr mrs ms prof st fig figs eq ref refs vol pp al eg ie cf ca etc
    inc ltd jr sr dept est min max resp sec ch ed eds tab bzw usw vgl evtl ggf sog num art
    """.split()
)

#: A break of lines with nothing but white space up to the next one.
BLANK_LINES = re.compile(r"(?:\r\n|\r|\n)[^\S\r\n]*(?:(?:\r\n|\r|\n)[^\S\r\n]*)+")
_CLOSERS = r"[\"'”’»)\]}」』）】]*"
_END = re.compile(rf"[。！？]+{_CLOSERS}\s*|[.!?…]+{_CLOSERS}(?:\s+|$)")
_WORD_BEFORE = re.compile(r"([^\W_]+(?:\.[^\W_]+)*)$")


def closes(text: str, at: int) -> bool:
    """Whether the full stop at `at`, followed by white space or nothing, closes its sentence.

    It doesn't after a known abbreviation, a single initial such as in "J. Smith", or a list number
    that opens its line.
    """
    before = _WORD_BEFORE.search(text, max(0, at - 24), at)
    if not before:
        return True
    word = before[1]
    low = word.lower()
    if low in ABBREVIATIONS or "." in low and all(len(x) == 1 and x.isalpha() for x in low.split(".")):
        return False
    line = text.rfind("\n", 0, before.start()) + 1
    if word.isdigit() and len(word) <= 3 and not text[line : before.start()].strip():
        return False
    return not (
        len(word) == 1 and word.isalpha() and word.isupper() and re.match(r"\s+[A-Z][a-z]+\b[^.!?]{0,20}\b(?:and|et|for|&)", text[at + 1 : at + 40])
    )


def paragraph_ends(text: str) -> list[int]:
    """Offsets after each run of blank lines, where the next paragraph begins."""
    return [m.end() for m in BLANK_LINES.finditer(text)]


def sentence_ends(text: str) -> list[int]:
    """Offsets after each sentence and the white space that follows it."""
    return [m.end() for m in _END.finditer(text) if text[m.start()] != "." or closes(text, m.start())]


def sentence_bounds(text: str) -> tuple[list[int], list[int]]:
    """(where each sentence's own text ends, where the next one begins)."""
    found = [m for m in _END.finditer(text) if text[m.start()] != "." or closes(text, m.start())]
    return [m.start() + len(m[0].rstrip()) for m in found], [m.end() for m in found]


def paragraph_bounds(text: str) -> tuple[list[int], list[int]]:
    """(where each paragraph's own text ends, where the next one begins)."""
    found = list(BLANK_LINES.finditer(text))
    return [m.start() for m in found], [m.end() for m in found]
