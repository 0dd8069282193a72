"""Text normalisation and similarity as Column expressions; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE_SPACE = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Without leading and trailing Unicode white space; null stays null."""
    return F.regexp_replace(c, EDGE_SPACE, "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_text(c: Column) -> Column:
    """Trimmed text, "" for null."""
    return F.coalesce(strip(c), F.lit(""))


def normalize_answer(c: Column) -> Column:
    """Lower case, white space collapsed first, then everything but letters, digits, underscore and space dropped."""
    return F.regexp_replace(F.regexp_replace(F.lower(normalize_text(c)), r"(?U)\s+", " "), r"[^\p{L}\p{N}_\s]", "")


def canonical(c: Column) -> Column:
    """Curly quotes and dashes as ASCII, list numbers dropped, white space collapsed."""
    plain = F.translate(F.coalesce(c, F.lit("")), "‘’“”–—", "''\"\"--")
    return squeeze(F.regexp_replace(plain, r"(?m)^\s*(?:\d+[.)]|[-*])\s+", ""))


def similarity_text(c: Column) -> Column:
    """For similarity of sequences: lower case, curly quotes as ASCII, numbers of list items dropped, white space collapsed; null stays null."""
    plain = F.translate(F.lower(c), "‘’“”", "''\"\"")
    return squeeze(F.regexp_replace(plain, r"(?U)(?<!\w)\d{1,2}\s*[.)](?=\s+[a-z])", " "))


def first_non_empty(*cs: Column) -> Column:
    """The first column whose trimmed text isn't empty; null if none is."""
    return F.coalesce(*(F.nullif(strip(c.cast("string")), F.lit("")) for c in cs))


def truncate(c: Column, limit: int) -> Column:
    """At most `limit` characters; a cut text ends in an ellipsis of three dots after its last non-space."""
    return F.when(F.length(c) > limit, F.concat(F.rtrim(F.substring(c, 1, limit - 3)), F.lit("..."))).otherwise(c)


def tokens(c: Column, pattern: str = "[a-z0-9]+") -> Column:
    """All matches of the pattern in the lower-case text; an empty array for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(pattern), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared distinct elements over all distinct ones; 0 if either array is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def match_score(a: Column, b: Column) -> Column:
    """1 for equal normalised texts, 0.95 if one contains the other, else the token Jaccard; 0 if either is empty."""
    x, y = normalize_answer(a), normalize_answer(b)
    return (
        F.when((x == "") | (y == ""), F.lit(0.0))
        .when(x == y, F.lit(1.0))
        .when(F.contains(x, y) | F.contains(y, x), F.lit(0.95))
        .otherwise(jaccard(tokens(a), tokens(b)))
    )


def novelty(target: Column, source: Column) -> Column:
    """The share of token occurrences of `target` that `source` doesn't have; 1 for no token.

    Both token lists are bound once, in an array of one struct: inside the inner function they would be made for each token.
    """
    t = tokens(target)
    once = F.array(F.struct(t.alias("t"), F.array_except(t, tokens(source)).alias("new")))
    share = F.transform(once, lambda p: F.when(F.size(p["t"]) == 0, F.lit(1.0)).otherwise(F.size(F.filter(p["t"], lambda x: F.array_contains(p["new"], x))) / F.size(p["t"])))
    return share[0]


def length_ratio(target: Column, source: Column) -> Column:
    """Tokens of `target` for each of `source`, at least one of the latter."""
    return F.size(tokens(target)) / F.greatest(F.size(tokens(source)), F.lit(1))


def topic_overlap(target: Column, source: Column) -> Column:
    """The share of distinct source tokens that the target has."""
    s = F.array_distinct(tokens(source))
    return F.size(F.array_intersect(s, tokens(target))) / F.greatest(F.size(s), F.lit(1))


def response_parts(c: Column) -> Column:
    """(reasoning, final_answer): split at the first line that opens with "Final answer:", in any case."""
    at = F.regexp_instr(c, F.lit(r"(?i)\n\s*final answer\s*:"))
    marker = F.regexp_extract(c, r"(?i)(\n\s*final answer\s*:)", 1)
    return F.struct(
        F.when(at > 0, strip(F.substring(c, F.lit(1), at - 1))).otherwise(strip(c)).alias("reasoning"),
        F.when(at > 0, strip(F.substring(c, at + F.length(marker), F.length(c)))).otherwise(F.lit("")).alias("final_answer"),
    )


def unit_hash(c: Column) -> Column:
    """A number in 0..1 from the first eight hex digits of the MD5."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("double") / 4294967295.0


def truthy(c: Column) -> Column:
    """true, 1, yes, y and t as true, their opposites as false, in any case and spacing; null for anything else."""
    key = F.lower(strip(c.cast("string")))
    return F.when(key.isin("true", "1", "yes", "y", "t"), True).when(key.isin("false", "0", "no", "n", "f"), False)
