"""Text expressions: trimming, normalising, extracting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import defaults as D

# The white-space characters that text trimming and word
# splitting recognise (Unicode white space plus the four separator controls).
WHITESPACE = (
    r"\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
)
_EDGES = f"^[{WHITESPACE}]+|[{WHITESPACE}]+$"


def strip(value: Column) -> Column:
    """Remove Unicode white space at both ends (``trim`` removes only spaces)."""
    return F.regexp_replace(value, _EDGES, "")


def is_filled(value: Column) -> Column:
    """True when some character is not white space; null counts as empty."""
    return F.coalesce(value.rlike(f"[^{WHITESPACE}]"), F.lit(False))


def strip_to_null(value: Column) -> Column:
    return F.when(is_filled(value), strip(value))


def collapse(value: Column) -> Column:
    """White-space runs become one space, ends are stripped."""
    return F.trim(F.regexp_replace(value, f"[{WHITESPACE}]+", " "))


def words(value: Column) -> Column:
    """Words between white space; an empty array for blank text."""
    flat = collapse(value)
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def excerpt(value: Column, chars: int) -> Column:
    return F.substring(value, 1, chars)


def question_key(question: Column) -> Column:
    """Questions that differ only in case, spacing or end marks share a key."""
    flat = collapse(F.lower(question))
    tail = D.QUESTION_TAIL_PATTERN.replace(r"\s", WHITESPACE)
    return F.substring(F.regexp_replace(flat, tail, ""), 1, D.QUESTION_KEY_CHARS)


def break_tags_to_newlines(value: Column) -> Column:
    return F.regexp_replace(value, r"(?i)<br\s*/?>", "\n")


def numbers(value: Column) -> Column:
    """Numeric tokens, thousands commas removed."""
    return F.regexp_extract_all(F.replace(value, F.lit(","), F.lit("")),
                                F.lit(D.NUMBER_PATTERN), F.lit(0))


def percent_mentions(value: Column) -> Column:
    """Numbers followed by a percent unit, as doubles."""
    found = F.regexp_extract_all(value, F.lit(D.PERCENT_PATTERN), F.lit(1))
    return F.transform(found, lambda x: x.cast("double"))


def citation_markers(value: Column) -> Column:
    """Cited source numbers in order of first use."""
    found = F.regexp_extract_all(value, F.lit(D.CITATION_PATTERN), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: x.cast("int")))


def is_hard_case(title: Column, text: Column, pattern: str = D.HARD_CASE_PATTERN) -> Column:
    """Reviews whose wording is easy to misread: negation, contrast, returns."""
    joined = F.concat_ws(" ", F.coalesce(title, F.lit("")), text)
    return joined.rlike("(?iU)" + pattern)
