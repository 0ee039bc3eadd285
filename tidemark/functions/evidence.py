"""Locating quoted evidence in a review.

A quote may differ from the source in letter case, white-space runs and the shape
of quotes and dashes; it must start and end at word boundaries. The character map
is one-to-one, so a position in the mapped text is a position in the original.

Searching long texts is the cost here. A text is folded once, to small letters and single
blanks, and all its quotes are looked for in that copy as plain substrings. Where one is found,
the pattern that knows word boundaries starts from there; folding only shortens, so no match lies before. Each step is
bound to a name once (an array lambda serves as the binding) instead of being repeated in every branch.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.defaults import MIN_EVIDENCE_WORDS, SHORT_PART_WORDS
from tidemark.functions.text import WHITESPACE, words

# Typographic quotes and dashes and what they are read as.
PLAIN_PUNCTUATION = {"’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-"}

_WORD = r"[\p{L}\p{N}_]"

# Letters that equal others but for case without having the same small letter, or whose small form
# depends on its neighbours or is longer: µ, dotted and dotless i, long s, the second shapes of Greek and Cyrillic letters.
_UNEVEN_CASE = "[\u00b5\u0130\u0131\u017f\u0345\u03a3\u03c2\u03d0\u03d1\u03d5\u03d6\u03f0\u03f1\u03f5\u1c80-\u1c88\u1e9b\u1fbe]"


def plain_punctuation(value: Column) -> Column:
    """Typographic marks as ASCII. One literal replacement per mark scans bytes and
    leaves a text without marks as it is; ``translate`` would look up every letter."""
    return reduce(
        lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])),
        PLAIN_PUNCTUATION.items(), value,
    )


def evidence_tokens(evidence: Column) -> Column:
    return words(plain_punctuation(evidence))


def evidence_pattern(tokens: Column) -> Column:
    """Per-row regular expression: the tokens, quoted, with any spacing between."""
    quoted = F.transform(
        tokens,
        lambda t: F.concat(
            F.lit(r"\Q"), F.replace(t, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")
        ),
    )
    return F.concat(
        F.lit(f"(?iu)(?<!{_WORD})"),
        F.array_join(quoted, f"[{WHITESPACE}]+"),
        F.lit(f"(?!{_WORD})"),
    )


def is_short_part(part: Column) -> Column:
    """At most four words; looks no further than the fifth."""
    space, word = f"[{WHITESPACE}]", f"[^{WHITESPACE}]"
    longer = f"^{space}*({word}+{space}+){{{SHORT_PART_WORDS}}}{word}"
    return ~part.rlike(longer)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def folded(plain: Column) -> Column:
    """The copy of a text that quotes are looked for in; null if its letters do not fold one by one."""
    small = F.regexp_replace(F.lower(plain), f"[{WHITESPACE}]+", " ")
    return F.when(~plain.rlike(_UNEVEN_CASE), small)


def search_parts(
    tokens: Column, plain_title: Column, plain_text: Column, folded_title: Column, folded_text: Column
) -> Column:
    """``struct<tokens, pattern, in_title, title_from, in_text, text_from>``: first match in each part.

    The parts must be mapped already; an empty match means none. ``_from`` is the character the
    pattern was tried from.
    """
    def first_try(phrase: Column, copy: Column) -> Column:
        """The character before the phrase's first place in the copy; 0 if there is none, 1 if that is not known."""
        place = F.instr(copy, phrase)
        return F.when(copy.isNull() | phrase.rlike(_UNEVEN_CASE), 1).when(place > 1, place - 1).otherwise(place)

    def look(pattern: Column, title_from: Column, text_from: Column) -> Column:
        def match(plain: Column, begin: Column) -> Column:
            rest = F.when(begin > 1, F.substr(plain, begin)).otherwise(plain)
            return F.when(begin > 0, F.call_function("regexp_extract", rest, pattern, F.lit(0))).otherwise("")

        return F.struct(
            tokens.alias("tokens"), pattern.alias("pattern"),
            match(plain_title, title_from).alias("in_title"), title_from.alias("title_from"),
            match(plain_text, text_from).alias("in_text"), text_from.alias("text_from"),
        )

    begin = bind(F.lower(F.array_join(tokens, " ")), lambda phrase: F.struct(
        first_try(phrase, folded_title).alias("title"), first_try(phrase, folded_text).alias("text")))
    return bind(begin, lambda at: bind(
        evidence_pattern(tokens), lambda pattern: look(pattern, at["title"], at["text"])))


def _original(part: Column, plain_part: Column, pattern: Column, match: Column, begin: Column) -> Column:
    """The matched stretch of the original part, its own letters and spacing kept."""
    before = F.get(F.split(F.substr(plain_part, begin), pattern, 2), F.lit(0))
    return F.substr(part, begin + F.char_length(before), F.char_length(match))


def judge_match(
    found: Column,
    title: Column,
    text: Column,
    plain_title: Column,
    plain_text: Column,
    short_title: Column,
    short_text: Column,
    min_words: int = MIN_EVIDENCE_WORDS,
) -> Column:
    """``struct<span, problem>`` of a search: the source stretch, or why there is none.

    The title is tried before the body. A quote below ``min_words`` counts only in
    a part of at most four words.
    """
    long_enough = F.size(found["tokens"]) >= min_words
    title_ok = (found["in_title"] != "") & (long_enough | short_title)
    text_ok = (found["in_text"] != "") & (long_enough | short_text)
    none = F.lit(None).cast("string")
    # no tokens make a pattern of boundaries only, which matches nothing of a text
    empty = F.size(found["tokens"]) == 0
    span = (
        F.when(empty, none)
        .when(title_ok, _original(title, plain_title, found["pattern"], found["in_title"], found["title_from"]))
        .when(text_ok, _original(text, plain_text, found["pattern"], found["in_text"], found["text_from"]))
    )
    problem = (
        F.when(empty, "empty_evidence")
        .when(title_ok | text_ok, none)
        .when((found["in_title"] != "") | (found["in_text"] != ""), "evidence_too_short")
        .otherwise("evidence_not_in_source")
    )
    return F.struct(span.alias("span"), problem.alias("problem"))


def find_evidence(
    evidence: Column,
    title: Column,
    text: Column,
    min_words: int = MIN_EVIDENCE_WORDS,
) -> Column:
    """``struct<span, problem>`` of one quote in one review."""
    title = F.coalesce(title, F.lit(""))
    tokens = F.coalesce(evidence_tokens(evidence), F.array().cast("array<string>"))
    parts = F.struct(
        tokens.alias("tokens"), plain_punctuation(title).alias("title"),
        plain_punctuation(text).alias("text"),
    )

    def search(p: Column) -> Column:
        copies = F.struct(folded(p["title"]).alias("title"), folded(p["text"]).alias("text"))
        found = bind(copies, lambda c: search_parts(p["tokens"], p["title"], p["text"], c["title"], c["text"]))
        return bind(found, lambda m: judge_match(
            m, title, text, p["title"], p["text"], is_short_part(title), is_short_part(text),
            min_words,
        ))

    return bind(parts, search)


def highlight_spans(text: Column, evidences: Column) -> Column:
    """Non-overlapping marks ``array<struct<start, end, pos>>``, earliest first.

    ``evidences`` is an array of strings. Each is placed at its first occurrence;
    one that begins before the previous mark ended is left out. Positions are
    zero-based character offsets, ``pos`` is the index in ``evidences``.
    """
    placed = F.transform(
        evidences,
        lambda e, i: F.struct(
            (F.instr(text, e) - 1).alias("start"), i.alias("pos"),
            F.char_length(e).alias("length"),
        ),
    )
    found = F.array_sort(F.filter(placed, lambda p: p["start"] >= 0))
    none = F.array().cast("array<struct<start:int,end:int,pos:int>>")
    start = F.struct(F.lit(0).alias("cursor"), none.alias("marks"))

    def add(acc: Column, p: Column) -> Column:
        end = p["start"] + p["length"]
        mark = F.struct(p["start"].alias("start"), end.alias("end"), p["pos"].alias("pos"))
        return F.when(p["start"] < acc["cursor"], acc).otherwise(F.struct(
            end.alias("cursor"), F.concat(acc["marks"], F.array(mark)).alias("marks")
        ))

    return F.aggregate(found, start, add)["marks"]
