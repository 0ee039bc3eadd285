"""Personal data by weak supervision.

Four base kinds follow fixed patterns and are always reported. Further candidate spans (secrets,
long numbers, local phone numbers, spelled-out addresses) are found by wider patterns. On every
span of either sort several labelers vote: pattern rules, gazetteers of domains, prefixes and
calling codes, words around, other spans nearby, and the digits themselves. Votes are counted per
pattern over all rows; expectation-maximisation estimates how reliable each labeler is, and its
posteriors train a logistic span classifier on votes and surroundings, which decides about the
further candidates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.rows import numbered, release_memory

BASE = ("email", "ip", "card", "phone")
FURTHER = ("secret", "number", "local_phone", "spelled_email")
KINDS = BASE + FURTHER
LABELERS = ("pattern", "gazetteer", "context", "nearby", "digits")
ABSTAIN, NO, YES = 0, 1, 2
SIDES, LENGTHS = 4, 4  # classes of the neighbouring character and of the length
REACH = 48  # characters around a span that the context labeler reads
WIDTHS = (len(KINDS), *[3] * len(LABELERS), SIDES, SIDES, LENGTHS)
# a pattern is one number in a mixed base, so there are at most this many
PATTERNS = int(np.prod(WIDTHS))

_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_PART = re.compile(r"[A-Za-z0-9._%+-]")
_SECRET = re.compile(r"(?i)(?<![a-z])(?:token|secret|api[_-]?key|password|passwd)\s{0,3}[=:]\s{0,3}[\"']?([0-9a-z_/+-]{16,}+)")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_SPELLED = re.compile(r"(?i)(?<![a-z0-9._-])[a-z0-9._-]{1,64}\s?[\[(]at[\])]\s?[a-z0-9-]{1,63}\s?[\[(]dot[\])]\s?[a-z]{2,12}(?![a-z])")

# fixed values: gazetteers
DOMAIN_ENDS = frozenset("com org net edu gov io info biz de fr es it uk us eu ch at nl be pl ca au jp cn in br ru".split())
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 380 420 971 972".split())
CARD_STARTS = ("34", "35", "36", "37", "38", "4", "51", "52", "53", "54", "55", "60", "62", "64", "65")
RESERVED_NETS = ("0.", "127.", "255.")
FOR_WORDS = re.compile(r"(?i)\b(?:e-?mail|mail|contact|phone|tel|call|fax|mobile|card|visa|mastercard|account|address|server|host|login|user|token|secret|password|key|correo|t[ée]l[ée]phone|telefon|konto|adresse)\b")
AGAINST_WORDS = re.compile(r"(?i)\b(?:version|isbn|issn|doi|order|invoice|page|figure|table|section|chapter|release|build|serial|example only)\b")


def luhn(digits: str) -> bool:
    """Whether the check digit fits."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the characters before an at sign reach back to the last match at most."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL_PART.match(text[start - 1]):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
            at = text.find("@", done)
        else:
            # a failed sign ends a run: the next one's characters start after it
            done = max(done, at + 1)
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the four base kinds, in order."""
    found = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = only_digits(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(only_digits(m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def further_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Wider candidates that overlap no base span and no earlier kind.

    A secret may hold base spans: it is dropped only if it lies within one, so that none of its parts stays.
    """
    found = [(m.start(1), 4, m.end(1)) for m in _SECRET.finditer(text)]
    for m in _CARD.finditer(text):
        digits = only_digits(m[0])
        if 12 <= len(digits) <= 19 and not luhn(digits):
            found.append((m.start(), 5, m.end()))
    found += [(m.start(), 6, m.end()) for m in _LOCAL_PHONE.finditer(text)]
    if "at" in text or "AT" in text:
        found += [(m.start(), 7, m.end()) for m in _SPELLED.finditer(text)]
    kept: list[tuple[int, int, int]] = []
    end = -1
    taken = iter(base)
    now = next(taken, None)
    for span in sorted(found):
        while now and now[2] <= span[0]:
            now = next(taken, None)
        taken_up = now and (now[0] <= span[0] and span[2] <= now[2] if span[1] == 4 else now[0] < span[2])
        if span[0] >= end and not taken_up:
            kept.append(span)
            end = span[2]
    return kept


def _side(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isalnum() else 3


def votes(text: str, span: tuple[int, int, int], near: bool) -> list[int]:
    """What each labeler says about a span."""
    start, kind, end = span
    value = text[start:end]
    digits = only_digits(value)
    name = KINDS[kind]
    pattern = gazetteer = digit = ABSTAIN
    if name in ("email", "spelled_email"):
        last = re.split(r"[.\])\s]+", value)[-1].lower()
        pattern = YES if last.isalpha() and 2 <= len(last) <= 12 else NO
        gazetteer = YES if last in DOMAIN_ENDS else ABSTAIN
    elif name == "ip":
        parts = value.split(".")
        pattern = NO if any(len(p) > 1 and p[0] == "0" for p in parts) else YES
        gazetteer = NO if value.startswith(RESERVED_NETS) else YES
    elif name in ("card", "number"):
        pattern = YES if luhn(digits) and len(digits) in (13, 14, 15, 16, 19) else NO
        gazetteer = YES if digits.startswith(CARD_STARTS) else NO
    elif name in ("phone", "local_phone"):
        pattern = YES if 10 <= len(digits) <= 13 else ABSTAIN
        if name == "phone":
            gazetteer = YES if any(digits[:k] in CALLING_CODES for k in (1, 2, 3)) else NO
        else:
            gazetteer = NO if value.lstrip("(")[0] in "01" else ABSTAIN
    elif name == "secret":
        classes = sum(bool(re.search(p, value)) for p in ("[0-9]", "[a-z]", "[A-Z]"))
        pattern = YES if len(value) >= 20 and classes >= 2 else NO
        gazetteer = YES if re.fullmatch(r"(?i)[0-9a-f]{32,}", value) else ABSTAIN
    if len(digits) >= 7:
        digit = NO if len(set(digits)) <= 2 or digits in "01234567890123456789" else YES
    around = text[max(0, start - REACH): start] + " " + text[end: end + REACH]
    context = YES if FOR_WORDS.search(around) else NO if AGAINST_WORDS.search(around) else ABSTAIN
    return [pattern, gazetteer, context, YES if near else ABSTAIN, digit]


def pattern_of(text: str, span: tuple[int, int, int], near: bool) -> int:
    """Kind, votes, neighbouring characters and length as one number."""
    start, kind, end = span
    size = end - start
    parts = [kind, *votes(text, span, near), _side(text[start - 1: start]), _side(text[end: end + 1]),
             0 if size < 12 else 1 if size < 20 else 2 if size < 32 else 3]
    code = 0
    for width, value in zip(WIDTHS, parts):
        code = code * width + value
    return code


SPAN = "array<struct<start: int, kind: int, end: int, pattern: int>>"


def candidates(text: str | None) -> list[tuple[int, int, int, int]]:
    """All spans in order with their patterns; a null text has none."""
    if not text:
        return []
    base = base_spans(text)
    spans = sorted(base + further_spans(text, base))
    close = [b[0] - a[2] < 2 * REACH for a, b in pairwise(spans)]
    return [(*s, pattern_of(text, s, (k > 0 and close[k - 1]) or (k < len(close) and close[k])))
            for k, s in enumerate(spans)]


def find_candidates(text: Column) -> Column:
    """All spans of a text column, as an array in order."""
    names = ("start", "kind", "end", "pattern")

    @F.pandas_udf(SPAN)
    def find(texts: pd.Series) -> pd.Series:
        try:
            return pd.Series([[dict(zip(names, s)) for s in candidates(t)] for t in texts], dtype=object)
        finally:
            release_memory()

    return find(text)


def _digits_of(codes: np.ndarray) -> np.ndarray:
    """Parts of each pattern, a column each."""
    out = np.zeros((len(codes), len(WIDTHS)), np.int64)
    rest = codes.copy()
    for k in range(len(WIDTHS) - 1, -1, -1):
        out[:, k] = rest % WIDTHS[k]
        rest //= WIDTHS[k]
    return out


def reliabilities(parts: np.ndarray, n: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each pattern, and P(vote | truth) of each labeler, by expectation-maximisation.

    Starts from the majority of the votes; each kind has a prior of its own. A pattern counts as
    often as it occurs, and one occurrence of each vote is added to every estimate.
    """
    kind, vote = parts[:, 0], parts[:, 1: 1 + len(LABELERS)]
    lead = (vote == YES).sum(axis=1) - (vote == NO).sum(axis=1)
    post = 1 / (1 + np.exp(-1.5 * lead))
    table = np.zeros((len(LABELERS), 2, 3))
    for _ in range(rounds):
        both = np.stack([1 - post, post])
        prior = np.ones((len(KINDS), 2))
        for y in (0, 1):
            np.add.at(prior[:, y], kind, n * both[y])
            for k in range(len(LABELERS)):
                table[k, y] = 1 + np.bincount(vote[:, k], n * both[y], 3)
        table /= table.sum(axis=2, keepdims=True)
        prior /= prior.sum(axis=1, keepdims=True)
        log = np.log(prior[kind])
        for k in range(len(LABELERS)):
            log += np.log(table[k][:, vote[:, k]]).T
        fresh = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        done = np.abs(fresh - post).max() < 1e-9
        post = fresh
        if done:
            break
    return post, table


def span_classifier(codes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of a logistic model on the one-hot parts of a pattern, fitted to the posteriors.

    The first weight is the constant. Newton steps with a small ridge on counted patterns, so the
    fit costs the same for any number of spans.
    """
    size = 1 + sum(WIDTHS)
    if not len(codes):
        return np.zeros(size)
    parts = _digits_of(codes)
    post, _ = reliabilities(parts, n)
    x = _one_hot(parts)
    w = np.zeros(size)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (post - p)) - 0.5 * w
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(size)
        step = np.linalg.solve(curve, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _one_hot(parts: np.ndarray) -> np.ndarray:
    x = np.zeros((len(parts), 1 + sum(WIDTHS)))
    x[:, 0] = 1
    begin = 1
    for k, width in enumerate(WIDTHS):
        x[np.arange(len(parts)), begin + parts[:, k]] = 1
        begin += width
    return x


def span_probability(pattern: Column, weights: np.ndarray) -> Column:
    """The classifier as a column expression over a pattern number."""
    total = F.lit(float(weights[0]))
    begin, below = 1, PATTERNS
    for width in WIDTHS:
        below //= width
        own = F.array(*[F.lit(float(w)) for w in weights[begin: begin + width]])
        total = total + F.get(own, F.pmod(F.floor(pattern / below), F.lit(width)).cast("int"))
        begin += width
    return 1 / (1 + F.exp(-total))


def personal_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *columns: str) -> DataFrame:
    """``_row, doc_id, spans, base`` and the named columns for every row of ``docs``.

    ``spans`` is an array of ``start, kind, end, name, probability`` by start, then kind; offsets are code
    points, end exclusive. It has every base span and the further candidates to which the
    classifier gives at least one half; ``base`` has the base ones alone. Null and empty texts
    have no spans; repeated rows each get a row; an empty table gives none; a table without any candidate
    trains nothing and adds nothing.
    """
    rows = numbered(docs, F.col(doc_id).alias("doc_id"), *columns, find_candidates(F.col(text)).alias("found"))
    # at most one row for each possible pattern
    counted = rows.select(F.explode("found.pattern").alias("pattern")).groupBy("pattern").agg(
        F.count("*").alias("n")).toArrow()
    weights = span_classifier(np.asarray(counted.column("pattern")).astype(np.int64),
                              np.asarray(counted.column("n")).astype(np.float64))
    names = F.array(*map(F.lit, KINDS))
    judged = F.transform("found", lambda s: F.struct(
        s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end"), F.get(names, s.kind).alias("name"),
        span_probability(s.pattern, weights).alias("probability")))
    judged = F.filter(judged, lambda s: (s.kind < len(BASE)) | (s.probability >= 0.5))
    return rows.withColumn("spans", judged).withColumn(
        "base", F.filter("spans", lambda s: s.kind < len(BASE))).drop("found")


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s.start, s.end)), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    end = F.aggregate(
        spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.struct(
            F.when(s.start >= a["at"], F.concat(
                a["out"], F.substring(text, a["at"] + 1, s.start - a["at"]), F.lit("["), F.upper(s["name"]), F.lit("]"),
            )).otherwise(a["out"]).alias("out"),
            F.greatest(a["at"], s.end).alias("at")))
    whole = F.concat(end["out"], F.substring(text, end["at"] + 1, F.length(text) - end["at"]))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def mask_personal(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """All rows and columns of ``docs``, personal spans of the text masked and its length updated."""
    others = [c for c in docs.columns if c not in (doc_id,)]
    prefixed = docs.select(F.col(doc_id), *[F.col(c).alias(f"_in_{c}") for c in others])
    found = personal_spans(prefixed, doc_id, f"_in_{text}", *[f"_in_{c}" for c in others])
    out = found.withColumn("_masked", masked(F.col(f"_in_{text}"), F.col("spans")))
    back = {doc_id: F.col("doc_id"), text: F.col("_masked")}
    if n_chars in docs.columns:
        back[n_chars] = F.when(F.size("spans") > 0, F.length("_masked")).otherwise(F.col(f"_in_{n_chars}")).cast(
            docs.schema[n_chars].dataType)
    return out.select(*[back.get(c, F.col(f"_in_{c}")).alias(c) for c in docs.columns])
