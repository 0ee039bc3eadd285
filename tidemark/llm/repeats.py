"""Repeated passages by hashing units of text.

A text is cut into lines, and lines into sentences. Each unit of enough words is normalised (case
and blanks) and hashed to 128 bits. Equal digests are grouped over all rows, the occurrence
that ranks first (by key, row and place) stays, and all later ones are removed, with their offsets
in the original text. Lines find repeated paragraphs and boilerplate, sentences find passages
that were put into a longer line.

``remove_passages`` looks for passages alone: every sentence is a unit, whether it fills a line or not, and neighbouring
units that all stand elsewhere before are removed if together they are long enough. So short sentences count
with their neighbours, a line meets the same sentence inside another line, and a phrase that recurs by itself stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.rows import ROW, cut, numbered, release_memory

LINE, SENTENCE = 0, 1
LINE_WORDS, SENTENCE_WORDS = 3, 8  # shorter units repeat by chance and are left alone

PASSAGE_WORDS = 25  # words of the shortest run of repeated sentences that is removed
WORD_LETTERS = 6  # letters that count as a word where a text has no blanks
_ENDED = re.compile(r"(?:[^.!?。！？]|[.!?](?!\s))+(?:[。！？]+|[.!?]*)")
PART = "array<struct<digest: bigint, place: int, start: int, end: int, words: int>>"

_SENTENCE = re.compile(r"(?:[^.!?]|[.!?](?!\s))+[.!?]*")
UNIT = "array<struct<high: bigint, low: bigint, kind: int, start: int, end: int>>"


def units_of(text: str, line_words: int, sentence_words: int) -> Iterator[tuple[str, int, int, int]]:
    """Normalised unit, kind and offsets of the units of a text, end exclusive."""
    at = 0
    for line in text.split("\n"):
        words = line.lower().split()
        if len(words) >= line_words:
            yield " ".join(words), LINE, at, at + len(line)
        if len(words) > sentence_words:
            for m in _SENTENCE.finditer(line):
                part = m[0].lower().split()
                # a line of one sentence is hashed as a line already
                if sentence_words <= len(part) < len(words):
                    lead = len(m[0]) - len(m[0].lstrip())
                    yield " ".join(part), SENTENCE, at + m.start() + lead, at + m.end()
        at += len(line) + 1


def _digests(text: str, line_words: int, sentence_words: int) -> list[dict]:
    out = []
    for unit, kind, start, end in units_of(text, line_words, sentence_words):
        digest = xxhash.xxh3_128_intdigest(unit.encode("utf-8", "surrogatepass"), kind)
        out.append({"high": (digest >> 64) - (1 << 63), "low": (digest & (1 << 64) - 1) - (1 << 63),
                    "kind": kind, "start": start, "end": end})
    return out


def without(text: str, spans: Iterable[tuple[int, int, int]]) -> str:
    """A text without ``(start, end, kind)`` spans, in order; a line goes with its line end."""
    out, at = [], 0
    for start, end, kind in spans:
        if end <= at:
            continue
        out.append(text[at: max(at, start)])
        at = end + (kind == LINE and text[end: end + 1] == "\n")
    return "".join(out) + text[at:]


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", line_words: int = LINE_WORDS,
                   sentence_words: int = SENTENCE_WORDS) -> DataFrame:
    """``_row, doc_id, n_units, removed, kept_text`` for every row of ``docs``.

    ``removed`` is an array of ``start, end, kind`` in the original text (code points, end exclusive, kind
    0 a line and 1 a sentence) by start; ``kept_text`` is what stays. The first occurrence by key, then row
    and place is kept; null keys rank last. Null and empty texts have no units and stay; repeated
    rows keep the text in one of them; an empty table gives no rows; other columns are not read.

    Grouping keeps one candidate per digest and task, so a unit that stands in a third of all rows
    costs one row a task; the join back with the repeated digests is split where one is hot.
    """
    @F.pandas_udf(UNIT)
    def cut_up(texts: pd.Series) -> pd.Series:
        return pd.Series([_digests(t or "", line_words, sentence_words) for t in texts], dtype=object)

    @F.pandas_udf("string")
    def rest(texts: pd.Series, starts: pd.Series, ends: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or not len(a) else without(t, zip(a, b, k))
                          for t, a, b, k in zip(texts, starts, ends, kinds)], dtype=object)

    rows = numbered(docs, F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
                    cut_up(F.col(text)).alias("units"))
    units = rows.select(ROW, "doc_id", F.explode("units").alias("u")).select(ROW, "doc_id", "u.*")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", ROW, "start")
    first = cut(units.groupBy("high", "low", "kind").agg(
        F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").select(
            "high", "low", "kind", F.col(f"first.{ROW}").alias("first_row"),
            F.col("first.start").alias("first_start")))
    later = units.drop("doc_id").join(first, ["high", "low", "kind"]).where(
        (F.col(ROW) != F.col("first_row")) | (F.col("start") != F.col("first_start")))
    removed = later.groupBy(ROW).agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("removed"))
    none = F.from_json(F.lit("[]"), "array<struct<start: int, end: int, kind: int>>")
    done = rows.select(ROW, "doc_id", "text", F.size("units").alias("n_units")).join(removed, ROW, "left")
    done = done.withColumn("removed", F.coalesce("removed", none))
    kept = rest(F.col("text"), F.col("removed.start"), F.col("removed.end"), F.col("removed.kind"))
    return done.select(ROW, "doc_id", "n_units", "removed", kept.alias("kept_text"))


def parts_of(text: str) -> Iterator[tuple[str, int, int, int]]:
    """Normalised sentence, offsets and size in words of every sentence of every line; blank ones are none."""
    at = 0
    for line in text.split("\n"):
        for m in _ENDED.finditer(line):
            words = m[0].lower().split()
            if words:
                lead = len(m[0]) - len(m[0].lstrip())
                size = max(len(words), sum(map(len, words)) // WORD_LETTERS)
                yield " ".join(words), at + m.start() + lead, at + m.start() + len(m[0].rstrip()), size
        at += len(line) + 1


def _parts(text: str) -> list[dict]:
    out = []
    for place, (part, start, end, words) in enumerate(parts_of(text)):
        digest = xxhash.xxh3_64_intdigest(part.encode("utf-8", "surrogatepass")) - (1 << 63)
        out.append({"digest": digest, "place": place, "start": start, "end": end, "words": words})
    return out


def remove_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """``_row, doc_id, n_units, removed, kept_text`` for every row of ``docs``.

    ``removed`` is an array of ``start, end`` in the original text (code points, end exclusive) by start: runs of neighbouring
    sentences, of ``passage_words`` words or more together, each of which stands in an earlier text or place. ``kept_text`` is what
    stays. The first occurrence of a sentence by key, then row and place is never removed; null keys rank last. Null, empty and
    blank texts have no units and stay; a text without sentence ends is a unit a line; repeated rows keep the text
    in one of them if it is long enough; an empty table gives no rows; other columns are not read.

    Grouping keeps one candidate per digest and task, so a sentence that stands in a third of all rows
    costs one row a task; the join back with the repeated digests is split where one is hot. Digests have 64 bits: two
    sentences that share one by chance do no harm unless all their neighbours are repeated too.
    """
    @F.pandas_udf(PART)
    def cut_up(texts: pd.Series) -> pd.Series:
        try:
            return pd.Series([_parts(t or "") for t in texts], dtype=object)
        finally:
            release_memory()

    @F.pandas_udf("string")
    def rest(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or not len(x) else without(t, ((a, b, SENTENCE) for a, b in zip(x, y)))
                          for t, x, y in zip(texts, starts, ends)], dtype=object)

    rows = numbered(docs, F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), cut_up(F.col(text)).alias("units"))
    units = rows.select(ROW, "doc_id", F.explode("units").alias("u")).select(ROW, "doc_id", "u.*")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", ROW, "place")
    first = cut(units.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").select(
        "digest", F.col(f"first.{ROW}").alias("first_row"), F.col("first.place").alias("first_place")))
    later = units.drop("doc_id").join(first, "digest").where(
        (F.col(ROW) != F.col("first_row")) | (F.col("place") != F.col("first_place")))
    # neighbouring places less their numbers in order are equal
    run = F.col("place") - F.row_number().over(Window.partitionBy(ROW).orderBy("place"))
    runs = later.withColumn("run", run).groupBy(ROW, "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"))
    removed = cut(runs.where(F.col("words") >= passage_words).groupBy(ROW).agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removed")))
    none = F.array().cast("array<struct<start: int, end: int>>")
    # the spans grow with the texts: the same join at every size, no broadcast that must end somewhere
    done = rows.select(ROW, "doc_id", "text", F.size("units").alias("n_units")).join(
        removed.hint("merge"), ROW, "left").withColumn("removed", F.coalesce("removed", none))
    kept = rest(F.col("text"), F.col("removed.start"), F.col("removed.end"))
    return done.select(ROW, "doc_id", "n_units", "removed", kept.alias("kept_text"))
