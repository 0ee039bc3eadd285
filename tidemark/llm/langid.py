"""Language identification with interpolated Kneser-Ney character models.

Text is reduced to lower-case letters with one blank for anything between. Four-grams are counted
per language over all training rows; lower orders count the distinct left neighbours
(continuation counts), and each order interpolates with the next lower one by absolute discount.
The model is kept as sorted arrays of whole 64-bit n-gram hashes with a row of log probabilities, one
column a language: no n-grams share a row. It grows with the distinct n-grams of the training texts, which
writing systems bound and not the amount of text: 40 thousand four-grams for four languages. A text gets
the language with the lowest cross-entropy per letter, and is rejected if even that is above
the level that (almost) all training texts of similar length stay under.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.rows import DOC, PLACE, ROW, cut, placed, released, scratch, without
from tidemark.llm.words import row_groups

ORDER = 4
PLACE_BITS = 20  # leading bits of a hash by which its place in a sorted array is looked up
KEPT = 1 << 20  # distinct n-grams that a task holds before it passes their counts on
QUANTILE = 0.999  # share of the training texts that calibration keeps
SLACK = 1.15  # above the calibrated level
LEAST_LETTERS = 20  # the entropy of a shorter text says too little to reject it
BLANK = 32

COUNTS = "lang string, gram bigint, n bigint"
SCORES = "best int, entropy double, letters bigint, certainty double"


@cache
def _fold() -> np.ndarray:
    """Of every 16-bit code point: its lower case if it is a letter, else a blank."""
    return np.array([(ord(c.lower()) if len(c.lower()) == 1 else k) if (c := chr(k)).isalpha() else BLANK
                     for k in range(1 << 16)], dtype=np.uint64)


def letters_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and single blanks of all texts, each after ORDER - 1 zeros; and the first place of each text.

    A letter outside the 16-bit range is folded into the private range.
    """
    text = [t or "" for t in texts]
    lengths = np.array([len(t) for t in text], dtype=np.int64)
    code = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), np.uint32)
    low = _fold()[np.minimum(code, 0xFFFF)]
    for k in np.flatnonzero(code > 0xFFFF):
        low[k] = 0xE000 + (int(code[k]) & 0xFFF) if chr(code[k]).isalpha() else BLANK
    row = np.repeat(np.arange(len(text)), lengths)
    first = np.ones(len(low), dtype=bool)
    if len(low):
        first[1:] = row[1:] != row[:-1]
    keep = np.ones(len(low), dtype=bool)
    if len(low):
        keep[1:] = (low[1:] != BLANK) | (low[:-1] != BLANK) | first[1:]
    low, row = low[keep], row[keep]
    size = np.bincount(row, minlength=len(text))
    out = np.zeros(len(low) + (ORDER - 1) * len(text), np.uint64)
    out[np.arange(len(low)) + (ORDER - 1) * (row + 1)] = low
    starts = np.cumsum(size) - size + (ORDER - 1) * (np.arange(len(text)) + 1)
    return out, np.append(starts, len(out) + ORDER - 1)


def grams(code: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER-gram that ends at every letter, and the bounds of each text in them."""
    sizes = np.diff(starts) - (ORDER - 1)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(int(bounds[-1])) + np.repeat(starts[:-1] - bounds[:-1], sizes)
    gram = np.zeros(len(at), np.uint64)
    for k in range(ORDER):
        gram |= code[at - k] << np.uint64(16 * k)
    return gram, bounds


def hashed(gram: np.ndarray) -> np.ndarray:
    """XXH64 of a 64-bit value with seed 42; the same as the SQL function gives."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turn(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    h = turn(gram * p2, 31) * p1
    h ^= np.uint64((42 + int(p5) + 8) % 2**64)
    h = turn(h, 27) * p1 + p4
    h ^= h >> np.uint64(33)
    h *= p2
    h ^= h >> np.uint64(29)
    h *= p3
    return h ^ (h >> np.uint64(32))


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    column = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    for lo, hi in row_groups(offsets, 1 << 20):
        yield lo, column.slice(lo, hi - lo).to_pylist()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}

    def compact() -> int:
        for lang, (g, n) in list(held.items()):
            values, where = np.unique(np.concatenate(g), return_inverse=True)
            held[lang] = [[values], [np.bincount(where, np.concatenate(n)).astype(np.int64)]]
        return sum(len(g[0]) for g, _ in held.values())

    def passed_on() -> Iterator[pa.RecordBatch]:
        for lang, (g, n) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(g[0]), pa.string()), pa.array(g[0].view(np.int64)), pa.array(n[0])],
                names=["lang", "gram", "n"])
        held.clear()

    waiting = 0
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        for at, texts in _slices(batch.column(1)):
            code, starts = letters_of(texts)
            gram, bounds = grams(code, starts)
            own = langs[at: at + len(texts)]
            of = np.repeat(np.arange(len(texts)), np.diff(bounds))
            for lang in set(own):
                value, n = np.unique(gram[(own == lang)[of]], return_counts=True)
                g = held.setdefault(lang, [[], []])
                g[0].append(value)
                g[1].append(n)
                waiting += len(value)
            if waiting > 4 * KEPT:
                waiting = compact()
                if waiting > KEPT:
                    yield from passed_on()
                    waiting = 0
    compact()
    yield from passed_on()


@dataclass
class Model:
    """Per order the sorted hashes with log probabilities, and sorted contexts with log back-off weights."""

    langs: list[str]
    keys: dict[int, np.ndarray] = field(default_factory=dict)
    logs: dict[int, np.ndarray] = field(default_factory=dict)
    contexts: dict[int, np.ndarray] = field(default_factory=dict)
    weights: dict[int, np.ndarray] = field(default_factory=dict)
    unseen: float = -11.0904  # a letter that no language has: one of 2**16

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_places"}

    def _find(self, table: str, order: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash in a sorted array: from the first place of its leading bits onward."""
        places = self.__dict__.setdefault("_places", {})
        values = getattr(self, table)[order]
        if not len(values):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        if (table, order) not in places:
            heads = np.arange(1 << PLACE_BITS, dtype=np.uint64) << np.uint64(64 - PLACE_BITS)
            places[table, order] = np.append(np.searchsorted(values, heads), len(values)).astype(np.int32)
        head = (key >> np.uint64(64 - PLACE_BITS)).astype(np.int64)
        at, end = places[table, order][head], places[table, order][head + 1]
        known = values[np.minimum(at, len(values) - 1)] == key
        known &= at < end
        rest = np.flatnonzero(~known & (at + 1 < end))
        while len(rest):
            at[rest] += 1
            found = values[at[rest]] == key[rest]
            known[rest[found]] = True
            rest = rest[~found]
            rest = rest[at[rest] + 1 < end[rest]]
        return np.minimum(at, len(values) - 1), known

    def log_probabilities(self, gram: np.ndarray) -> np.ndarray:
        """A row for each n-gram, a column for each language."""
        out = np.zeros((len(gram), len(self.langs)), np.float32)
        rest = np.arange(len(gram))
        for order in range(ORDER, 0, -1):
            part = gram[rest] & np.uint64((1 << 16 * order) - 1)
            at, known = self._find("keys", order, hashed(part))
            out[rest[known]] += self.logs[order][at[known]]
            rest, part = rest[~known], part[~known]
            if not len(rest):
                return out
            if order > 1:
                at, known = self._find("contexts", order, hashed(part >> np.uint64(16)))
                out[rest[known]] += self.weights[order][at[known]]
        out[rest] += self.unseen
        return out


def _order_table(counts: DataFrame, order: int) -> DataFrame:
    """Hashed n-grams of one order with hashed context and suffix."""
    gram = F.col("gram")
    suffix = gram.bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1)) if order > 1 else F.lit(0).cast("long")
    return counts.select(
        "lang", F.xxhash64(gram).alias("key"), F.xxhash64(F.call_function("shiftrightunsigned", gram, F.lit(16))).alias("context"),
        F.xxhash64(suffix).alias("suffix"), "n")


def _kneser_ney(langs: list[str], tables: dict[int, pa.Table], discounts: dict) -> Model:
    model = Model(langs)
    lower: np.ndarray | None = None
    number = {x: k for k, x in enumerate(langs)}
    for order in range(1, ORDER + 1):
        t = tables[order]
        lang = np.array([number[x] for x in t.column("lang").to_pylist()], np.int64)
        key, context, suffix = (np.asarray(t.column(c)).astype(np.int64).view(np.uint64) for c in ("key", "context", "suffix"))
        n = np.asarray(t.column("n")).astype(np.int64)
        keys, first = np.unique(key, return_index=True)
        contexts, of_context = np.unique(context, return_inverse=True)
        cell = lang * len(contexts) + of_context
        total = np.bincount(cell, n, len(langs) * len(contexts))
        kinds = np.bincount(cell, minlength=len(langs) * len(contexts))
        d = np.array([discounts.get((x, order), 0.5) for x in langs])
        weight = np.where(total > 0, np.repeat(d, len(contexts)) * kinds / np.maximum(total, 1), 1.0)
        weight = np.minimum(weight, 1.0).reshape(len(langs), len(contexts)).T
        below = np.full((len(keys), len(langs)), 2.0**-16) if lower is None else \
            lower[np.searchsorted(model.keys[order - 1], suffix[first])]
        p = weight[of_context[first]] * below
        p[np.searchsorted(keys, key), lang] += (n - d[lang]) / total[cell]
        p = np.maximum(p, 2.0**-40)
        model.keys[order], model.logs[order] = keys, np.log(p).astype(np.float32)
        model.contexts[order], model.weights[order] = contexts, np.log(np.maximum(weight, 2.0**-40)).astype(np.float32)
        lower = p
    return model


def train(rows: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """Model of all ``rows`` with a language. To the driver come its distinct n-grams, a row for each language that has one."""
    source = rows.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = cut(source.mapInArrow(lambda it: released(_count(it)), COUNTS).groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    tables, discounts = {}, {}
    for order in range(ORDER, 0, -1):
        for r in counts.groupBy("lang").agg(
                F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two")).collect():
            d = r.one / (r.one + 2 * r.two) if r.one else 0.5
            discounts[r.lang, order] = min(max(d, 0.05), 0.95)
        tables[order] = _order_table(counts, order).toArrow()
        if order > 1:
            suffix = F.col("gram").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1))
            counts = cut(counts.groupBy("lang", suffix.alias("gram")).agg(F.count("*").alias("n")))
    langs = sorted(set(tables[1].column("lang").to_pylist()))
    return _kneser_ney(langs, tables, discounts)


def score_texts(model: Model, texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """Best language, its cross-entropy a letter, letters and certainty of each text; -1 without a letter."""
    code, starts = letters_of(texts)
    gram, bounds = grams(code, starts)
    last = gram & np.uint64(0xFFFF)
    is_letter = np.concatenate([[0], np.cumsum(last != BLANK)])
    letters = is_letter[bounds[1:]] - is_letter[bounds[:-1]]
    logs = model.log_probabilities(gram)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    total = np.zeros((len(texts), max(len(model.langs), 1)))
    if len(full) and model.langs:
        total[full] = np.add.reduceat(logs, bounds[full], axis=0, dtype=np.float64)
    size = np.maximum(np.diff(bounds), 1)
    entropy = -total / size[:, None]
    best = np.where((letters > 0) & (len(model.langs) > 0), entropy.argmin(axis=1), -1)
    lowest = entropy.min(axis=1)
    certainty = 1 / np.exp((lowest[:, None] - entropy) * np.minimum(size, 100)[:, None]).sum(axis=1)
    return best, lowest, letters, np.where(best >= 0, certainty, 0.0)


def identify(docs: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text",
             lang: str = "lang") -> DataFrame:
    """``_row, doc_id, lang_pred, score, entropy, letters, rejected`` for every row of ``docs``.

    Rows that ``training`` picks and that have a language are learned from; a prediction reads the text alone.
    ``lang_pred`` is a learned language, or ``und`` for a null text or one without a letter, which
    is always rejected; so are all rows if nothing could be learned; other texts of fewer than ``LEAST_LETTERS``
    letters never are, their entropy says too little. ``score`` is the share of the best
    language among all, from the cross-entropies of at most a hundred letters, 0 for ``und``. Ties go to the first language by
    name; repeated rows each get a row; an empty table gives none; other columns are not read.
    """
    spark = docs.sparkSession
    learn = F.coalesce(training, F.lit(False))
    model = train(docs.where(learn), lang, text)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _slices(batch.column("text")):
                best, entropy, letters, certainty = score_texts(shared.value, texts)
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(best.astype(np.int32)),
                     pa.array(entropy), pa.array(letters.astype(np.int64)), pa.array(certainty)],
                    names=[ROW, "doc_id", "right", "best", "entropy", "letters", "certainty"])

    source = docs.select(
        F.monotonically_increasing_id().alias(ROW), F.col(doc_id).alias("doc_id"),
        F.when(learn, F.col(lang)).alias("right"), F.col(text).alias("text"))
    rows = cut(source.mapInArrow(lambda it: released(scored(it)), f"{ROW} bigint, doc_id {kind}, right string, {SCORES}"))
    name = F.get(F.array(*map(F.lit, model.langs)).cast("array<string>"), F.when(F.col("best") >= 0, F.col("best")))
    rows = rows.withColumn("lang_pred", F.coalesce(name, F.lit("und")))
    band = F.floor(F.log2(F.col("letters") + 1)).cast("int")
    levels = rows.where("right = lang_pred").groupBy(band.alias("band")).agg(
        F.percentile_approx("entropy", QUANTILE, 10_000).alias("level")).collect()  # one row for a power of two
    top = max((r.level for r in levels), default=0.0)
    bands = dict((r.band, r.level) for r in levels)
    level = F.get(F.array(*[F.lit(float(bands.get(k, top))) for k in range(64)]), band)
    return rows.select(
        ROW, "doc_id", "lang_pred", F.col("certainty").alias("score"), "entropy", "letters",
        ((F.col("lang_pred") == "und") 
         | ((F.col("letters") >= LEAST_LETTERS) & (F.col("entropy") > level * SLACK))).alias("rejected"))


def in_fold(doc_id: Column, folds: int = 5) -> Column:
    """Whether the checksum of the key as text is a multiple of ``folds``; a null key is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def keep_known(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
               stored: bool = False) -> DataFrame:
    """The rows of ``docs`` that are not rejected, all columns kept.

    Learned from the rows outside the fold that have a key. Each row is judged by itself, whatever its key. ``stored``: ``docs``
    is a table as read from Parquet, which need not be copied.
    """
    rows = placed(docs, stored)
    of = F.col(DOC)
    known = rows.select(PLACE, of[doc_id].alias("doc_id"), of[text].alias("text"), of[lang].alias("lang"))
    training = ~in_fold(F.col("doc_id")) & F.col("doc_id").isNotNull()
    with scratch(docs.sparkSession) as keep:
        found = identify(known, training, PLACE)
        # stored, so that the planner knows how few they are and leaves the texts where they lie
        bad = keep(found.where("rejected").select("doc_id.*"))
    return without(rows, bad)
