"""Benchmark decontamination by a prefix-filtered set join.

A benchmark window (``window`` consecutive words of an item, or all words of a shorter one) is
a set of word shingles. A document holds the window only if it holds all of its shingles, so
for exact containment a prefix of one token is enough: the window's rarest shingle, by its count
over all documents. Documents send only the places of those shingles, with the words around; the
join on the shingle gives candidates, which must fit by position and length and are then compared
word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.rows import DOC, PLACE, ROW, cut, placed, released, scratch, without

FILTER_BITS = 24  # the filter sent to all tasks is 2 MiB, whatever the benchmark's size

WINDOWS = "item_id string, window string, size int, hashes array<bigint>, k int"
COUNTS = "hash bigint, n bigint"
PLACES = (
    "_row bigint, n_words bigint, places array<struct<hash: bigint, at: bigint, begin: bigint, near: string>>"
)


def _windows(batches: Iterator[pa.RecordBatch], window: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items = batch.column(0).to_pylist()
        data, offsets = W.text_bytes(batch.column(1))
        found = W.words_of(data, offsets)
        out: list[list] = [[], [], [], [], []]
        for row, item in enumerate(items):
            lo, hi = int(found.first[row]), int(found.first[row + 1])
            size = min(window, hi - lo)
            if size == 0:
                continue
            kk = min(k, size)
            hashes = W.shingle_hashes(found.hash[lo:hi], kk).view(np.int64)
            for at in range(hi - lo - size + 1):
                values = item, found.text(lo + at, lo + at + size), size, \
                    hashes[at: at + size - kk + 1].tolist(), kk
                for column, value in zip(out, values):
                    column.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.int32(),
                                                  pa.list_(pa.int64()), pa.int32()))],
            names=["item_id", "window", "size", "hashes", "k"])


def hash_filter(spark: SparkSession, hashes: DataFrame):
    """A bitmap of the column ``hash``, at most 2**FILTER_BITS bits, sent to all tasks.

    It is put together in Spark: one row for each 64 bits that has any.
    """
    place = F.col("hash").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    rows = hashes.select(F.shiftright(place, 6).cast("int").alias("at"), one.alias("bit")).groupBy(
        "at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros((1 << FILTER_BITS) // 64, np.uint64)
    bits[np.asarray(rows.column("at"))] = np.asarray(rows.column("bits")).view(np.uint64)
    return spark.sparkContext.broadcast(bits)


def _in_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64((1 << FILTER_BITS) - 1)
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) != 0


def _matches(found: W.Words, sizes: list[int], bits: np.ndarray):
    """Shingle size, first word and hash of the shingles that pass the filter, within one row each."""
    row_end = found.first[1:]
    for k in sizes:
        hashes = W.shingle_hashes(found.hash, k)
        at = np.flatnonzero(_in_filter(bits, hashes))
        row = np.searchsorted(found.first, at, side="right") - 1
        inside = at + k <= row_end[row]
        yield k, at[inside], row[inside], hashes[at[inside]]


def _counts(batches: Iterator[pa.RecordBatch], sizes: list[int], bits) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = W.text_bytes(batch.column(0))
        got = []
        for lo, hi in W.row_groups(offsets):
            found = W.words_of(data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo])
            got += [h for *_, h in _matches(found, sizes, bits.value)]
        if got:
            value, n = np.unique(np.concatenate(got).view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n)], names=["hash", "n"])


def _places(batches: Iterator[pa.RecordBatch], sizes: list[int], window: int, most: int, bits
            ) -> Iterator[pa.RecordBatch]:
    """Per row the number of words and the places of prefix tokens with the words around."""
    kind = pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int64()), ("begin", pa.int64()),
                               ("near", pa.string())]))
    for batch in batches:
        keys = np.asarray(batch.column(0))
        data, offsets = W.text_bytes(batch.column(1))
        for lo, hi in W.row_groups(offsets):
            found = W.words_of(data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo])
            places: list[list] = [[] for _ in range(hi - lo)]
            for k, at, row, hashes in _matches(found, sizes, bits.value):
                reach = window - k if k == most else 0  # a shorter shingle is its whole window
                first, end = found.first[row], found.first[row + 1]
                begin, stop = np.maximum(at - reach, first), np.minimum(at + k + reach, end)
                for r, h, p, b, s, f in zip(row.tolist(), hashes.view(np.int64).tolist(), at.tolist(),
                                            begin.tolist(), stop.tolist(), first.tolist()):
                    places[r].append({"hash": h, "at": p - f, "begin": b - f, "near": found.text(b, s)})
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[lo:hi]), pa.array(np.diff(found.first)), pa.array(places, kind)],
                names=["_row", "n_words", "places"])


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = 13, shingle: int = 5,
                  share: int = 20) -> tuple[DataFrame, DataFrame]:
    """Report and matches.

    Report, a row for each row of ``docs``: ``_row, doc_id, n_words, n_hit, n_items, items, contaminated``. A
    word inside any occurrence of a benchmark window is hit; ``items`` are the sorted ids (as
    text) of items with occurring windows; a document is contaminated if it has a hit word and
    ``share * n_hit >= n_words``.
    Matches, a row for each occurrence: ``_row, start, size, window`` (first word from 0).

    Null and blank texts have no words. Items without words have no window; items with a null id
    still hit words but are not listed. Repeated documents are reported each, repeated items
    once by id. An empty table on either side gives no hit. Other columns are not read.
    """
    spark = docs.sparkSession
    cells = cut(benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).alias("text"))
                .mapInArrow(lambda it: released(_windows(it, window, shingle)), WINDOWS))
    distinct = cells.groupBy("window").agg(
        F.first("size").alias("size"), F.first("hashes").alias("hashes"), F.first("k").alias("k"))
    tokens = distinct.select("window", "size", F.posexplode("hashes").alias("shift", "hash"))
    sizes = sorted(r.k for r in cells.select("k").distinct().collect())  # at most ``shingle`` values

    everything = hash_filter(spark, tokens.select("hash").distinct())
    counts = docs.select(F.col(text).alias("text")).mapInArrow(
        lambda it: released(_counts(it, sizes, everything)), COUNTS).groupBy("hash").agg(F.sum("n").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "hash", "shift"))
    prefixes = cut(tokens.join(counts, "hash", "left").groupBy("window", "size").agg(rarest.alias("p")).select(
        "window", "size", "p.hash", "p.shift"))

    chosen = hash_filter(spark, prefixes.select("hash").distinct())
    # the row number is made in the job that stores the places
    source = docs.select(F.monotonically_increasing_id().alias(ROW), F.col(doc_id).alias("doc_id"),
                         F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()

    def with_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            ids = batch.column(1)
            for out in _places(iter([pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)],
                                                                names=["r", "t"])]),
                               sizes, window, shingle, chosen):
                part = ids.slice(at, out.num_rows)
                at += out.num_rows
                yield pa.RecordBatch.from_arrays([*out.columns, part], names=[*out.schema.names, "doc_id"])

    rows = cut(source.mapInArrow(lambda it: released(with_id(it)), f"{PLACES}, doc_id {kind}"))

    candidates = rows.select(ROW, "n_words", F.explode("places").alias("c")).select(ROW, "n_words", "c.*")
    paired = candidates.join(prefixes, "hash").withColumn("start", F.col("at") - F.col("shift"))
    fits = paired.where("start >= begin and start + size <= n_words")
    around = F.slice(F.split("near", " "), (F.col("start") - F.col("begin") + 1).cast("int"), F.col("size"))
    matches = cut(fits.where(F.array_join(around, " ") == F.col("window")).select(
        ROW, "start", "size", "window").distinct())

    before = F.max(F.col("start") + F.col("size")).over(
        Window.partitionBy(ROW).orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.col("start") + F.col("size") - F.greatest("start", F.coalesce(before, F.lit(0)))
    hits = matches.select(ROW, "start", "size").distinct().select(
        ROW, F.greatest(fresh, F.lit(0)).alias("n")).groupBy(ROW).agg(F.sum("n").alias("n_hit"))
    items = matches.select(ROW, "window").distinct().join(
        cells.where("item_id is not null").select("window", "item_id").distinct(), "window")
    items = items.groupBy(ROW).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    report = rows.select(ROW, "doc_id", "n_words").join(hits, ROW, "left").join(items, ROW, "left").select(
        ROW, "doc_id", "n_words", n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"))
    return report, matches


def keep_clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
               stored: bool = False, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns kept.

    Each row is judged by itself; keys are not read, so they may be null or repeat. ``stored``: ``docs``
    is a table as read from Parquet, which need not be copied.
    """
    rows = placed(docs, stored)
    with scratch(docs.sparkSession) as keep:
        report, _ = contamination(rows.select(PLACE, F.col(DOC)[text].alias("text")), benchmark, PLACE, **options)
        # stored, so that the planner knows how few they are and leaves the texts where they lie
        bad = keep(report.where("contaminated").select("doc_id.*"))
    return without(rows, bad)
