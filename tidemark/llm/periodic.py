"""Periodic runs of words: an online sparse dynamic program over diagonals.

Two equal words at positions j < i lie on the diagonal of lag i - j. A stretch whose words repeat
after q words is a match of lag q, so runs are read off match lengths that grow by one a word:
for each word its earlier occurrences extend the diagonals of their lags, and a diagonal that is not
extended has ended and emits its run if it is long enough.

Kept sparse without losing a run. A run of period q and at least ``max(least, 2q)`` words is a match of at
least q words. So for lags from B up to 2B a word only counts with the B - 1 words before it: its
occurrence is that of a block of B words, named by doubling, and blocks that occur once drop out. A block
inside a run of a period of at most B / 2 meets none of the same run: those lags are multiples of that
period. Then a block has at most two earlier occurrences a lag range, but for texts made of many long stretches
of one short period, where all that differ in place are still walked. Lags below ``SHORT`` are few and are
walked as whole diagonals.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W

SHORT = 16  # lags below this are walked in full
PAIRS = 1 << 18  # occurrences that are listed at once
LEAST = 12  # words of the shortest run

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_ARROW_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

Run = tuple[int, int, int]


def _whole_diagonal(ids: np.ndarray, lag: int, least: int) -> Iterator[Run]:
    """Runs ``first, end, lag`` of one lag."""
    same = np.flatnonzero(ids[lag:] != ids[:-lag]) if len(ids) > lag else np.zeros(0, np.int64)
    size = max(len(ids) - lag, 0)
    # matches lie between the places where words differ
    lo = np.concatenate([[0], same + 1])
    hi = np.concatenate([same, [size]])
    long = hi - lo >= max(lag, least - lag)
    for a, b in zip(lo[long].tolist(), hi[long].tolist()):
        yield a, b + lag, lag


def _doubled(name: np.ndarray, size: int) -> np.ndarray:
    """Names of blocks of ``2 * size`` words by their last word; -1 where a block occurs once."""
    at = np.flatnonzero(name >= 0)
    at = at[at >= size]
    at = at[name[at - size] >= 0]
    out = np.full(len(name), -1, np.int64)
    if len(at):
        pair = name[at - size] * np.int64(len(name) + 1) + name[at]
        _, of, often = np.unique(pair, return_inverse=True, return_counts=True)
        again = often[of] > 1
        out[at[again]] = of[again]
    return out


def _covers(runs: dict[tuple[int, int], int], n: int, size: int) -> np.ndarray:
    """For the last word of each block inside a run of a period of at most ``size / 2``: where that run begins."""
    out = np.full(n, -1, np.int64)
    for (first, end), period in runs.items():
        if 2 * period <= size <= end - first:
            out[first + size - 1: end] = first
    return out


def _occurrences(name: np.ndarray, begins: np.ndarray, size: int) -> Iterator[tuple[int, list[int]]]:
    """Positions in order with the lags, from ``size`` to below ``2 * size``, of their block's earlier occurrences."""
    at = np.flatnonzero(name >= 0)
    order = np.argsort(name[at], kind="stable")
    step = np.int64(len(name) + 1)
    key = name[at][order] * step + at[order]
    base = name[at] * step
    upper = at - size
    inside = begins[at] >= 0
    upper[inside] = np.minimum(upper[inside], begins[at][inside] + size - 2)
    lower = np.maximum(at - 2 * size + 1, 0)
    lo = np.searchsorted(key, base + lower)
    n = np.maximum(np.searchsorted(key, base + np.maximum(upper, -1), "right") - lo, 0)
    some = n > 0
    at, lo, n = at[some], lo[some], n[some]
    ends = np.cumsum(n)
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
        within = np.arange(int(n[a:b].sum())) - np.repeat(np.cumsum(n[a:b]) - n[a:b], n[a:b])
        earlier = key[np.repeat(lo[a:b], n[a:b]) + within] % step
        lags = (np.repeat(at[a:b], n[a:b]) - earlier).tolist()
        p = 0
        for i, m in zip(at[a:b].tolist(), n[a:b].tolist()):
            yield i, lags[p: p + m]
            p += m
        a = b


def _diagonals(found: Iterator[tuple[int, list[int]]], size: int) -> Iterator[Run]:
    """Grow the matches of the active lags word by word; an ended match of at least its lag is a run."""
    active: dict[int, int] = {}  # lag, first word of its match
    last = -2
    for i, lags in found:
        if i != last + 1:
            for lag, first in active.items():
                if last - first + 1 >= lag:
                    yield first - lag, last + 1, lag
            active = {}
        now = {lag: active.pop(lag, i - size + 1) for lag in lags}
        for lag, first in active.items():
            if last - first + 1 >= lag:
                yield first - lag, last + 1, lag
        active, last = now, i
    for lag, first in active.items():
        if last - first + 1 >= lag:
            yield first - lag, last + 1, lag


def find_runs(ids: np.ndarray, least: int = LEAST) -> list[Run]:
    """All runs ``start, length, period`` of a sequence of numbers, by start, then period.

    A run has at least ``max(least, 2 * period)`` members, its period is its smallest, and no neighbour extends it.
    """
    if least > SHORT:
        raise ValueError(f"least is at most {SHORT}")
    runs: dict[tuple[int, int], int] = {}  # first, end: a stretch has one smallest period, found first
    for lag in range(1, SHORT):
        for first, end, _ in _whole_diagonal(ids, lag, least):
            runs.setdefault((first, end), lag)
    size, name = 1, ids.astype(np.int64)
    often = np.bincount(ids) if len(ids) else ids
    name = np.where(often[ids] > 1, name, -1)
    while (name >= 0).any() and 2 * size <= len(ids):
        if size >= SHORT:
            for first, end, lag in _diagonals(_occurrences(name, _covers(runs, len(ids), size), size), size):
                runs.setdefault((first, end), lag)
        name = _doubled(name, size)
        size *= 2
    return sorted((first, end - first, lag) for (first, end), lag in runs.items())


def _numbers(texts: list[list[bytes]]) -> np.ndarray:
    """Word numbers of some texts in a row; no two texts share one."""
    next_id = count()
    out = []
    for words in texts:
        known: dict[bytes, int] = defaultdict(next_id.__next__)
        out.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _scan(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = W.text_bytes(batch.column(1))
        for lo, hi in W.row_groups(offsets):
            texts = [data[a:b].tobytes().split() for a, b in zip(offsets[lo:hi].tolist(), offsets[lo + 1: hi + 1].tolist())]
            sizes = np.array([len(t) for t in texts], np.int64)
            begins = np.cumsum(sizes) - sizes
            per: list[list[Run]] = [[] for _ in texts]
            for start, length, period in find_runs(_numbers(texts), least):
                k = int(np.searchsorted(begins, start, "right")) - 1
                per[k].append((start - int(begins[k]), length, period))
            kept = []
            for words, runs in zip(texts, per):
                if runs:
                    keep = np.ones(len(words), bool)
                    for start, length, period in runs:
                        keep[start + period: start + length] = False
                    words = compress(words, keep.tolist())
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(sizes),
                 pa.array([[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in per], _ARROW_RUNS),
                 pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row of ``docs``.

    Words are runs of characters other than blanks, tabs and line ends. ``runs`` has start, length and period
    in words, by start, then period. ``collapsed`` keeps the words outside runs and the first period
    of each run, joined by one space; a word is dropped if any run drops it.

    Null, empty and blank texts have no words, no runs and an empty collapsed text. Keys are passed through, so they may be
    null or repeat, and repeated rows each get a row; an empty table gives none; other columns are not
    read. Rows are independent: nothing is shuffled. A task holds some four megabytes of texts, or one longer text.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        lambda it: _scan(it, least), f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string")
