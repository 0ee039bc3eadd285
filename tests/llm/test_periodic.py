"""Periodic runs against a walk over every lag."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import periodic, queries

BLANKS = " \t\n\x0b\x0c\r"


def words_of(text):
    for c in BLANKS[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def every_lag(words, least=12):
    """All runs by comparing each word with the one ``lag`` before it, lag after lag."""
    found, n = {}, len(words)
    for lag in range(1, n):
        i = lag
        while i < n:
            first = i
            while i < n and words[i] == words[i - lag]:
                i += 1
            if i - first + lag >= max(least, 2 * lag):
                found.setdefault((first - lag, i), lag)
            i += 1
    return sorted((a, e - a, q) for (a, e), q in found.items())


def numbers(words):
    seen = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), max_size=25), st.integers(1, 9)), max_size=6))
def test_runs_of_repeated_parts(parts):
    words = [w for part, times in parts for w in part * times]
    assert periodic.find_runs(numbers(words)) == every_lag(words)


def test_runs_of_random_words():
    rng = random.Random(3)
    for _ in range(300):
        words = [rng.randrange(rng.choice([1, 2, 3, 40])) for _ in range(rng.randint(0, 200))]
        for _ in range(rng.randint(0, 3)):
            if words:
                a = rng.randrange(len(words))
                p = rng.randint(1, max(1, (len(words) - a) // 2))
                words[a:] = [words[a + k % p] for k in range(len(words) - a)]
        assert periodic.find_runs(numbers(words)) == every_lag(words)


def test_long_texts_of_few_words_stay_cheap():
    n = 200_000
    assert periodic.find_runs(np.zeros(n, np.int64)) == [(0, n, 1)]
    assert periodic.find_runs(np.arange(n) % 977) == [(0, n, 977)]


def test_collapsed_texts(spark):
    loop = "a b c " * 4
    texts = [None, "", " \t\n", "x " * 11, "x " * 12, "x\ty\x0b" * 6 + "z", f"head {loop}tail", "é ü " * 9, loop + "a"]
    rows = [(None if k == 8 else k, t, "clash", 1) for k, t in enumerate(texts)] + [(6, texts[6], "again", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int")
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed)
                  for r in periodic.periodic_runs(docs).collect()), key=str)
    want = []
    for key, text, *_ in rows:
        words = words_of(text or "")
        runs = every_lag(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        want.append((key, len(words), runs, " ".join(w for i, w in enumerate(words) if i not in gone)))
    assert got == sorted(want, key=str)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_query_against_every_lag(spark, tmp_path):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab cd ef gh ij".split()) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    texts += [None, "", "\n", "one", "w " * 30]
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)] + [(None, "n " * 20, None, None, None)]
    spark.createDataFrame(rows, queries.DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op13_periodic(spark, str(tmp_path)).collect()}
    damaged = 0
    for key, text, *_ in rows:
        words = words_of(text or "")
        if key is not None and words:
            h = zlib.crc32(str(key).encode())
            if h % 10 == 0:
                damaged, g, n = damaged + 1, h // 10, len(words)
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = every_lag(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        row = got[key]
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        assert row.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert damaged > 3 and len(got) == len(rows)
