"""Repeated passages against a loop over sentences kept in order."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from tidemark.llm import repeats


def sentences(text):
    """Sentences of all lines with their offsets, by a walk over the characters."""
    out, start = [], 0
    for k, c in enumerate(text + "\n"):
        after = (text + "\n")[k + 1: k + 2]
        end = None
        if c == "\n":
            end = k
        elif c in "。！？" and after not in "。！？":
            end = k + 1
        elif c in ".!?" and (after == "" or after.isspace()):
            end = k + 1
        if end is not None:
            part = text[start:end]
            if part.split():
                lead = len(part) - len(part.lstrip())
                out.append((part, start + lead, start + len(part.rstrip())))
            start = k + 1 if c == "\n" else end
    return out


def looped(rows, least):
    """Spans that go from each row: runs of neighbouring sentences met before in order of key, row and place."""
    first, spans = {}, []
    for n, (_, text) in enumerate(rows):
        run, gone = [], []
        for part, start, end in [*sentences(text or ""), (None, 0, 0)]:
            words = part.lower().split() if part else []
            key = " ".join(words)
            if part and key in first:
                run.append((start, end, max(len(words), sum(map(len, words)) // 6)))
                continue
            if sum(size for *_, size in run) >= least:
                gone.append((run[0][0], run[-1][1]))
            run = []
            if part:
                first[key] = n
        spans.append(gone)
    return spans


def test_passages_against_a_loop(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]

    def sentence(n):
        return " ".join(rng.choice(words) for _ in range(n)) + rng.choice([".", "!", "?", "..."])

    passages = [" ".join(sentence(rng.choice([1, 2, 5, 12])) for _ in range(rng.randint(3, 9))) for _ in range(8)]
    boiler = ["all rights reserved.", "see also here", sentence(12)]
    texts = [None, "", "  \n\t", passages[0], "\n".join(boiler)]
    for _ in range(60):
        parts = [sentence(rng.randint(1, 20)) for _ in range(rng.randint(0, 6))] + rng.sample(passages, rng.randint(0, 2)) + rng.sample(boiler, 1)
        rng.shuffle(parts)
        texts.append("".join(p + rng.choice([" ", "\n", "\n\n"]) for p in parts))
    texts += [texts[9], "句子一很长很长很长很长很长。句子二也很长很长很长很长很长！" * 8, "x 句子一很长很长很长很长很长。句子二也很长很长很长很长很长！ y"]
    rows = list(enumerate(texts)) + [(None, texts[12]), (None, passages[3].upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("place", F.lit("x")).coalesce(1)
    got = repeats.remove_passages(docs).collect()
    assert len(got) == len(rows)
    want = looped(rows, repeats.PASSAGE_WORDS)
    for r in got:
        key, text = rows[r._row]
        spans = [tuple(s) for s in r.removed]
        assert (r.doc_id, spans) == (key, want[r._row])
        assert r.kept_text == (None if text is None else "".join(
            text[a:b] for a, b in zip([0, *[e for _, e in spans]], [*[s for s, _ in spans], len(text)])))
    lost = " ".join(text[a:b] for (_, text), r in zip(rows, want) for a, b in r)
    assert sum(bool(s) for s in want) > 15 and not re.search("^see also here$", lost, re.M)
    assert repeats.remove_passages(docs.limit(0)).count() == 0


def test_a_line_meets_the_same_sentence_inside_a_line(spark):
    long = " ".join(f"word{k}" for k in range(60)) + "."
    short = " ".join(f"a{k} b{k} c{k}." for k in range(20))  # sentences of three words
    word = "x" * 100_000
    rows = [(1, long), (2, f"Before it. {long} After it."), (3, short), (4, f"New here! {short} And more."),
            (5, "see also here"), (6, "see also here"), (7, word), (8, f"{word}")]
    got = {r.doc_id: r.kept_text for r in repeats.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2] == "Before it.  After it." and got[4] == "New here!  And more."
    assert got[1] == long and got[3] == short and got[5] == got[6] == "see also here"
    assert got[7] == word and got[8] == ""


def test_texts_meet_their_spans_by_the_same_join_at_every_size(spark):
    """A few spans are not broadcast, as they grow with the texts."""
    rows = spark.createDataFrame([(k, "One two three four. " * 9) for k in range(3)], "doc_id long, text string")
    plan = repeats.remove_passages(rows)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
