"""Prefix postings of the near-copy search: what is stored, and what a plain loop over all sets finds."""

from __future__ import annotations

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import simhash


def test_texts_with_nothing_in_common_store_no_postings(spark, monkeypatch):
    """Also where far more shingles occur than any table of bits can tell: the search stores a row a text, not one a shingle."""
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcdefghijklmnop", k=300)).replace(" ", f" x{k}") for k in range(60)]
    texts.append(texts[7] + " and some more")
    stored = []
    cut = simhash.cut

    def watched(df):
        out = cut(df)
        stored.append(out.count())
        return out

    monkeypatch.setattr(simhash, "cut", watched)
    monkeypatch.setattr(simhash, "LEAST_CELLS", 64)
    monkeypatch.setattr(simhash, "MOST_CELLS", 64)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = simhash.similar_documents(docs, tables=1, budget=1)
    groups = {r.doc_id: r.component for r in found.collect()}
    assert len(set(groups.values())) == 60 and groups[7] == groups[60]
    assert max(stored) < 600


@pytest.mark.parametrize("posted", [1 << 20, 100])
def test_postings_that_several_sets_have(monkeypatch, posted):
    monkeypatch.setattr(simhash, "POSTED", posted)
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abc", k=rng.randint(0, 60))) for _ in range(80)] + [None, "", "a b c", "a b c"]
    levels = np.array([rng.randint(0, 3) for _ in range(64)], np.uint8)
    sets = [s for _, _, part in simhash._shingle_sets(pa.array(texts), 5) for s in part]
    holders: dict[int, dict[int, tuple[int, int]]] = {}
    for s in sets:
        for place, x in enumerate(simhash.prefix_of(s, levels, 0.8) if len(s) else []):
            holders.setdefault(int(x), {})[int(simhash._digest(s).view(np.int64))] = (len(s), place)
    want = sorted((node, size, place, x) for x, nodes in holders.items() if len(nodes) > 1 for node, (size, place) in nodes.items())
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[k: k + 30], pa.string())], names=["text"]) for k in range(0, len(texts), 30)]
    # two tasks, and one that reads what they have dealt, by range
    dealt = [b for part in (batches[:1], batches[1:]) for b in simhash._postings(iter(part), 5, SimpleNamespace(value=levels), 0.8, 64)]
    rows = pa.Table.from_batches(dealt).sort_by("part")
    got = [tuple(r.values()) for b in simhash._met(iter(rows.to_batches(max_chunksize=7))) for r in b.to_pylist()]
    assert want and sorted((n, s, p, int(np.int64(x).view(np.uint64))) for n, s, p, x in got) == want
