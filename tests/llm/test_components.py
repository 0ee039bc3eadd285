"""Components against a plain walk, and the number of rounds on chains."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import components


def walked(links):
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    root = {}
    for node in sorted(near):
        todo = [] if node in root else [node]
        while todo:
            at = todo.pop()
            if at not in root:
                root[at] = node
                todo += near[at]
    return root


@pytest.fixture
def stored(monkeypatch):
    """Number of tables stored so far."""
    count = []
    cut = components.cut
    monkeypatch.setattr(components, "cut", lambda df: count.append(1) or cut(df))
    return count


@pytest.mark.parametrize("alone", [True, False])
def test_long_chains(spark, stored, monkeypatch, alone):
    """A thousand links in ascending order, also where each partition holds few neighbouring ones."""
    if not alone:
        monkeypatch.setattr(components, "_local_stars", lambda batches: batches)
    links = [(k, k + 1) for k in range(1000)] + [(2000, 2001), (5, 5)]
    edges = spark.createDataFrame(links, "a long, b long").repartition(7)
    got = {r.node: r.root for r in components.connected_components(edges).collect()}
    assert got == walked([x for x in links if x[0] != x[1]])
    assert len(stored) <= (6 if alone else 15)


def test_random_links(spark):
    rng = random.Random(8)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(1000, k) for k in range(1001, 1300)]
    edges = spark.createDataFrame(links, "a long, b long").withColumn("other", F.lit(1)).repartition(5)
    got = {r.node: r.root for r in components.connected_components(edges).collect()}
    assert got == walked([x for x in links if x[0] != x[1]])
    assert components.connected_components(edges.limit(0)).collect() == []
