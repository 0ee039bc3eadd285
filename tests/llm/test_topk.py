"""Top products of vectors with components of any size, against whole numbers of any size."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import topk

LONG = 2**63 - 1


def test_places_sort_as_numbers():
    rng = random.Random(2)
    values = {0, 1, -1, 255, 256, -255, -256, LONG, -LONG - 1} | {
        rng.choice([1, -1]) * rng.getrandbits(rng.randint(1, 900)) for _ in range(500)}
    assert sorted(values) == sorted(values, key=topk.place_of)


@pytest.mark.parametrize("kind, sizes", [("float", [1.0, 9e6, 1e30]), ("double", [1.0, 3e5, 9e6, 1e100]), ("float", [3e38])])
def test_large_components(spark, kind, sizes):
    rng = random.Random(5)
    numpy_kind = np.float32 if kind == "float" else np.float64
    rows = []
    for n in range(240):
        base = [rng.uniform(-1, 1) * rng.choice(sizes) for _ in range(6)]
        rows.append((n, [float(numpy_kind(x)) for x in base]))
    rows += [(300 + n, rows[n][1]) for n in range(20)]
    # scores that differ in their last digit alone
    rows += [(400 + n, [float(numpy_kind(2.0**40)), n / 256, 0.0, 0.0, 0.0, 1 / 256]) for n in range(30)]
    rows += [(550, [float(numpy_kind(2.0**40)), 1 / 256, 0.0, 0.0, 0.0, 0.0]), (600, [])]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    got = sorted(tuple(r) for r in topk.top_products(df, F.col("vec_id") % 50 == 0).collect())
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    want = []
    for i, v in whole.items():
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, u)), j) for j, u in whole.items() if j != i and len(u) == len(v))
            want += [(i, k + 1, j, max(-LONG - 1, min(LONG, -s))) for k, (s, j) in enumerate(best[:5])]
    assert got == sorted(want)


def test_squares_beyond_a_double_are_refused(spark):
    df = spark.createDataFrame([(0, [1e200]), (1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="no finite square"):
        topk.top_products(df, F.col("vec_id") == 0).collect()
