"""Search with pivots against the search without, on vectors that are hard for it."""

from __future__ import annotations

import random
from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import pivots, search


def data(spark, seed, kind):
    rng = random.Random(seed)

    def vector():
        if kind == "clusters":
            centre = rng.choice(CENTRES)
            return [c + rng.gauss(0, 0.02) for c in centre]
        if kind == "equal":
            return [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
        v = [rng.gauss(0, 1) for _ in range(6)]
        return rng.choice([v, [0.0] * 6, [1e-20 * x for x in v], [-x for x in CENTRES[0]], [1e15 * x for x in CENTRES[1]]])

    CENTRES = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(6)]
    reviews = [(f"p{k % 3}", f"r{k}", datetime(2024, 1 + k % 4, 5), k % 17 != 0) for k in range(400)]
    vectors = [(r[1], "m", vector()) for r in reviews if r[1] != "r5"] + [("r9", "other", vector())]
    asked = [(k, f"p{k % 4}", None if k % 2 else ["2024-01", "2024-03"], vector(), "m") for k in range(12)]
    asked += [(50, "p0", None, [0.0] * 6, "m"), (51, "p1", ["2020-01"], vector(), "m"), (52, "p0", None, vector(), "other")]
    return (spark.createDataFrame(asked, "query_id int, product_id string, months array<string>, vector array<float>, model string"),
            spark.createDataFrame(reviews, "product_id string, review_id string, reviewed_at timestamp, eligible boolean"),
            spark.createDataFrame(vectors, "review_id string, model string, embedding array<float>"))


def test_same_rows_as_without_index(spark):
    for kind, limit in (("clusters", 5), ("equal", 3), ("hard", 8), ("hard", 30)):
        queries, reviews, vectors = data(spark, 4, kind)
        index = pivots.pivot_index(reviews, vectors, 4)
        found = pivots.nearest_indexed(queries, index, limit)
        names = ["query_id", "product_id", "review_id", "rank", "similarity"]
        want = search.nearest_reviews(queries, reviews, vectors, limit).select(names)
        got = found.nearest.select(names)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), kind
        effort = found.effort.agg(F.sum("multiplied"), F.sum("candidates")).first()
        if kind == "clusters":
            assert effort[0] < 0.7 * effort[1]
        assert effort[0] <= effort[1]
