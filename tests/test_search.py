from __future__ import annotations

import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions.hashing import content_hash
from tidemark.operators import search


def cos(a, b):
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(2)
    reviews, vectors = [], []
    for i in range(120):
        product = "hot" if i % 4 else "cold"
        reviews.append((product, i, datetime(2025, 1 + i % 3, 5), i != 7))
        if i % 5:
            vectors.append((i, "m", [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(6)]))
    return (spark.createDataFrame(reviews, "product_id string, review_id int, reviewed_at timestamp, eligible boolean"),
            spark.createDataFrame(vectors, "review_id int, model string, embedding array<float>"), reviews, vectors)


def ask(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id int, product_id string, months array<string>, vector array<float>, model string")


def test_nearest_reviews_against_brute_force(spark, data):
    reviews, vectors, raw, stored = data
    q = [1.0, 0.0, 0.5, 0.0, -1.0, 0.5]
    queries = ask(spark, (1, "hot", None, q, "m"), (2, "hot", ["2025-02"], q, "m"), (3, "cold", ["2025-01", "2025-03"], q, "m"),
                  (4, "hot", None, q, "other"))
    got = search.nearest_reviews(queries, reviews, vectors, 6).collect()
    by_id = {i: v for i, _, v in stored}
    for query_id, product, months in ((1, "hot", {1, 2, 3}), (2, "hot", {2}), (3, "cold", {1, 3})):
        pool = [(1 - cos(by_id[i], q), i) for p, i, t, ok in raw if p == product and ok and t.month in months and i in by_id]
        want = [i for _, i in sorted((round(d, 12), i) for d, i in pool)[:6]]
        mine = [r for r in got if r["query_id"] == query_id]
        assert [r["review_id"] for r in sorted(mine, key=lambda r: r["rank"])] == want
    assert not [r for r in got if r["query_id"] == 4]


def test_limit_is_checked(spark, data):
    with pytest.raises(ValueError):
        search.nearest_reviews(ask(spark, (1, "hot", None, [1.0], "m")), data[0], data[1], 31)


def test_search_coverage(spark, data):
    reviews, vectors, raw, stored = data
    have = {i for i, _, _ in stored}
    queries = ask(spark, (1, "hot", ["2025-02", "2025-02"], [1.0], "m"), (2, "none", ["2025-02"], [1.0], "m"))
    got = {r["query_id"]: (r["embedded_reviews"], r["total_reviews"]) for r in search.search_coverage(queries, reviews, vectors).collect()}
    ids = [i for p, i, t, ok in raw if p == "hot" and t.month == 2 and ok]
    assert got == {1: (len([i for i in ids if i in have]), len(ids)), 2: (0, 0)}


def test_topics_and_faq(spark):
    topics = spark.createDataFrame(
        [("c", "a", "x", [1.0, 0.0]), ("c", "a", "y", [0.0, 1.0]), ("c", "b", "z", [1.0, 1.0]), ("d", "b", "w", [1.0, 0.0])],
        "category string, aspect string, detail string, vector array<float>")
    queries = spark.createDataFrame([(1, "c", [1.0, 0.1]), (2, "d", [0.0, 1.0])], "query_id int, category string, vector array<float>")
    got = search.nearest_topics(queries, search.topic_vectors(topics)).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["detail"]) for r in got] == [(1, 1, "x"), (1, 2, "z"), (2, 1, "w")]
    assert got[0]["similarity"] == round(cos([1.0, 0.1], [1.0, 0.0]), 3)
    faq = spark.createDataFrame([("k1", [1.0, 0.0], 0), ("k2", [1.0, 1.0], 1)], "faq_key string, vector array<float>, position int")
    best = {r["query_id"]: r["faq_key"] for r in search.best_faq(queries, faq).collect()}
    assert best == {1: "k1"}


def test_changed_text_is_pending_again(spark):
    reviews = spark.createDataFrame([("a", None, "x", True), ("b", "t", "y", True), ("c", "t", "z", True), ("d", "t", "z", False)],
                                    "review_id string, title string, text string, eligible boolean")
    hashed = reviews.withColumn("content_hash", content_hash(F.col("title"), F.col("text")))
    stored = hashed.filter("review_id <> 'c'").withColumn(
        "content_hash", F.when(F.col("review_id") == "b", "old").otherwise(F.col("content_hash")))
    assert {r["review_id"] for r in search.pending_embeddings(hashed, stored).collect()} == {"b", "c"}
