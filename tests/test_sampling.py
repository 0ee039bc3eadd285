from __future__ import annotations

import hashlib
import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import sampling


@pytest.fixture(scope="module")
def reviews(spark):
    rng = random.Random(11)
    rows = []
    for product, n in (("p1", 400), ("p2", 90)):
        for i in range(n):
            month = rng.choice([1, 1, 1, 2, 3])
            rating = rng.choice([1, 5, 5, 5, 4, 4, 3])  # rating 2 never occurs
            rows.append((product, f"{product}-{i}", rating, datetime(2024, month, rng.randint(1, 28)), True))
    rows.append(("p1", "p1-out", 5, datetime(2024, 1, 1), False))
    return spark.createDataFrame(
        rows, "product_id string, review_id string, rating int, reviewed_at timestamp, eligible boolean"
    ).cache()


@pytest.mark.parametrize("counts, size, quotas", [
    ([140, 166, 67], 100, [38, 45, 18]), ([3, 2], 20, [3, 2]), ([3, 2], None, [3, 2]), ([7], 7, [7]),
    ([5, 5], 3, [2, 2]),
])
def test_quotas(spark, counts, size, quotas):
    df = spark.createDataFrame([("p", i, n, size) for i, n in enumerate(counts)],
                               "product_id string, month_idx int, n bigint, sample_size int")
    got = [r["quota"] for r in sampling.month_quotas(df).orderBy("month_idx").collect()]
    assert got == quotas


def digest(value):
    return hashlib.sha256(value.encode()).hexdigest()


def brute_sample(rows, size, salt="processing-order"):
    months = {}
    for r in rows:
        months.setdefault((r["reviewed_at"].year, r["reviewed_at"].month), []).append(r["review_id"])
    total = sum(map(len, months.values()))
    picked = {}
    for m, ids in months.items():
        quota = len(ids) if size >= total else min(len(ids), -(-size * len(ids) // total))
        picked[m] = sorted(ids, key=lambda i: digest(f"{salt}|{i}"))[:quota]
    order = sorted(((k + 0.5) / len(ids), m, i) for m, ids in picked.items() for k, i in enumerate(ids))
    return picked, [i for _, _, i in order]


def test_month_sample_and_processing_order(spark, reviews):
    sizes = spark.createDataFrame([("p1", 70), ("p2", 500)], "product_id string, sample_size int")
    sample = sampling.month_sample(reviews, sizes)
    data = [r for r in reviews.collect() if r["eligible"]]
    staged = sampling.staged_sample(sample.drop("sample_size"), sizes).collect()
    for product, size in (("p1", 70), ("p2", 500)):
        picked, order = brute_sample([r for r in data if r["product_id"] == product], size)
        mine = sorted((r["process_rank"], r["review_id"], r["stage"]) for r in staged
                      if r["product_id"] == product)
        assert [i for _, i, _ in mine] == order
        assert sum(len(v) for v in picked.values()) >= min(size, len(order))
        for rank, _, stage in mine:
            want = next((n for n, s in enumerate((20, 30, 50, 70, 100), 1) if rank <= min(s, size)), 6)
            assert stage == want


def test_round_robin_takes_months_in_turn(reviews):
    ranked = sampling.product_month_order(reviews.filter("product_id = 'p2'"), ["2024-03", "2024-01"])
    got = ranked.orderBy(*sampling.round_robin_order(ranked)).collect()
    months = [r["month_idx"] % 12 for r in got[:6]]
    assert months == [0, 2, 0, 2, 0, 2]
    assert len(got) == reviews.filter("product_id = 'p2' and month(reviewed_at) in (1, 3)").count()


def brute_greedy(rows, product, per_product, seed):
    chosen, used = [], Counter()
    for turn in range(per_product):
        free = [r for r in rows if r["review_id"] not in chosen]
        pool = [r for r in free if r["rating"] == turn % 5 + 1] or free
        best = min(pool, key=lambda r: (
            used[r["reviewed_at"].month], digest(f"{seed}:{product}:{turn}|{r['review_id']}")))
        chosen.append(best["review_id"])
        used[best["reviewed_at"].month] += 1
    return chosen


@pytest.mark.parametrize("per_product", [5, 10])
def test_stratified_sample_equals_the_plain_loop(reviews, per_product):
    got = sampling.stratified_sample(reviews, per_product, "s").collect()
    data = [r for r in reviews.collect() if r["eligible"]]
    for product in ("p1", "p2"):
        want = brute_greedy([r for r in data if r["product_id"] == product], product, per_product, "s")
        mine = sorted((r["turn"], r["review_id"]) for r in got if r["product_id"] == product)
        assert [i for _, i in mine] == want


def test_second_sample_is_disjoint_and_summarised(reviews):
    first = sampling.stratified_sample(reviews, 5, "s").cache()
    second = sampling.stratified_sample(reviews, 10, "t", exclude=first)
    assert sampling.overlap(first, second).first()[0] == 0
    named = second.select(F.lit("c").alias("category"), "product_id", "rating",
                          F.lit("m").alias("month"))
    got = {(r["dimension"], r["value"]): r["n"] for r in sampling.sample_summary(named).collect()}
    assert got["total", "all"] == 20 and got["product_id", "p1"] == 10 and got["category", "c"] == 20


def test_exhausted_product_fails(reviews):
    few = reviews.filter("review_id in ('p1-1', 'p1-2')")
    with pytest.raises(Exception, match="fewer than 3 reviews"):
        sampling.stratified_sample(few, 3, "s").collect()


@pytest.mark.parametrize("spare", [20, -8, -9])
def test_first_by_hash_is_exact_where_too_few_rows_pass_the_bound(spark, monkeypatch, spare):
    """Few rows or none pass the bound of a large group, which is then sorted whole; null ratings are a group."""
    monkeypatch.setattr(sampling, "SPARE_ROWS", spare)
    rows = spark.range(400).selectExpr(
        "'p' as product_id", "id as review_id", "if(id % 2 = 0, null, 1) as rating", "cast(id div 200 as int) as month_idx")
    got = sampling._first_by_hash(rows, ["product_id", "rating", "month_idx"], 3, "s").collect()
    want = set()
    for turn in range(3):
        for rest in (0, 1):
            for month in (0, 1):
                ids = [i for i in range(400) if i % 2 == rest and i // 200 == month]
                ids.sort(key=lambda i: hashlib.sha256(f"s:p:{turn}|{i}".encode()).hexdigest())
                want |= {(turn, i, rank) for rank, i in enumerate(ids[: turn + 1], 1)}
    assert sorted((r["turn"], r["review_id"], r["rank"]) for r in got) == sorted(want)


def test_few_offers_are_sorted(spark, tmp_path):
    """Of 30,000 reviews in one month, rating and product about fifty a turn are sorted, not all."""
    rows = spark.range(30000).selectExpr("'p' as product_id", "id as review_id", "1 as rating", "0 as month_idx")
    plan = sampling._first_by_hash(rows, ["product_id", "rating", "month_idx"], 10, "s")
    assert plan.count() == 55
    assert "WindowGroupLimit" not in plan._jdf.queryExecution().executedPlan().toString()
