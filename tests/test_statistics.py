from __future__ import annotations

import random
from math import comb

import pytest
from pyspark.sql import functions as F

from tidemark.operators import statistics
from tidemark.operators.statistics import anomaly_level
from tidemark.operators.topk import cumulative_counts, hash_rank
from tidemark.plans.radar import radar, radar_items, radar_summary

SCHEMA = "baseline_count bigint, baseline_total bigint, target_count bigint, target_total bigint"


def exact_tail(b, bt, t, tt):
    if bt == 0 or tt == 0 or b + t == 0:
        return 1.0
    hits, size = b + t, bt + tt
    tail = sum(comb(hits, k) * comb(size - hits, tt - k) for k in range(t, min(hits, tt) + 1))
    return tail / comb(size, tt)


def fisher(spark, cases):
    got = statistics.with_fisher_p(spark.createDataFrame(cases, SCHEMA)).collect()
    return {tuple(r)[:4]: r["p_value"] for r in got}


def test_fisher_golden(spark):
    p = fisher(spark, [(1, 6, 3, 6), (2, 40, 12, 40), (12, 40, 2, 40), (0, 0, 3, 10), (0, 10, 0, 10)])
    assert p[1, 6, 3, 6] == pytest.approx(0.2727, abs=1e-4)
    assert p[2, 40, 12, 40] < 0.01 and p[12, 40, 2, 40] > 0.99
    assert p[0, 0, 3, 10] == 1.0 and p[0, 10, 0, 10] == 1.0


def test_fisher_against_exact_integers(spark):
    rng = random.Random(5)
    cases = {(b, bt, t, tt) for bt, tt in [(1, 1), (7, 3), (15, 16), (60, 45), (300, 900), (4000, 2500)]
             for b, t in [(rng.randint(0, bt), rng.randint(0, tt)) for _ in range(12)] + [(bt, tt), (0, tt), (bt, 0)]}
    got = fisher(spark, sorted(cases))
    for case, p in got.items():
        assert p == pytest.approx(exact_tail(*case), rel=1e-8, abs=1e-300), case


def test_fisher_with_large_counts(spark):
    # reference values from 50-digit arithmetic
    want = {
        (50_000, 1_000_000, 50_400, 1_000_000): 0.09816432387787238,
        (5_000, 100_000, 5_200, 100_000): 0.02155245430539905,
        (20, 1_000_000, 45, 1_000_000): 0.001312981015689455,
        (50_000_000, 1_000_000_000, 50_020_000, 1_000_000_000): 0.020101370267285687,
    }
    for case, p in fisher(spark, list(want)).items():
        assert p == pytest.approx(want[case], rel=2e-8), case


def brute_bh(ps):
    order = sorted(range(len(ps)), key=lambda i: ps[i])
    q, low = [1.0] * len(ps), 1.0
    for rank in range(len(ps), 0, -1):
        low = min(low, ps[order[rank - 1]] * len(ps) / rank)
        q[order[rank - 1]] = low
    return q


@pytest.mark.parametrize("seed", [1, 2])
def test_bh_with_ties_and_many_ranges(spark, seed):
    rng = random.Random(seed)
    ps = [rng.choice([rng.random(), 1.0, 0.5, rng.random() ** 6]) for _ in range(1500)]
    tests = spark.createDataFrame(list(enumerate(ps)), "i int, p_value double")
    got = {r["i"]: r["q_value"] for r in statistics.with_bh_q(tests).collect()}
    want = brute_bh(ps)
    assert len(got) == len(ps)
    for i, q in enumerate(want):
        assert got[i] == pytest.approx(q, rel=1e-12)


def test_bh_golden(spark):
    tests = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.5,)], "p_value double")
    got = [r["q_value"] for r in statistics.with_bh_q(tests).orderBy("p_value").collect()]
    assert got == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.5])
    assert statistics.with_bh_q(tests.limit(0)).count() == 0


@pytest.mark.parametrize("values, level", [
    ((0.001, 0.05, 15.0, 5), "anomaly"), ((0.01, 0.2, 15.0, 5), "watch"),
    ((0.001, 0.05, 5.0, 5), "watch"), ((0.001, 0.05, 15.0, 2), "watch"),
    ((0.2, 0.5, 15.0, 5), None), ((0.01, 0.2, -3.0, 5), None), ((0.01, 0.05, None, 5), None),
])
def test_levels(spark, values, level):
    p, q, change, count = (F.lit(v) for v in values)
    assert spark.range(1).select(anomaly_level(p, q, change.cast("double"), count)).first()[0] == level


def brute_percentile(values, fraction):
    ordered = sorted(values)
    return ordered[min(round((len(ordered) - 1) * fraction), len(ordered) - 1)]


def test_nearest_rank(spark):
    rng = random.Random(3)
    data = {"a": [5], "b": [rng.randint(1, 40) for _ in range(999)], "c": [1, 2, 3, 4],
            "d": [rng.randint(1, 10**6) for _ in range(3000)]}
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("b", None)]
    df = spark.createDataFrame(rows, "k string, v bigint")
    got = {r["k"]: r for r in statistics.nearest_rank_percentiles(
        df, ["k"], "v", {"p25": 0.25, "p95": 0.95}).collect()}
    for k, vs in data.items():
        ordered = sorted(vs)
        n = len(vs)
        assert got[k]["p25"] == brute_percentile(vs, 0.25), k
        assert got[k]["p95"] == brute_percentile(vs, 0.95), k
        assert got[k]["median"] == (ordered[(n - 1) // 2] + ordered[n // 2]) / 2, k


def test_cumulative_counts_split_one_hot_key(spark):
    df = spark.range(5000).select(F.lit("k").alias("k"), F.col("id").alias("v"), F.lit(2).alias("n"))
    got = cumulative_counts(df, ["k"], "v", "n", pieces=16)
    assert got.select("piece").distinct().count() == 16
    assert got.filter("at_most <> 2 * (v + 1) or total <> 10000").count() == 0


def test_hash_rank_in_slices(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") < 2500, "hot").otherwise("cold").alias("g"), "id",
        F.sha2(F.col("id").cast("string"), 256).alias("h"),
        F.lit(120).alias("quota"))
    got = {r["id"]: r["rank"] for r in hash_rank(df, ["g"], "h", "id").collect()}
    limited = hash_rank(df, ["g"], "h", "id", "quota").collect()
    data = df.collect()
    for g in ("hot", "cold"):
        ordered = sorted((r["h"], r["id"]) for r in data if r["g"] == g)
        assert [got[i] for _, i in ordered] == list(range(1, len(ordered) + 1))
        assert sorted(r["id"] for r in limited if r["g"] == g) == sorted(i for _, i in ordered[:120])


def test_radar_skips_thin_months(catalog):
    parts = radar(catalog.months, catalog.rollup)
    row = radar_summary(parts, catalog.products).first()
    assert row.asDict() == {"products_total": 2, "products_evaluable": 0, "pairs_evaluated": 0,
                            "pairs_insufficient": 2, "tests": 0}


def test_radar_tests_every_negative_issue(catalog):
    from tidemark.operators.facts import issue_evidence

    parts = radar(catalog.months, catalog.rollup, min_analyzed=6)
    row = radar_summary(parts, catalog.products).first()
    assert (row["pairs_evaluated"], row["tests"]) == (2, 4)
    tests = {(r["product_id"], r["detail"]): r for r in parts.tests.collect()}
    leak = tests["coffee", "carafe leak"]
    assert leak["p_value"] == pytest.approx(0.2727, abs=1e-4)
    want = brute_bh([r["p_value"] for r in tests.values()])
    assert [r["q_value"] for r in tests.values()] == pytest.approx(want)
    items = radar_items(parts, evidence=issue_evidence(catalog.issue_facts))
    assert items.count() == 0


@pytest.mark.parametrize("error", [statistics.RANK_ERROR, 1e-9])
def test_nearest_rank_of_many_values(spark, monkeypatch, error):
    """Values beyond the sketch's size; brackets too narrow to hold the ranks are made up for."""
    monkeypatch.setattr(statistics, "SKETCH", 64)
    monkeypatch.setattr(statistics, "RANK_ERROR", error if error < 1e-3 else 0.05)
    rng = random.Random(6)
    data = {"wide": [rng.gauss(0, 1e6) for _ in range(5000)], "ties": [float(rng.randint(1, 3)) for _ in range(4000)],
            "one": [7.5] * 300, "few": [1.0, 2.0], "none": []}
    rows = [(k, v) for k, vs in data.items() for v in [*vs, None]]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in statistics.nearest_rank_percentiles(
        df, ["k"], "v", {"p0": 0.0, "p25": 0.25, "p95": 0.95, "p100": 1.0}, [F.count("*").alias("rows")]).collect()}
    assert got["none"]["rows"] == 1 and got["none"]["median"] is None
    for k, vs in data.items():
        assert got[k]["rows"] == len(vs) + 1
        if vs:
            assert [got[k][c] for c in ("p0", "p25", "p95", "p100")] == [
                brute_percentile(vs, f) for f in (0.0, 0.25, 0.95, 1.0)], k
            assert got[k]["median"] == (sorted(vs)[(len(vs) - 1) // 2] + sorted(vs)[len(vs) // 2]) / 2
