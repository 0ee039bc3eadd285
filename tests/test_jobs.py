from __future__ import annotations

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation
from tidemark.plans import jobs
from tidemark.sources import shards


def millis(year, month, day):
    return int(datetime(year, month, day, tzinfo=timezone.utc).timestamp() * 1000)


@pytest.fixture(scope="module")
def raw(spark):
    rows = [(5.0, "t", f"text {i}", "V", p, f"U{i}", millis(2023, m, 1 + i % 27))
            for p, n in (("P1", 60), ("P2", 52)) for m in (1, 2, 3, 4) for i in range(n)]
    rows.append(rows[0])
    return spark.createDataFrame(rows, shards.REVIEW_SCHEMA)


@pytest.fixture(scope="module")
def meta(spark):
    rows = [(p, f" Title {p} ", "m", 4.5, 9, "s", (["u"], None, None), ["d"], ["f"]) for p in ("P1", "P2")]
    return spark.createDataFrame(rows, shards.METADATA_SCHEMA).withColumn("shard_order", F.lit(1))


def selection(spark, months=("2023-01", "2023-02", "2023-03"), ids=("P1", "P2")):
    return spark.createDataFrame(
        [("Toys", p, list(months), "20", "이름", None, None, None) for p in ids],
        "category string, parent_asin string, months array<string>, analysis_sample_size string, "
        "title_ko string, title_ko_source string, description_ko string, product_type string")


def test_profile(raw, meta):
    found = jobs.profile_category(raw, meta.filter("parent_asin = 'P1'"))
    assert found.audit.first()["eligible_rows"] == 449
    assert found.windows.count() == 2
    # the window without metadata is left out; a profile counts copies too
    assert [(r["parent_asin"], r["title"], r["review_count"]) for r in found.candidates.collect()] == [
        ("P1", " Title P1 ", 181)]


def test_import_is_idempotent(spark, raw, meta, tmp_path):
    tables = str(tmp_path / "products"), str(tmp_path / "reviews")
    first = jobs.import_category(raw, meta, selection(spark), *tables, per_category=2).first()
    assert (first["selected_source_rows"], first["excluded_outside_period"], first["excluded_exact_duplicate"]) == (449, 112, 1)
    assert (first["reviews_inserted"], first["reviews_present"], first["products_upserted"]) == (336, 336, 2)
    again = jobs.import_category(raw, meta, selection(spark), *tables, per_category=2).first()
    assert (again["reviews_inserted"], again["reviews_present"]) == (0, 336)


@pytest.mark.parametrize("options, message", [
    ({"ids": ("P1",)}, "wrong_product_count"), ({"ids": ("P1", "P3")}, "no metadata"),
    ({"months": ("2023-03", "2023-04", "2023-05")}, "volumes"),
])
def test_import_stops_before_writing(spark, raw, meta, tmp_path, options, message):
    tables = str(tmp_path / "products"), str(tmp_path / "reviews")
    with pytest.raises(ValueError, match=message):
        jobs.import_category(raw, meta, selection(spark, **options), *tables, per_category=2)
    assert not list(tmp_path.iterdir())


def test_evaluation_samples_and_sheets(spark):
    rng = random.Random(4)
    rows = [("p", f"r{i}", rng.randint(1, 5), datetime(2024, rng.randint(1, 3), 3), True, None,
             "It never worked" if i % 2 else "fine") for i in range(90)]
    reviews = spark.createDataFrame(rows, "product_id string, review_id string, rating int, "
                                          "reviewed_at timestamp, eligible boolean, title string, text string")
    drawn = jobs.evaluation_samples(reviews)
    assert (drawn.trial.count(), drawn.evaluation.count(), drawn.overlap.first()[0]) == (5, 10, 0)
    assert {r["text"] for r in drawn.hard_cases.collect()} == {"It never worked"}
    full = reviews.join(drawn.evaluation.select("review_id", (F.col("turn") + 1).alias("position")), "review_id").withColumns({
        "parent_asin": F.lit("A"), "product_name_ko": F.lit(None).cast("string"), "category": F.lit("c"),
        "title_ko": F.lit(None).cast("string"), "text_ko": F.lit(None).cast("string")})
    blind = evaluation.sheet(full, "evaluation", evaluation.BLIND_COLUMNS).collect()
    assert [r["sample_id"] for r in blind][:2] == ["evaluation-001", "evaluation-002"]
    assert {(r["review_status"], r["reviewer"], r["translation_notice"]) for r in blind} == {("pending", "", "번역 없음")}


def test_trial_rows(spark):
    sample = spark.createDataFrame([(1, "r1"), (2, "r2")], "position int, review_id string")
    reviews = spark.createDataFrame(
        [("r1", "p", 4, datetime(2025, 1, 31, 23), None, "body"), ("r2", "p", 4, datetime(2025, 1, 31, 23), "t", "longer")],
        "review_id string, product_id string, rating int, reviewed_at timestamp, title string, text string")
    products = spark.createDataFrame([("p", None, "Toys")], "product_id string, product_name_ko string, category string")
    results = spark.createDataFrame(
        [("run", "r1", "succeeded", 2, 50, 9, [("e",)]), ("old", "r2", "failed", 1, 5, 9, [])],
        "run_id string, review_id string, status string, attempt_count int, duration_ms int, input_chars int, error_history array<struct<type: string>>")
    labels = spark.createDataFrame([("run", "r1", "a", "b", "negative", "q"), ("old", "r1", "z", "z", "negative", "q")],
                                   "run_id string, review_id string, aspect string, detail string, polarity string, evidence string")
    got = evaluation.trial_rows(sample, reviews, products, results, labels, "run").collect()
    assert [(r["sample_id"], r["status"], r["attempt_count"], r["input_chars"]) for r in got] == [
        ("trial-001", "succeeded", 2, 9), ("trial-002", "not_run", 0, 6)]
    assert got[0]["predicted_labels_json"] == '[{"aspect_code":"a","detail_code":"b","polarity":"negative","evidence_span":"q"}]'
    assert got[1]["predicted_labels_json"] == "[]"
