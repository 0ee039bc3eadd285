"""Golden counts of the small catalog."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import LEAK, NOISE
from tidemark.functions.months import parse_month
from tidemark.operators import compare, facts
from tidemark.plans import catalog as listings
from tidemark.plans import insights


def rows(df, *keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


def test_active_run_is_the_newest_active_one(catalog):
    assert {r["run_id"] for r in catalog.products.collect()} == {"fixture-run"}


def test_no_run_for_real_products_outside_official_categories(spark, catalog):
    products = spark.createDataFrame(
        [("a", "real", "Electronics"), ("b", "real", "Appliances")],
        "product_id string, source_mode string, category string")
    runs = catalog.runs.withColumn("source_mode", F.lit("real"))
    got = {r["product_id"]: r["run_id"] for r in facts.attach_active_run(products, runs).collect()}
    assert got == {"a": "fixture-run", "b": None}


def test_month_rollup(catalog):
    got = rows(catalog.months, "product_id", "month_idx")
    january, february = parse_month("2025-01"), parse_month("2025-02")
    assert got["coffee", january]["rating_sum"] / 6 == 4.0
    assert got["coffee", february]["rating_sum"] == 17
    assert got["airfryer", january]["rating_sum"] == 19
    assert got["airfryer", february]["rating_sum"] == 25
    assert {r["review_count"] for r in got.values()} == {6}
    assert {r["succeeded"] for r in got.values()} == {6}
    assert got["coffee", february]["negative_reviews"] == 4
    # one review is positive and negative
    assert got["coffee", february]["positive_reviews"] == 3


def test_two_quotes_of_one_issue_count_once(catalog):
    got = rows(catalog.rollup, "product_id", "month_idx", "aspect", "detail")
    leak = got["coffee", parse_month("2025-02"), *LEAK[:2]]
    assert (leak["mentions"], leak["negative"]) == (3, 3)


def test_mentions_are_not_the_sum_of_polarities(spark, catalog):
    both = spark.createDataFrame(
        [("fixture-run", "coffee-2025-01-01", "x", "a", "b", p, "q") for p in ("positive", "negative")],
        catalog.labels.schema)
    issues = facts.issue_facts(facts.analysed_labels(catalog.scoped, catalog.results, both))
    row = facts.issue_rollup(issues).first()
    assert (row["mentions"], row["positive"], row["negative"]) == (1, 1, 1)


def test_insight_report(catalog):
    report = insights.insight_report(
        catalog.products, catalog.months, catalog.rollup, catalog.label_rows)
    over = rows(report.overview, "product_id")["coffee",]
    assert (over["review_count"], over["succeeded"], over["analysis_status"]) == (12, 12, "complete")
    assert over["average_rating"] == 41 / 12
    assert (over["positive_share"], over["negative_share"]) == (8 / 12, 5 / 12)
    ratings = {r["rating"]: r["review_count"] for r in report.ratings.filter("product_id = 'airfryer'").collect()}
    assert ratings == {1: 0, 2: 3, 3: 2, 4: 3, 5: 4}
    first = rows(report.complaints, "product_id", "rank")["coffee", 1]
    assert (first["aspect"], first["detail"], first["negative_count"]) == (*LEAK[:2], 4)
    assert first["negative_rate"] == 4 / 12
    examples = [r for r in report.examples.orderBy("rank").collect()
                if r["product_id"] == "coffee" and r["detail"] == "carafe leak"]
    assert [r["review_id"][-5:] for r in examples] == ["02-03", "02-02", "02-01"]
    assert examples[2]["evidence"] == "quote 1"
    change = rows(report.latest_changes, "product_id", "rank")["coffee", 1]
    assert change["change_pp"] == pytest.approx(100 / 3)
    assert {r["signal_status"] for r in report.latest_pair.collect()} == {"insufficient_sample"}


def test_comparison(catalog):
    pairs = compare.chosen_pair(catalog.products, "2025-01", "2025-02")
    covered = compare.coverage(pairs, catalog.months)
    issues = rows(compare.issues(covered, catalog.rollup), "product_id", "aspect", "detail", "polarity")
    leak = issues["coffee", *LEAK]
    assert (leak["baseline_count"], leak["target_count"]) == (1, 3)
    assert (leak["baseline_rate"], leak["target_rate"]) == (1 / 6, 3 / 6)
    assert leak["change_pp"] == pytest.approx(100 / 3) and leak["meets_threshold"] is False
    odor = issues["coffee", "material", "plastic odor", "negative"]
    assert (odor["baseline_rate"], odor["target_count"]) == (0.0, 1)
    assert odor["change_pp"] == pytest.approx(100 / 6)
    evidence = compare.evidence_rows(pairs, facts.issue_evidence(catalog.issue_facts))
    ids = evidence.filter("product_id = 'coffee' and detail = 'carafe leak'").select("review_id")
    assert ids.count() == 4
    first = rows(compare.first_evidence(
        compare.issues(covered, catalog.rollup), facts.issue_evidence(catalog.issue_facts), 2
    ), "product_id", "detail", "polarity")
    assert first["coffee", "carafe leak", "negative"]["evidence_review_ids"] == [
        "coffee-2025-01-03", "coffee-2025-02-01"]


def test_signal_with_lower_minimum(catalog):
    pairs = compare.chosen_pair(catalog.products, "2025-01", "2025-02")
    covered = compare.coverage(pairs, catalog.months)
    issues = compare.issues(covered, catalog.rollup, min_review_count=6, min_negative_count=3)
    got = {r["product_id"]: r["signal_status"]
           for r in compare.signals(covered, issues, min_review_count=6).collect()}
    assert got == {"coffee": "increase_signal", "airfryer": "no_increase_signal"}


def test_month_without_reviews(catalog):
    pairs = compare.chosen_pair(catalog.products, "2025-02", "2025-05")
    covered = compare.coverage(pairs, catalog.months)
    issues = compare.issues(covered, catalog.rollup)
    assert issues.count() == 0
    row = compare.signals(covered, issues).first()
    assert (row["status"], row["signal_status"], row["target_total"]) == (
        "insufficient_data", "insufficient_data", 0)
    assert row["target_average_rating"] is None and row["is_provisional"]


def test_reversed_months_are_rejected(catalog):
    with pytest.raises(ValueError):
        compare.chosen_pair(catalog.products, "2025-02", "2025-02")


def test_no_run_means_not_started(catalog):
    products = catalog.products.withColumn("run_id", F.lit(None).cast("string"))
    scoped = facts.scoped_reviews(catalog.reviews, products)
    months = facts.month_rollup(facts.review_facts(scoped, catalog.results, catalog.labels))
    over = insights.overview(products, months).first()
    assert (over["analysis_status"], over["analysis_total"], over["succeeded"]) == ("not_started", 12, 0)
    assert over["positive_share"] is None
    covered = compare.coverage(compare.latest_pair(months), months)
    assert {r["analysis_status"] for r in covered.collect()} == {"not_started"}
    assert {r["status"] for r in covered.collect()} == {"insufficient_data"}


def test_run_reviews_give_the_same_rollup(catalog):
    scoped = facts.run_reviews(catalog.reviews, "fixture-run")
    months = facts.month_rollup(facts.review_facts(scoped, catalog.results, catalog.labels))
    same = facts.for_products(months, catalog.products).select(*catalog.months.columns)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, catalog.months.collect()))
    none = catalog.products.filter("product_id = 'coffee'").withColumn("run_id", F.lit(None).cast("string"))
    left = facts.for_products(months, none).collect()
    assert {(r["product_id"], r["review_count"], r["succeeded"], r["scope_total"]) for r in left} == {
        ("coffee", 6, 0, 6)}


def test_sample_restricts_coverage_but_not_totals(spark, catalog):
    from tidemark.operators.sampling import month_sample

    sizes = catalog.products.select("product_id", F.lit(6).alias("sample_size"))
    sample = month_sample(catalog.reviews, sizes)
    scoped = facts.scoped_reviews(
        catalog.reviews, catalog.products.join(sizes, "product_id"), sample)
    months = facts.month_rollup(facts.review_facts(scoped, catalog.results, catalog.labels))
    assert {(r["review_count"], r["scope_total"], r["succeeded"], r["succeeded_all"])
            for r in months.collect()} == {(6, 3, 3, 6)}
    again = facts.run_reviews(catalog.reviews, "fixture-run", sample)
    same = facts.month_rollup(facts.review_facts(again, catalog.results, catalog.labels))
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, months.collect()))


def test_review_filter_holds_on_one_label(catalog):
    active = catalog.labels.filter("run_id = 'fixture-run'")
    coffee = catalog.reviews.filter("product_id = 'coffee'")
    found = listings.filter_reviews(coffee, "2025-02", active, "reliability", "negative")
    assert found.count() == 3
    # the review has a negative and a temperature label, but no negative temperature label
    none = listings.filter_reviews(coffee, "2025-02", active, "temperature", "negative")
    assert none.count() == 0


def test_review_details(catalog):
    active = catalog.labels.filter("run_id = 'fixture-run'")
    results = catalog.results.filter("run_id = 'fixture-run'")
    found = listings.filter_reviews(catalog.reviews.filter("product_id = 'airfryer'"), "2025-01", active)
    got = rows(listings.with_review_details(found, results, active), "review_id")
    mixed = got["airfryer-2025-01-03",]
    assert mixed["analysis_status"] == "succeeded"
    assert [l["aspect"] for l in mixed["labels"]] == ["cooking", NOISE[0]]
    bare = listings.with_review_details(found, results.limit(0), active.limit(0)).first()
    assert (bare["analysis_status"], bare["labels"]) == ("not_started", [])


def test_cards_and_detail(spark, catalog):
    products = catalog.products.withColumns({
        "title": F.upper("product_id"), "parent_asin": F.lit("X"), "image_url": F.lit(None).cast("string"),
        "metadata_json": F.lit('{"title_ko": "커피"}')})
    card = rows(listings.cards(products, catalog.months), "product_id")["coffee",]
    assert card["available_months"] == ["2025-01", "2025-02"]
    assert (card["analyzed_review_count"], card["analysis_status"]) == (12, "complete")
    detail = rows(listings.product_detail(products, catalog.months), "product_id")["airfryer",]
    assert [m["average_rating"] for m in detail["monthly_stats"]] == [19 / 6, 25 / 6]
    page = listings.card_page(listings.cards(products, catalog.months), 2, 1)
    assert [r["title"] for r in page.collect()] == ["COFFEE"]
    found = listings.filter_products(products, " 커 ", source_mode="fixture")
    assert found.count() == 2
    assert listings.filter_products(products, "nothing", source_mode="fixture").count() == 0


def test_taxonomy_names_are_null_for_unknown_codes(spark, catalog):
    names = spark.createDataFrame([("Kitchen", *LEAK[:2], "R", "L")],
                                  "category string, aspect string, detail string, aspect_name string, detail_name string")
    aspects = insights.aspects(insights.overview(catalog.products, catalog.months), catalog.rollup)
    named = insights.with_names(aspects.withColumn("category", F.lit("Kitchen")), names)
    got = {r["detail"]: r["detail_name"] for r in named.collect()}
    assert got["carafe leak"] == "L" and got["fan noise"] is None
