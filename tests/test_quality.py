from __future__ import annotations

import json
from datetime import datetime
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidemark.operators import answers, evaluation, quality, runs
from tidemark.operators.facts import month_rollup, review_facts

TEXT = "The pump leaks badly. It doesn’t   work at all, but the Seller was kind."


@pytest.fixture(scope="module")
def codes(spark):
    taxonomy = spark.createDataFrame(
        [("c", "performance", "reliability"), ("c", "service", "seller_service")],
        "category string, aspect string, detail string")
    return quality.taxonomy_codes(taxonomy)


def label(code="performance.reliability", sentiment="negative", evidence="pump leaks"):
    return {"code": code, "sentiment": sentiment, "evidence": evidence}


OLD = {"aspect_code": " service ", "detail_code": "seller_service", "polarity": "positive",
       "evidence_span": "seller WAS kind"}
CASES = [
    (json.dumps({"labels": [label(), OLD, label()]}), None,
     [("performance", "reliability", "negative", "pump leaks"),
      ("service", "seller_service", "positive", "Seller was kind")]),
    (json.dumps({"labels": []}), None, []),
    (json.dumps({"labels": [label(evidence="it doesn't work")]}), None,
     [("performance", "reliability", "negative", "It doesn’t   work")]),
    ("{not json", "response_format_error", None),
    (json.dumps({"labels": {"code": "x"}}), "response_format_error", None),
    (json.dumps({"other": 1}), "response_format_error", None),
    (json.dumps({"labels": [label(), "text"]}), "response_format_error", None),
    (json.dumps({"labels": [label("performance")]}), "taxonomy_validation_error", None),
    (json.dumps({"labels": [label("performance.shipping")]}), "taxonomy_validation_error", None),
    (json.dumps({"labels": [label(sentiment="angry")]}), "taxonomy_validation_error", None),
    (json.dumps({"labels": [label(evidence="ump leaks")]}), "evidence_validation_error", None),
    (json.dumps({"labels": [label(evidence="leaks")]}), "evidence_validation_error", None),
    (json.dumps({"labels": [label(evidence="")]}), "evidence_validation_error", None),
    # the first problem by position decides
    (json.dumps({"labels": [label(evidence="nowhere found"), label("bad.code")]}), "evidence_validation_error", None),
]


def test_label_documents(spark, codes):
    docs = spark.createDataFrame([(i, "c", None, TEXT, c) for i, (c, _, _) in enumerate(CASES)],
                                 "doc_id int, category string, title string, text string, content string")
    got = {r["doc_id"]: r for r in quality.validate_label_documents(docs, codes).collect()}
    for i, (content, problem, labels) in enumerate(CASES):
        assert got[i]["problem"] == problem, content
        mine = got[i]["labels"]
        assert (None if mine is None else [tuple(x) for x in mine]) == labels, content


def test_gold_labels_may_quote_one_word(spark, codes):
    docs = spark.createDataFrame(
        [(1, "c", "t", TEXT, json.dumps({"labels": [label(evidence="leaks")]}))],
        "doc_id int, category string, title string, text string, content string")
    assert quality.validate_label_documents(docs, codes, min_words=1).first()["problem"] is None


def test_translations(spark):
    rows = spark.createDataFrame([
        (1, "Charger", "20W, lasts 1,200 hours", "충전기", "20W 1200시간"), (2, None, "20W", "충전기", "빠름"),
        (3, "12 roll", "2 weeks 5 stars", "12롤", "2주 별 5개"), (4, "a", "b", " ", "c"),
    ], "review_id int, title string, text string, title_ko string, text_ko string")
    got = {r["review_id"]: (r["problem"], r["missing"]) for r in quality.translation_problems(rows).collect()}
    assert got == {1: (None, []), 2: ("missing_numbers", ["20"]), 3: (None, []), 4: ("blank_translation", [])}


def test_pending_translations_newest_first(spark):
    reviews = spark.createDataFrame(
        [("p1", "a", datetime(2024, 1, 1), True, None), ("p1", "b", datetime(2024, 1, 2), True, None),
         ("p1", "c", datetime(2024, 1, 3), True, "x"), ("p2", "d", datetime(2024, 1, 3), True, None)],
        "product_id string, review_id string, reviewed_at timestamp, eligible boolean, text_ko string")
    products = spark.createDataFrame([("p1", "A"), ("p2", "B")], "product_id string, category string")
    got = [r["review_id"] for r in quality.pending_translations(reviews, products).collect()]
    assert got == ["b", "a", "d"]
    assert [r["review_id"] for r in quality.pending_translations(reviews, products, "A", limit=1).collect()] == ["b"]
    assert runs.translation_totals(reviews).first()["translated"] == 1


def test_attempts_fold(spark):
    rows = [("r", "ok", "h", 1, 1, "failed", "e1", 5), ("r", "ok", "h", 1, 2, "succeeded", None, 7),
            ("r", "bad", "h", 1, 1, "failed", "e1", 5), ("r", "bad", "h", 1, 2, "failed", "e2", 5),
            ("r", "retrying", "h", 1, 1, "failed", "e1", 5), ("r", "retrying", "h", 1, 2, "failed", "e1", 5),
            ("r", "retrying", "h", 2, 3, "failed", "e1", 5),
            ("r", "changed", "h1", 1, 1, "succeeded", None, 5), ("r", "changed", "h2", 1, 2, "failed", "e", 3),
            ("r", "back", "h1", 1, 1, "succeeded", None, 5), ("r", "back", "h2", 1, 2, "failed", "e", 3),
            ("r", "back", "h1", 2, 3, "failed", "e3", 4)]
    log = spark.createDataFrame(rows, "run_id string, review_id string, input_hash string, invocation int, "
                                      "at int, outcome string, error_type string, duration_ms bigint")
    got = {r["review_id"]: (r["status"], r["attempt_count"], r["duration_ms"], r["last_error_type"], len(r["error_history"]))
           for r in quality.fold_attempts(log, 2).collect()}
    assert got == {"ok": ("succeeded", 2, 12, None, 1), "bad": ("failed", 2, 10, "e2", 2),
                   "retrying": ("pending", 3, 15, "e1", 3), "changed": ("pending", 1, 3, "e", 1),
                   "back": ("pending", 1, 4, "e3", 1)}


def test_run_report_and_status(spark):
    schema = ("run_id string, review_id string, status string, duration_ms bigint, input_chars int, "
              "error_history array<struct<type: string>>, attempt_count int")
    results = spark.createDataFrame(
        [("r", "1", "succeeded", 100, 10, [("e1",)], 1), ("r", "2", "succeeded", 300, 20, [], 1),
         ("r", "3", "failed", 900, 30, [("e1",), ("e2",)], 0), ("r", "4", "succeeded", None, 30, None, 1)], schema)
    row = runs.run_report(results, 3600).first()
    assert (row["duration_mean"], row["duration_median"], row["duration_min"], row["duration_max"]) == (200, 200, 100, 900)
    assert (row["duration_p25"], row["duration_p95"], row["input_chars_mean"]) == (100.0, 300.0, 22.5)
    assert row["estimate_hours_mean"] == 0.2
    assert {(r["error_type"], r["n"]) for r in runs.error_counts(results).collect()} == {("e1", 2), ("e2", 1)}
    assert {(r["status"], r["n"]) for r in runs.status_counts(results).collect()} == {("succeeded", 3), ("failed", 1)}
    assert {r["review_id"]: r["attempt_count"] for r in runs.repaired_attempts(results).collect()} == {
        "1": 2, "2": 1, "3": 2, "4": 1}
    targets = spark.createDataFrame([("r", 4), ("none", 0)], "run_id string, target_review_count int")
    assert {r["run_id"]: r["status"] for r in runs.run_status(targets, results).collect()} == {
        "r": "partial_failure", "none": "in_progress"}


def test_version_mismatch(spark):
    schema = "run_id string, model string, prompt_version string, label_schema_version string, source_mode string"
    have = spark.createDataFrame([("a", "m", "p", "s", "real"), ("b", "m", "p", "s", "real")], schema)
    want = spark.createDataFrame([("a", "m", "p", "s", "real"), ("b", "m", "p2", "s", "real")], schema)
    assert [r["run_id"] for r in runs.version_mismatches(have, want).collect()] == ["b"]


def test_run_comparison(spark):
    results = spark.createDataFrame(
        [("a", "1", "succeeded", 100), ("b", "1", "succeeded", 50), ("a", "2", "failed", 300), ("b", "2", "succeeded", 70),
         ("c", "3", "succeeded", 1)], "run_id string, review_id string, status string, duration_ms bigint")
    labels = spark.createDataFrame(
        [("a", "1", "x", "y", "positive", "q"), ("b", "1", "x", "y", "positive", "q"), ("b", "2", "x", "y", "negative", "q"),
         ("c", "3", "x", "y", "negative", "q")],
        "run_id string, review_id string, aspect string, detail string, polarity string, evidence string")
    sample = spark.createDataFrame([("1",), ("2",), ("3",)], "review_id string")
    rows = runs.compare_runs(sample, results, labels, "a", "b")
    got = {r["review_id"]: (r["baseline_status"], r["improved_status"], r["labels_changed"]) for r in rows.collect()}
    assert got == {"1": ("succeeded", "succeeded", False), "2": ("failed", "succeeded", True),
                   "3": ("not_run", "not_run", False)}
    summary = runs.comparison_summary(rows).first()
    assert (summary["baseline_mean_duration_final"], summary["baseline_mean_duration_succeeded"]) == (200.0, 100.0)
    assert (summary["improved_mean_duration"], summary["changed_count"]) == (60.0, 1)


# --- answers


def audit(spark, answer, previous=None, sources=2, topic=1, allowed=(50.0, 25.0)):
    rows = spark.createDataFrame(
        [(answer, sources, topic, list(allowed), previous)],
        "answer string, source_count int, topic_sources int, allowed array<double>, previous string")
    return answers.audit_answers(rows).first()


@pytest.mark.parametrize("answer, options, problems", [
    ("Half like it, 50%. [1]", {}, []), ("About 33 % [1]", {"allowed": (33.3,)}, []),
    ("About 34% [1]", {"allowed": (33.3,)}, ["unknown_percent"]), ("30퍼센트 [1]", {"allowed": ()}, ["unknown_percent"]),
    ("Fine [3]", {}, ["unknown_citation"]), ("Fine", {}, ["no_citation"]), ("Fine", {"topic": 0}, []),
    ("See facts [1]", {}, ["internal_term"]),
])
def test_answer_audit(spark, answer, options, problems):
    assert audit(spark, answer, **options)["problems"] == problems


def test_citations_that_exist_are_kept(spark):
    assert audit(spark, "a [2] b [9] c [2] d [1]")["citations"] == [2, 1]


def test_near_repeats_compare_the_remembered_start(spark):
    old = "The pump leaks after some weeks. " * 12
    same, other = old + "And more.", "Buyers mostly praise the quiet fan. [1] " * 9
    for new in (same, other):
        kept = old[:200]
        head = " ".join(new.split())[: len(kept)]
        want = SequenceMatcher(None, head, kept).ratio() >= 0.85
        assert ("repeats_previous" in audit(spark, new + " [1]", old)["problems"]) == want
    assert "repeats_previous" in audit(spark, same, old)["problems"]


def test_cited_ids(spark):
    rows = spark.createDataFrame([(["a", "b", "b"], ["a"])], "cited_review_ids array<string>, retrieved_review_ids array<string>")
    assert answers.audit_cited_reviews(rows).first()["unknown_ids"] == ["b"]


@pytest.mark.parametrize("succeeded, values", [(40, [50.0, 25.0, 20.0, 5.0]), (12, [])])
def test_quotable_percents(spark, succeeded, values):
    rows = spark.createDataFrame(
        [(succeeded, 0.5, 0.25, [(9, 8, 2), (0, 0, 0)])],
        "s bigint, p double, n double, t array<struct<mention_count: bigint, negative_count: bigint, positive_count: bigint>>")
    got = rows.select(answers.quotable_percents(F.col("s"), F.col("p"), F.col("n"), F.col("t"))).first()[0]
    assert got == values
    more = rows.select(answers.quotable_percents(
        F.col("s"), F.col("p"), F.col("n"), F.col("t"), F.expr("array(0.125D, null, 0.3D)"),
        F.expr("array(named_struct('baseline_rate', 0.1D, 'target_rate', 0.4333D, 'change_pp', 33.33D),"
               " named_struct('baseline_rate', cast(null as double), 'target_rate', 0.5D, 'change_pp', 1D))"))).first()[0]
    assert more == (values + [12.5, 30.0, 10.0, 43.3, 33.3] if values else [])


@pytest.mark.parametrize("stored, now, stale", [
    (("v", 10), ("v", 12), False), (("v", 10), ("v", 13), True), (("v", 100), ("v", 105), False),
    (("v", 100), ("v", 94), True), (("v", 10), ("w", 10), True),
])
def test_staleness(spark, stored, now, stale):
    columns = [F.lit(stored[0]), F.lit(stored[1]), F.lit(now[0]), F.lit(now[1])]
    assert spark.range(1).select(answers.is_stale(*columns)).first()[0] is stale


def test_faq_list(spark):
    snapshot = spark.createDataFrame([("p", "run", 40)], "product_id string, current_version string, current_count bigint")
    rows = spark.createDataFrame(
        [("p", "is it good", "v1", "old", "run", 40, datetime(2025, 1, 1)), ("p", "is it good", "v2", "new", "run", 39, datetime(2025, 2, 1)),
         ("p", "is it good", "v0", "unread", "run", 40, datetime(2025, 3, 1)), ("p", "does it last", "v1", "a", "run", 10, datetime(2025, 1, 1))],
        "product_id string, question_key string, prompt_version string, answer string, analysis_version string, analyzed_count bigint, created_at timestamp")
    listed = answers.faq_list(snapshot, answers.latest_answers(rows, ["v1", "v2"]),
                              [("good", "Is it good?"), ("last", "Does it last?"), ("fit", "Does it fit?")])
    got = {r["faq_key"]: (r["answer"], r["is_stale"]) for r in listed.collect()}
    assert got == {"good": ("new", False), "last": ("a", True), "fit": (None, None)}
    assert {r["faq_key"] for r in answers.faq_work(listed).collect()} == {"last", "fit"}
    assert {r["faq_key"] for r in answers.faq_work(listed, force=True, only=["good"]).collect()} == {"good"}


def test_snapshot_ignores_the_sample(catalog):
    scoped = catalog.scoped.withColumn("in_sample", F.lit(False))
    months = month_rollup(review_facts(scoped, catalog.results, catalog.labels))
    got = {r["product_id"]: r["current_count"] for r in answers.analysis_snapshot(catalog.products, months).collect()}
    assert got == {"coffee": 12, "airfryer": 12}
    none = catalog.products.withColumn("run_id", F.lit(None).cast("string"))
    assert {(r["current_version"], r["current_count"]) for r in answers.analysis_snapshot(none, months).collect()} == {("not-analyzed", 0)}


def test_digest_sources_number_each_review_once(spark):
    examples = spark.createDataFrame(
        [(1, 1, "negative", 1, "r1", "bad"), (1, 1, "negative", 2, "r9", "worse"), (1, 1, "positive", 1, "r2", "good"),
         (1, 2, "negative", 1, "r1", "bad again"), (1, 2, "positive", 1, "r3", "x" * 300)],
        "query_id int, topic_rank int, polarity string, example_rank int, review_id string, text string")
    related = spark.createDataFrame([(1, 1, "r2", "t", "a"), (1, 2, "r4", "t", "b \n c"), (1, 3, "r5", None, "c")],
                                    "query_id int, rank int, review_id string, title string, text string")
    got = answers.digest_sources(examples, related).orderBy("number").collect()
    assert [(r["number"], r["review_id"], r["label"]) for r in got] == [
        (1, "r1", "negative"), (2, "r2", "positive"), (3, "r3", "positive"), (4, "r4", "related")]
    assert got[0]["text"] == "bad" and len(got[2]["text"]) == 100 and got[3]["text"] == "t b c"


# --- evaluation


def test_evaluation_progress_and_rules(spark):
    rows = spark.createDataFrame(
        [("d", 1, "independent_evaluation", False, "completed", "me", False, ["x"]),
         ("d", 2, "independent_evaluation", False, "completed", " ", False, ["x"]),
         ("d", 3, "independent_evaluation", False, "completed", "me", False, []),
         ("d", 4, "independent_evaluation", False, "pending", None, True, ["x"]),
         ("d", 5, "independent_evaluation", False, "pending", None, False, [])],
        "dataset_id string, position int, split string, prompt_tuning_used boolean, status string, "
        "reviewer string, is_normal_empty boolean, gold_labels array<string>")
    assert tuple(evaluation.progress(rows).first()) == ("d", 5, 3, 2, 4, True)
    used = rows.withColumn("prompt_tuning_used", F.col("position") == 5)
    assert evaluation.progress(used).first()["independent_evaluation"] is False
    got = {r["position"]: r["problem"] for r in evaluation.completeness_problems(rows).collect()}
    assert got == {2: "no_reviewer", 3: "no_labels", 4: "empty_and_labelled"}


def test_predictions_stay_hidden_until_completed(spark):
    results = spark.createDataFrame(
        [("old", "r1", "failed", "e", datetime(2025, 1, 1)), ("new", "r1", "succeeded", None, datetime(2025, 2, 1)),
         ("new", "r2", "succeeded", None, datetime(2025, 2, 1))],
        "run_id string, review_id string, status string, last_error string, updated_at timestamp")
    labels = spark.createDataFrame(
        [("old", "r1", "a", "b", "negative", "q"), ("new", "r1", "a", "c", "positive", "q")],
        "run_id string, review_id string, aspect string, detail string, polarity string, evidence string")
    predicted = evaluation.latest_predictions(results, labels)
    rows = spark.createDataFrame([("r1", "completed"), ("r2", "pending"), ("r3", "completed")], "review_id string, status string")
    got = {r["review_id"]: r for r in evaluation.revealed_predictions(rows, predicted).collect()}
    assert [x["detail"] for x in got["r1"]["prediction"]["labels"]] == ["c"]
    assert got["r2"]["prediction"] is None and got["r2"]["prediction_status"] is None
    assert got["r3"]["prediction_status"] == "not_run"


def test_evaluation_export(spark):
    rows = spark.createDataFrame([("r1", 7, [("a", "b")], None, None, "pending")],
                                 "review_id string, position int, gold_labels array<struct<aspect_code: string, detail_code: string>>, "
                                 "notes string, reviewer string, status string")
    reviews = spark.createDataFrame([("r1", "p", 4, datetime(2025, 1, 31, 23), None, "body", None, "번역")],
                                    "review_id string, product_id string, rating int, reviewed_at timestamp, title string, text string, title_ko string, text_ko string")
    products = spark.createDataFrame([("p", "ASIN", None, "Toys")], "product_id string, parent_asin string, product_name_ko string, category string")
    row = evaluation.export_rows(rows, reviews, products).first()
    assert (row["sample_id"], row["month"], row["title_en"]) == ("evaluation-007", "2025-01", "")
    assert row["gold_labels_json"] == '[{"aspect_code":"a","detail_code":"b"}]'


def test_sample_ids_keep_all_digits(spark):
    places = spark.createDataFrame([(0,), (99,), (100,), (1000,), (123456,)], "position int")
    got = [r[0] for r in places.orderBy("position").select(evaluation.sample_id(F.col("position"), "trial")).collect()]
    assert got == ["trial-000", "trial-099", "trial-100", "trial-1000", "trial-123456"]
