from __future__ import annotations

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ingest, merge, profile
from tidemark.sources import documents, shards
from tidemark.streaming.imports import REVIEW_TABLE_SCHEMA, import_batch, start_import


def millis(year, month, day):
    return int(datetime(year, month, day, tzinfo=timezone.utc).timestamp() * 1000)


def raw(ms, user="U1", text="actual review", rating=5.0, asin="V1", parent="P1"):
    return (rating, "title", text, asin, parent, user, ms)


JANUARY = raw(millis(2021, 1, 1))
SHARDS = [
    [JANUARY, raw(millis(2021, 2, 1), "U2"), raw(millis(2021, 4, 1), "U3"),
     raw(millis(2021, 1, 7), "U4", text="  ")],
    # a copy in another file, and the same words by another user
    [JANUARY, raw(millis(2021, 1, 1), "U5"), raw(millis(2021, 1, 1), "U6", parent="P2")],
]


@pytest.fixture(scope="module")
def shard_folder(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("shards")
    for n, rows in enumerate(SHARDS):
        spark.createDataFrame(rows, shards.REVIEW_SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "reviews"))
    return str(folder / "reviews")


@pytest.fixture(scope="module")
def selection(spark):
    return spark.createDataFrame(
        [("P1", ["2021-01", "2021-02", "2021-03"])], "parent_asin string, months array<string>")


def test_import_waterfall(spark, shard_folder, selection):
    rows = ingest.classified_rows(shards.read_reviews(spark, shard_folder), selection)
    assert ingest.import_audit(rows).first().asDict() == {
        "selected_source_rows": 6, "excluded_ineligible": 1, "excluded_outside_period": 1,
        "excluded_exact_duplicate": 1, "eligible_unique_import_rows": 3}
    unique = ingest.unique_candidates(rows)
    months = {(r["parent_asin"], r["month"]): r["n"] for r in ingest.imported_months(unique).collect()}
    assert months == {("P1", "2021-01"): 2, ("P1", "2021-02"): 1}
    stored = ingest.review_rows(unique).collect()
    assert {r["product_id"] for r in stored} == {"amazon-P1"}
    assert all(len(r["review_id"]) == len("amazon-") + 40 for r in stored)
    problems = ingest.volume_problems(selection, ingest.imported_months(unique))
    assert sorted((r["month"] or "", r["problem"]) for r in problems.collect()) == [
        ("", "total_out_of_range"), ("2021-01", "month_below_minimum"),
        ("2021-02", "month_below_minimum"), ("2021-03", "month_below_minimum")]


def test_empty_audit(spark, selection):
    rows = ingest.classified_rows(spark.createDataFrame([], shards.REVIEW_SCHEMA), selection)
    assert set(ingest.import_audit(rows).first()) == {0}


def test_import_twice_adds_nothing(spark, shard_folder, selection, tmp_path):
    table = str(tmp_path / "table")
    for _ in range(2):
        import_batch(shards.read_reviews(spark, shard_folder), selection, table)
        assert merge.read_table(spark, table, REVIEW_TABLE_SCHEMA).count() == 3


def test_streaming_import_is_incremental(spark, selection, tmp_path):
    folder, table, state = (str(tmp_path / n) for n in ("in", "table", "state"))

    def arrive(rows):
        spark.createDataFrame(rows, shards.REVIEW_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        start_import(spark, folder, selection, table, state).awaitTermination(120)
        return merge.read_table(spark, table, REVIEW_TABLE_SCHEMA).count()

    assert arrive(SHARDS[0]) == 2
    assert arrive(SHARDS[1]) == 3


def test_profile_golden(spark):
    rows = [raw(millis(2023, m, 1 + i % 27), f"U{m}-{i}") for m in (1, 2, 3) for i in range(50)]
    rows += [raw(millis(2023, 4, 1)), raw(millis(2023, 3, 1), text=" ")]
    volumes = profile.shard_volumes(spark.createDataFrame(rows, shards.REVIEW_SCHEMA)).cache()
    audit = profile.audit(volumes).first()
    assert (audit["total_rows"], audit["eligible_rows"], audit["invalid_text"]) == (152, 151, 1)
    assert (audit["first_observed_month"], audit["last_observed_month"]) == ("2023-01", "2023-04")
    assert audit["eligible_product_count"] == 1
    last = volumes.agg(F.max("month_idx"))
    window = profile.best_windows(profile.candidate_months(volumes), last).collect()
    assert [(r["months"], r["review_count"], r["balance_gap"]) for r in window] == [
        (["2023-01", "2023-02", "2023-03"], 150, 0)]


def test_validity_of_each_field(spark):
    rows = [raw(0), raw(millis(2100, 12, 31)), raw(millis(2101, 1, 1)), raw(1, rating=4.5),
            raw(millis(2020, 1, 1), rating=None), raw(millis(2020, 1, 1), asin=None), raw(None)]
    volumes = profile.shard_volumes(spark.createDataFrame(rows, shards.REVIEW_SCHEMA))
    audit = profile.audit(volumes).first()
    assert (audit["invalid_timestamp"], audit["invalid_rating"], audit["invalid_asin"]) == (4, 2, 1)
    assert audit["eligible_rows"] == 1


def test_windows_prefer_center_then_balance_then_latest(spark):
    counts = {"a": [100, 130, 145, 200, 10], "b": [60, 60, 60, 60, 60], "c": [300, 300, 300, 30, 30]}
    months = spark.createDataFrame(
        [(p, 100 + i, n) for p, ns in counts.items() for i, n in enumerate(ns)],
        "parent_asin string, month_idx int, n bigint")
    last = spark.createDataFrame([(104,)], "m int")
    got = {r["parent_asin"]: (r["end_idx"], r["review_count"])
           for r in profile.best_windows(months, last).collect()}
    assert got == {"a": (102, 375), "b": (103, 180)}


def test_last_filled_title_wins(spark, tmp_path):
    def row(parent, title, store):
        return (parent, title, "c", 4.0, 5, store, None, None, None)

    path = str(tmp_path / "meta")
    for n, rows in enumerate([[row("P1", "old", "s1"), row("P2", "two", "s2")],
                              [row("P1", "new", "s3"), row("P1", " ", "s4"), row("P3", None, "s5")]]):
        spark.createDataFrame(rows, shards.METADATA_SCHEMA).coalesce(1).write.parquet(f"{path}/part-{n}")
    meta = shards.read_metadata(spark, f"{path}/part-0", f"{path}/part-1")
    got = {r["parent_asin"]: (r["title"], r["store"]) for r in shards.latest_metadata(meta).collect()}
    assert got == {"P1": ("new", "s3"), "P2": ("two", "s2")}
    wanted = spark.createDataFrame([("P1",), ("P3",)], "parent_asin string")
    found = shards.latest_metadata(meta, wanted)
    missing = shards.missing_keys(wanted, found, "parent_asin")
    assert [r[0] for r in missing.collect()] == ["P3"]
    with pytest.raises(ValueError, match="P3"):
        shards.require_empty(missing, "no metadata")


def test_selection_file(spark, tmp_path):
    good = ["2023-01", "2023-02", "2023-03"]
    products = [{"parent_asin": "P1", "months": good, "analysis_sample_size": 20},
                {"parent_asin": "P1", "months": ["2023-01", "2023-03", "2023-04"]},
                {"parent_asin": "P3", "months": ["2022-12", "2023-01", "2023-02"], "analysis_sample_size": 0}]
    path = tmp_path / "selection.json"
    path.write_text(json.dumps({"categories": {"Toys": {"products": products}}}, indent=1))
    chosen = documents.read_selection(spark, str(path))
    got = {(r["parent_asin"], r["problem"]) for r in documents.selection_problems(chosen, 3).collect()}
    assert got == {(None, "repeated_product"), ("P1", "months_not_consecutive"), ("P3", "bad_sample_size")}


def test_product_rows(spark):
    chosen = spark.createDataFrame(
        [("Toys", "P1", ["2023-01", "2023-02", "2023-03"], "20", "이름", None, None, None)],
        "category string, parent_asin string, months array<string>, analysis_sample_size string, "
        "title_ko string, title_ko_source string, description_ko string, product_type string")
    meta = spark.createDataFrame(
        [("P1", " Title ", "m", 4.5, 9, "s", None, ["a", " "], None)], shards.METADATA_SCHEMA)
    row = ingest.product_rows(chosen, meta, review_revision="r1").first()
    document = json.loads(row["metadata_json"])
    assert (row["product_id"], row["title"]) == ("amazon-P1", "Title")
    assert (document["baseline_month"], document["target_month"]) == ("2023-02", "2023-03")
    assert (document["analysis_sample_size"], document["description"], document["features"]) == (20, "a", [])


TAXONOMY = {
    "version": "v1", "polarities": ["positive", "negative"],
    "common": [{"aspect_code": "a", "aspect_name_ko": "A", "details": [
        {"detail_code": "x", "name_ko": "X", "include": "i", "exclude": "e", "example": "z"}]}],
    "categories": {"Toys": [{"aspect_code": "a", "aspect_name_ko": "A2", "details": [
        {"detail_code": "x", "name_ko": "X2", "include": "i", "exclude": "e", "example": "z"},
        {"detail_code": "y", "name_ko": "Y", "include": "i", "exclude": "e", "example": "z"}]}]},
}


def test_taxonomy(spark, tmp_path):
    path = tmp_path / "taxonomy.json"
    path.write_text(json.dumps(TAXONOMY))
    rows = documents.read_taxonomy(spark, str(path), ["Toys", "Books"]).collect()
    assert {(r["category"], r["aspect"], r["detail"], r["detail_name"]) for r in rows} == {
        ("Toys", "a", "x", "X2"), ("Toys", "a", "y", "Y"), ("Books", "a", "x", "X")}


def test_review_id_list(spark, tmp_path):
    path = tmp_path / "ids.json"
    path.write_text(json.dumps({"version": 1, "review_ids": ["r1", "r2", "r1"]}))
    ids = documents.read_review_ids(spark, str(path))
    assert [r[0] for r in documents.repeated_keys(ids).collect()] == ["r1"]


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(
        [("r1", 'said "no",\nthen left', ["a"]), ("r2", "한국어", [])],
        "review_id string, text string, labels array<string>")
    path = str(tmp_path / "sheet")
    documents.write_csv(rows, path)
    part = next(p for p in (tmp_path / "sheet").iterdir() if p.suffix == ".csv")
    assert part.read_bytes().startswith("﻿".encode())
    back = documents.read_csv(spark, path, "review_id string, text string, labels string")
    got = {r["review_id"]: (r["text"], r["labels"]) for r in back.collect()}
    assert got == {"r1": ('said "no",\nthen left', '["a"]'), "r2": ("한국어", "[]")}


def test_json_report_keeps_nulls(spark, tmp_path):
    path = str(tmp_path / "report")
    documents.write_json_report(spark.range(1).select("id", F.lit(None).cast("int").alias("x")), path)
    assert spark.read.text(path).first()[0] == '{"id":0,"x":null}'


def test_upsert_replaces_only_touched_partitions(spark, tmp_path):
    schema = "review_id bigint, content_hash string, model string"
    path = str(tmp_path / "vectors")
    keys, parts = ["model", "review_id"], ["model"]

    def put(*rows):
        merge.upsert_partitions(spark.createDataFrame(list(rows), schema), path, schema, keys, parts)
        return {(r["model"], r["review_id"]): r["content_hash"]
                for r in merge.read_table(spark, path, schema).collect()}

    put((1, "a", "m"), (2, "b", "m"), (1, "z", "n"))
    before = {p.name for p in (tmp_path / "vectors" / "model=n").iterdir()}
    want = {("m", 1): "a2", ("m", 2): "b", ("m", 3): "c", ("n", 1): "z"}
    assert put((1, "a2", "m"), (3, "c", "m")) == want
    assert put((1, "a2", "m"), (3, "c", "m")) == want
    assert {p.name for p in (tmp_path / "vectors" / "model=n").iterdir()} == before


def test_answers_keep_their_faq_kind(spark):
    schema = "product_id string, question_key string, prompt_version string, answer string, kind string, faq_key string"
    stored = spark.createDataFrame([("p", "q1", "v", "old", "faq", "k1"), ("p", "q2", "v", "old", "cache", None)], schema)
    saved = spark.createDataFrame(
        [("p", "q1", "v", "new", "cache", None, "answered"), ("p", "q2", "v", "new", "faq", "k2", "answered"),
         ("p", "q3", "v", "new", "cache", None, "answered"), ("p", "q4", "v", "new", "cache", None, "invalid"),
         ("p", "q5", "v", "", "cache", None, "answered")], schema + ", status string")
    got = {r["question_key"]: (r["answer"], r["kind"], r["faq_key"])
           for r in merge.merge_answers(stored, saved).collect()}
    assert got == {"q1": ("new", "faq", "k1"), "q2": ("new", "faq", "k2"), "q3": ("new", "cache", None)}


def test_evaluation_seed_keeps_human_input(spark):
    schema = ("dataset_id string, position int, split string, review_id string, "
              "prompt_tuning_used boolean, reviewer string, status string, is_normal_empty boolean")
    stored = spark.createDataFrame(
        [("d", 9, "development", "r1", True, "me", "completed", True),
         ("other", 1, "development", "r2", True, None, "pending", False)], schema)
    listed = spark.createDataFrame([(1, "r1"), (2, "r2")], "position int, review_id string")
    assert merge.seed_counts(stored, listed, "d").first().asDict() == {"total": 2, "inserted": 1, "preserved": 1}
    once = merge.seed_evaluations(stored, listed, "d")
    for result in (once, merge.seed_evaluations(once, listed, "d")):
        got = {(r["dataset_id"], r["review_id"]): r for r in result.collect()}
        assert len(got) == 3
        kept, new = got["d", "r1"], got["d", "r2"]
        assert (kept["position"], kept["split"], kept["prompt_tuning_used"]) == (1, "independent_evaluation", False)
        assert (kept["reviewer"], kept["status"], kept["is_normal_empty"]) == ("me", "completed", True)
        assert (new["position"], new["status"], new["reviewer"], new["is_normal_empty"]) == (2, "pending", None, False)
        assert got["other", "r2"]["split"] == "development"
