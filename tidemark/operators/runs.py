"""Reports on labelling runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rates import rounded
from tidemark.operators.statistics import nearest_rank_percentiles


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("run_id", "status").agg(F.count(F.lit(1)).alias("n"))


def error_counts(results: DataFrame) -> DataFrame:
    """Failed attempts by error type, over whole attempt histories."""
    return (
        results.select("run_id", F.explode("error_history").alias("e"))
        .groupBy("run_id", F.col("e.type").alias("error_type"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def run_report(results: DataFrame, total_reviews: int | F.Column) -> DataFrame:
    """Durations, input sizes and the estimated hours of a full run, per run.

    Mean, median and percentiles are over succeeded reviews; extremes over all with
    a duration. ``total_reviews`` is the size of the full run.
    """
    total = F.lit(total_reviews) if isinstance(total_reviews, int) else total_reviews
    done = (F.col("status") == "succeeded") & F.col("duration_ms").isNotNull()
    taken = results.select(
        "run_id", "duration_ms", "input_chars", F.when(done, F.col("duration_ms")).alias("_done_ms"))
    joined = nearest_rank_percentiles(taken, ["run_id"], "_done_ms", {"p25": 0.25, "p95": 0.95}, [
        F.count(F.lit(1)).alias("result_records"),
        F.avg("_done_ms").alias("mean"),
        F.min("duration_ms").alias("duration_min"),
        F.max("duration_ms").alias("duration_max"),
        rounded(F.avg("input_chars"), 1).alias("input_chars_mean"),
        F.min("input_chars").alias("input_chars_min"),
        F.max("input_chars").alias("input_chars_max"),
    ])

    def hours(value: F.Column) -> F.Column:
        return rounded(value * total / 3_600_000, 2)

    return joined.select(
        "run_id", "result_records", rounded(F.col("mean"), 1).alias("duration_mean"),
        rounded(F.col("median"), 1).alias("duration_median"), "duration_min", "duration_max",
        F.col("p25").cast("double").alias("duration_p25"),
        F.col("p95").cast("double").alias("duration_p95"),
        "input_chars_mean", "input_chars_min", "input_chars_max",
        hours(F.col("mean")).alias("estimate_hours_mean"),
        hours(F.col("p25")).alias("estimate_hours_p25"),
        hours(F.col("p95")).alias("estimate_hours_p95"),
    )


def run_status(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Status of each run: completed, partial_failure or in_progress."""
    counts = results.groupBy("run_id").agg(
        F.count_if(F.col("status") == "succeeded").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
    zero = F.lit(0).cast("bigint")
    joined = runs.join(counts, "run_id", "left").withColumns({
        "succeeded": F.coalesce("succeeded", zero), "failed": F.coalesce("failed", zero),
    })
    target = F.col("target_review_count")
    status = (
        F.when((target > 0) & (F.col("succeeded") == target), "completed")
        .when((target > 0) & (F.col("succeeded") + F.col("failed") == target), "partial_failure")
        .otherwise("in_progress")
    )
    return joined.withColumn("status", status)


def repaired_attempts(results: DataFrame) -> DataFrame:
    """Attempt counts never below what the error history proves."""
    proven = F.coalesce(F.size("error_history"), F.lit(0)) + F.when(
        F.col("status") == "succeeded", 1
    ).otherwise(0)
    return results.withColumn("attempt_count", F.greatest("attempt_count", proven))


def version_mismatches(runs: DataFrame, expected: DataFrame) -> DataFrame:
    """Runs whose model, prompt, schema or source differs from what is expected."""
    fields = ["model", "prompt_version", "label_schema_version", "source_mode"]
    wanted = expected.select("run_id", *[F.col(c).alias(f"expected_{c}") for c in fields])
    differs = F.lit(False)
    for c in fields:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"expected_{c}"))
    return runs.join(wanted, "run_id").filter(differs)


def label_sets(labels: DataFrame) -> DataFrame:
    """A review's labels in a run as one sorted array (a review has a handful)."""
    entry = F.struct("aspect", "detail", "polarity", "evidence")
    return labels.groupBy("run_id", "review_id").agg(
        F.array_sort(F.collect_list(entry)).alias("labels")
    )


def compare_runs(
    sample: DataFrame, results: DataFrame, labels: DataFrame, baseline: str, improved: str
) -> DataFrame:
    """Two runs side by side for each sample review.

    One pass per table: rows of both runs meet under the review and are told apart
    by run, instead of joining each table twice.
    """
    runs = [baseline, improved]
    chosen = results.filter(F.col("run_id").isin(*runs))
    sets = label_sets(labels.filter(F.col("run_id").isin(*runs)))
    both = chosen.select("review_id", "run_id", "status", "duration_ms").join(
        sets, ["review_id", "run_id"], "full_outer"
    )
    names = {"baseline": baseline, "improved": improved}
    wide = both.groupBy("review_id").agg(*[

        F.first(F.when(F.col("run_id") == run, F.col(c)), ignorenulls=True).alias(f"{side}_{c}")
        for side, run in names.items() for c in ("status", "duration_ms", "labels")
    ])
    kind = sets.schema["labels"].dataType
    none = F.array().cast(kind)
    joined = sample.join(wide, "review_id", "left").withColumns({
        "baseline_status": F.coalesce("baseline_status", F.lit("not_run")),
        "improved_status": F.coalesce("improved_status", F.lit("not_run")),
        "baseline_labels": F.coalesce("baseline_labels", none),
        "improved_labels": F.coalesce("improved_labels", none),
    })
    return joined.withColumn(
        "labels_changed", F.col("baseline_labels") != F.col("improved_labels")
    )


def comparison_summary(rows: DataFrame) -> DataFrame:
    """Counts and mean durations over the subsets of a run comparison."""
    base, new = F.col("baseline_status"), F.col("improved_status")

    def mean(test: F.Column, value: str) -> F.Column:
        return rounded(F.avg(F.when(test, F.col(value))), 1)

    return rows.agg(
        F.count(F.lit(1)).alias("sample_size"),
        F.count_if(base == "succeeded").alias("baseline_succeeded"),
        F.count_if(base == "failed").alias("baseline_failed"),
        F.count_if(new == "succeeded").alias("improved_succeeded"),
        F.count_if(new != "succeeded").alias("improved_failed_or_incomplete"),
        mean(base.isin("succeeded", "failed"), "baseline_duration_ms").alias(
            "baseline_mean_duration_final"
        ),
        mean(base == "succeeded", "baseline_duration_ms").alias(
            "baseline_mean_duration_succeeded"
        ),
        mean(new == "succeeded", "improved_duration_ms").alias("improved_mean_duration"),
        F.count_if((new == "succeeded") & F.col("labels_changed")).alias("changed_count"),
    )


def translation_totals(reviews: DataFrame) -> DataFrame:
    return reviews.agg(
        F.count(F.lit(1)).alias("reviews"), F.count("text_ko").alias("translated")
    )
