"""Human evaluation sets: progress, completeness, predictions, export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.months import month_key
from tidemark.functions.text import is_filled


def progress(evaluations: DataFrame) -> DataFrame:
    """Totals, the next pending position and independence of each dataset."""
    pending = F.col("status") == "pending"
    dependent = (F.col("split") != "independent_evaluation") | F.col("prompt_tuning_used")
    return evaluations.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(pending).alias("pending"),
        F.min(F.when(pending, F.col("position"))).alias("next_pending_position"),
        (~F.bool_or(dependent)).alias("independent_evaluation"),
    )


def completeness_problems(evaluations: DataFrame) -> DataFrame:
    """Rows that break the rules of a saved evaluation, with the first broken rule."""
    has_labels = F.coalesce(F.size("gold_labels") > 0, F.lit(False))
    done = F.col("status") == "completed"
    problem = (
        F.when(F.col("is_normal_empty") & has_labels, "empty_and_labelled")
        .when(done & ~is_filled(F.col("reviewer")), "no_reviewer")
        .when(done & ~F.col("is_normal_empty") & ~has_labels, "no_labels")
    )
    return evaluations.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def latest_predictions(results: DataFrame, labels: DataFrame) -> DataFrame:
    """The most recently updated result of each review and that run's labels."""
    newest = results.groupBy("review_id").agg(
        F.max_by(F.struct("run_id", "status", "last_error"), F.struct("updated_at", "run_id"))
        .alias("_r")
    ).select("review_id", "_r.*")
    entry = F.struct("aspect", "detail", "polarity", "evidence")
    sets = labels.groupBy("review_id", "run_id").agg(
        F.array_sort(F.collect_list(entry)).alias("labels")
    )
    return newest.join(sets, ["review_id", "run_id"], "left")


def revealed_predictions(evaluations: DataFrame, predictions: DataFrame) -> DataFrame:
    """Evaluation rows with predictions, shown only once the row is completed."""
    fields = [c for c in predictions.columns if c != "review_id"]
    renamed = predictions.select(
        "review_id", F.struct(*fields).alias("prediction")
    )
    done = F.col("status") == "completed"
    return evaluations.join(renamed, "review_id", "left").withColumns({
        "prediction_revealed": done,
        "prediction": F.when(done, F.col("prediction")),
        "prediction_status": F.when(done, F.coalesce("prediction.status", F.lit("not_run"))),
    })


def sample_id(position: F.Column, prefix: str) -> F.Column:
    """The prefix and the position with three digits at least; longer positions keep all of theirs."""
    digits = position.cast("string")
    return F.concat(F.lit(f"{prefix}-"), F.lpad(digits, F.greatest(F.char_length(digits), F.lit(3)), F.lit("0"))).alias("sample_id")


def sample_row(position: F.Column, prefix: str) -> list[F.Column]:
    """The columns every evaluation sheet shares."""
    empty = F.lit("")
    return [
        sample_id(position, prefix),
        F.col("product_id"), F.col("parent_asin"),
        F.coalesce("product_name_ko", empty).alias("product_name_ko"), F.col("category"),
        F.col("review_id"), month_key(F.col("reviewed_at")).alias("month"), F.col("rating"),
        F.coalesce("title", empty).alias("title_en"), F.col("text").alias("text_en"),
        F.coalesce("title_ko", empty).alias("title_ko_reference"),
        F.coalesce("text_ko", empty).alias("text_ko_reference"),
        F.when(is_filled(F.col("text_ko")), "자동 번역 참고용").otherwise("번역 없음")
        .alias("translation_notice"),
    ]


def export_rows(evaluations: DataFrame, reviews: DataFrame, products: DataFrame) -> DataFrame:
    """Flat rows of an evaluation set for a CSV file, in position order."""
    joined = evaluations.join(reviews, "review_id").join(products, "product_id")
    return joined.orderBy("position").select(
        *sample_row(F.col("position"), "evaluation"),
        F.to_json("gold_labels").alias("gold_labels_json"),
        F.coalesce("notes", F.lit("")).alias("ambiguity_or_error_notes"),
        F.coalesce("reviewer", F.lit("")).alias("reviewer"),
        F.col("status").alias("review_status"),
    )


def trial_rows(
    sample: DataFrame, reviews: DataFrame, products: DataFrame, results: DataFrame, labels: DataFrame,
    run_id: str,
) -> DataFrame:
    """Predictions of one run for a listed sample, flat for a CSV file.

    ``sample`` has ``position, review_id``; ``results`` and ``labels`` may hold other
    runs. A review without a result shows as ``not_run``.
    """
    entry = F.struct(
        F.col("aspect").alias("aspect_code"), F.col("detail").alias("detail_code"), "polarity",
        F.col("evidence").alias("evidence_span"),
    )
    predicted = labels.filter(F.col("run_id") == run_id).groupBy("review_id").agg(
        F.array_sort(F.collect_list(entry)).alias("predicted")
    )
    done = results.filter(F.col("run_id") == run_id).select(
        "review_id", "status", "attempt_count", "duration_ms", "input_chars", "error_history"
    )
    empty = F.lit("")
    joined = (
        sample.join(reviews, "review_id").join(products, "product_id")
        .join(done, "review_id", "left").join(predicted, "review_id", "left")
    )
    return joined.orderBy("position").select(
        sample_id(F.col("position"), "trial"),
        "product_id", F.coalesce("product_name_ko", empty).alias("product_name_ko"), "category",
        "review_id", month_key(F.col("reviewed_at")).alias("month"),
        F.col("rating").alias("rating_reference_only"),
        F.coalesce("title", empty).alias("title_en"), F.col("text").alias("text_en"),
        F.coalesce("status", F.lit("not_run")).alias("status"),
        F.coalesce("attempt_count", F.lit(0)).alias("attempt_count"), "duration_ms",
        F.coalesce("input_chars", F.char_length("text")).alias("input_chars"),
        F.coalesce(F.to_json("error_history"), F.lit("[]")).alias("error_history_json"),
        F.coalesce(F.to_json("predicted"), F.lit("[]")).alias("predicted_labels_json"),
        F.lit(run_id).alias("analysis_version"),
    )


# The columns people fill in on each kind of sheet, with defaults.
BLIND_COLUMNS = {
    "gold_labels_json": "", "ambiguity_or_error_notes": "", "reviewer": "",
    "review_status": "pending",
}
PREDICTION_COLUMNS = {
    "prediction_status": "not_run", "analysis_version": "", "predicted_labels_json": "",
    "model_error": "", "gold_labels_json": "", "comparison_notes": "",
}
HARD_CASE_COLUMNS = {
    "check_negation": "", "check_mixed_sentiment": "", "check_rating_text_conflict": "",
    "check_shipping_vs_product": "", "review_notes": "",
}


def sheet(rows: DataFrame, prefix: str, to_fill: dict[str, str]) -> DataFrame:
    """An evaluation sheet: review columns and the columns to fill in.

    ``rows`` has ``position`` and the review and product columns of
    :func:`sample_row`.
    """
    filled = [F.lit(value).alias(name) for name, value in to_fill.items()]
    return rows.orderBy("position").select(*sample_row(F.col("position"), prefix), *filled)
