"""Selecting, de-duplicating and shaping raw reviews for import."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import defaults as D
from tidemark.functions import hashing
from tidemark.functions.months import index_of_key, key_of_index, month_index
from tidemark.functions.products import description_text, first_image, validity
from tidemark.functions.text import strip, strip_to_null


def classified_rows(shards: DataFrame, selection: DataFrame) -> DataFrame:
    """Raw rows of selected products with their disposition.

    ``selection`` has ``parent_asin`` and ``months`` (``YYYY-MM``). Adds
    ``month_idx``, ``source_record_key`` and ``disposition``: ``ineligible``,
    ``outside_period`` or ``candidate``. Copies are told apart by key later.
    """
    wanted = selection.select("parent_asin", F.transform("months", index_of_key).alias("_months"))
    eligible = validity()["eligible"]
    month = F.when(eligible, month_index(F.timestamp_millis("timestamp")))
    rows = shards.withColumn("month_idx", month).join(wanted, "parent_asin")
    return rows.withColumns({
        "source_record_key": hashing.source_record_key(hashing.record_identity()),
        "disposition": F.when(F.col("month_idx").isNull(), "ineligible")
        .when(~F.array_contains("_months", F.col("month_idx")), "outside_period")
        .otherwise("candidate"),
    }).drop("_months")


def only_candidate_texts(classified: DataFrame) -> DataFrame:
    """Classified rows to store: the wide columns of rows that are not imported are left empty."""
    kept = F.col("disposition") == "candidate"
    return classified.withColumns({c: F.when(kept, F.col(c)) for c in ("title", "text", "asin", "user_id")})


def unique_candidates(classified: DataFrame) -> DataFrame:
    """One row per record key; copies are equal in every identifying column.

    Copies collapse in the map tasks first, so a record repeated without bound
    reaches its reducer once per task.
    """
    return classified.filter(F.col("disposition") == "candidate").dropDuplicates(
        ["source_record_key"]
    )


def review_rows(unique: DataFrame) -> DataFrame:
    """Import rows of the review table."""
    identity = F.substring("source_record_key", len(hashing.RECORD_PREFIX) + 1, 64)
    return unique.select(
        hashing.review_id(identity).alias("review_id"),
        hashing.product_id(F.col("parent_asin")).alias("product_id"),
        "source_record_key",
        F.lit("real").alias("source_mode"),
        "asin",
        strip_to_null(F.col("title")).alias("title"),
        strip(F.col("text")).alias("text"),
        F.col("rating").cast("int").alias("rating"),
        F.timestamp_millis("timestamp").alias("reviewed_at"),
        F.lit(True).alias("eligible"),
    )


def import_audit(classified: DataFrame) -> DataFrame:
    """The waterfall in one row: selected, ineligible, outside, duplicate, imported."""
    kind = F.col("disposition")
    key = F.when(kind == "candidate", F.col("source_record_key"))
    # rows per (disposition, key) first: the distinct keys are then plain rows
    per_key = classified.groupBy(kind, key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")

    def rows(name: str) -> F.Column:
        return F.coalesce(F.sum(F.when(kind == name, n)), F.lit(0).cast("bigint"))

    imported = F.count_if(kind == "candidate")
    return per_key.agg(
        F.coalesce(F.sum(n), F.lit(0).cast("bigint")).alias("selected_source_rows"),
        rows("ineligible").alias("excluded_ineligible"),
        rows("outside_period").alias("excluded_outside_period"),
        (rows("candidate") - imported).alias("excluded_exact_duplicate"),
        imported.alias("eligible_unique_import_rows"),
    )


def imported_months(unique: DataFrame) -> DataFrame:
    """Imported reviews per product and month."""
    return unique.groupBy("parent_asin", "month_idx").agg(F.count(F.lit(1)).alias("n")).select(
        "parent_asin", key_of_index(F.col("month_idx")).alias("month"), "n"
    )


def volume_problems(
    selection: DataFrame,
    months: DataFrame,
    per_month: int = D.WINDOW_MIN_PER_MONTH,
    smallest: int = D.WINDOW_MIN_TOTAL,
    largest: int = D.WINDOW_MAX_TOTAL,
) -> DataFrame:
    """Selected months below the minimum and products whose total is out of range."""
    wanted = selection.select("parent_asin", F.explode("months").alias("month"))
    counted = wanted.join(months, ["parent_asin", "month"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0).cast("bigint"))
    )
    thin = counted.filter(F.col("n") < per_month).select(
        "parent_asin", "month", "n", F.lit("month_below_minimum").alias("problem")
    )
    totals = counted.groupBy("parent_asin").agg(F.sum("n").alias("n"))
    off = totals.filter(~F.col("n").between(smallest, largest)).select(
        "parent_asin", F.lit(None).cast("string").alias("month"), "n",
        F.lit("total_out_of_range").alias("problem"),
    )
    return thin.unionByName(off)


def product_rows(
    selection: DataFrame, metadata: DataFrame, category_name: F.Column | None = None,
    review_revision: str = "", metadata_revision: str = "",
) -> DataFrame:
    """Import rows of the product table, with the metadata document as JSON."""
    joined = selection.join(metadata, "parent_asin")
    months = F.col("months")
    document = F.struct(
        F.col("category").alias("source_category"),
        (category_name if category_name is not None else F.lit(None).cast("string"))
        .alias("category_name_ko"),
        "title_ko", "title_ko_source", "description_ko", "product_type", "main_category", "store",
        description_text(F.col("description")).alias("description"),
        F.coalesce("features", F.array().cast("array<string>")).alias("features"),
        F.col("average_rating").alias("source_average_rating"),
        F.col("rating_number").alias("source_rating_number"),
        F.lit(review_revision).alias("review_revision"),
        F.lit(metadata_revision).alias("metadata_revision"),
        months.alias("analysis_months"),
        F.col("analysis_sample_size").try_cast("int").alias("analysis_sample_size"),
        F.element_at(months, -2).alias("baseline_month"),
        F.element_at(months, -1).alias("target_month"),
    )
    return joined.select(
        hashing.product_id(F.col("parent_asin")).alias("product_id"),
        F.lit("real").alias("source_mode"), "parent_asin",
        strip(F.col("title")).alias("title"), "category",
        first_image(F.col("images")).alias("image_url"),
        F.to_json(document, {"ignoreNullFields": "false"}).alias("metadata_json"),
    )
