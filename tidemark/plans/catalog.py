"""Product cards, product search and listings, review lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.defaults import OFFICIAL_CATEGORIES
from tidemark.functions.months import in_month, key_of_index
from tidemark.functions.rates import rate
from tidemark.operators.lineage import cut
from tidemark.operators.topk import page
from tidemark.plans.insights import overview


def filter_products(
    products: DataFrame,
    query: str | None = None,
    category: str | None = None,
    source_mode: str | None = "real",
    official: Sequence[str] | None = OFFICIAL_CATEGORIES,
) -> DataFrame:
    """Products by source, category and free text.

    Without a category, real products are listed from the official categories
    only. The text matches title, Korean title or ASIN in any letter case; ``%``
    and ``_`` in it act as wildcards.
    """
    found = products
    if source_mode is not None:
        found = found.filter(F.col("source_mode") == source_mode)
    if official is not None and source_mode == "real" and not category:
        found = found.filter(F.col("category").isin(*official))
    if query:
        pattern = f"%{query.strip()}%"
        title_ko = F.get_json_object("metadata_json", "$.title_ko")
        match = (
            F.col("title").ilike(pattern) | F.coalesce(title_ko.ilike(pattern), F.lit(False))
            | F.coalesce(F.col("parent_asin").ilike(pattern), F.lit(False))
        )
        found = found.filter(match)
    if category:
        found = found.filter(F.col("category") == category)
    return found


def categories(products: DataFrame, source_mode: str) -> DataFrame:
    return (
        products.filter(F.col("source_mode") == source_mode)
        .select("category").distinct().orderBy("category")
    )


def metadata_fields() -> list[F.Column]:
    """Typed fields of the metadata document that reports read."""

    def text(key: str) -> F.Column:
        return F.nullif(F.get_json_object("metadata_json", f"$.{key}"), F.lit(""))

    return [
        text("title_ko").alias("title_ko"),
        text("title_ko_source").alias("title_ko_source"),
        text("store").alias("store"),
        text("source_average_rating").try_cast("double").alias("source_average_rating"),
        text("source_rating_number").try_cast("bigint").alias("source_rating_count"),
        text("analysis_sample_size").try_cast("int").alias("sample_size"),
        F.from_json(text("analysis_months"), "array<string>").alias("analysis_months"),
        F.coalesce(text("review_revision"), F.lit("amazon-reviews-2023")).alias("review_revision"),
    ]


def cards(products: DataFrame, months: DataFrame) -> DataFrame:
    """One card per product: counts, shares, coverage status, available months."""
    over = overview(products, months)
    analysed = F.when(F.col("run_id").isNull(), F.lit(0)).otherwise(F.col("succeeded"))
    return products.drop("run_id").join(over, "product_id").select(
        *[c for c in products.columns if c != "run_id"],
        "analysis_status", analysed.alias("analyzed_review_count"), "positive_share",
        "negative_share", "review_count",
        F.transform(F.coalesce("months", F.array().cast("array<int>")), key_of_index)
        .alias("available_months"),
    )


def card_page(card_rows: DataFrame, number: int, size: int) -> DataFrame:
    return page(card_rows, [F.col("title"), F.col("product_id")], number, size)


def inventory(
    products: DataFrame, months: DataFrame, sample: DataFrame, category_names: DataFrame | None = None
) -> DataFrame:
    """Stored products with review and sample counts and their metadata.

    ``sample`` is the member table of sized products.
    """
    stored = months.groupBy("product_id").agg(F.sum("review_count").alias("reviews"))
    sampled = sample.groupBy("product_id").agg(F.count(F.lit(1)).alias("sample"))
    chosen = F.col("analysis_months")
    period = F.when(
        F.size(chosen) > 0,
        F.concat(F.get(chosen, F.lit(0)), F.lit(" ~ "), F.element_at(chosen, -1)),
    ).otherwise("")
    rows = (
        products.select("product_id", "category", "parent_asin", "title", "image_url",
                        *metadata_fields())
        .join(stored, "product_id", "left")
        .join(sampled, "product_id", "left")
    )
    if category_names is not None:
        rows = rows.join(category_names, "category", "left")
    return rows.withColumns({
        "reviews": F.coalesce("reviews", F.lit(0).cast("bigint")),
        "sample": F.when(F.col("sample_size") > 0, F.col("sample")),
        "title_ko": F.coalesce("title_ko", F.lit("")),
        "store": F.coalesce("store", F.lit("")),
        "image_url": F.coalesce("image_url", F.lit("")),
        "period": period,
    })


def filter_reviews(
    reviews: DataFrame,
    month: str | None = None,
    labels: DataFrame | None = None,
    aspect: str | None = None,
    polarity: str | None = None,
) -> DataFrame:
    """Eligible reviews of a month; aspect and polarity must hold on one label.

    ``labels`` holds the active run's labels. A semi join keeps each review once.
    """
    found = reviews.filter("eligible")
    if month is not None:
        found = found.filter(in_month(F.col("reviewed_at"), month))
    if aspect or polarity:
        if labels is None:
            return found.filter(F.lit(False))
        matching = labels
        if aspect:
            matching = matching.filter(F.col("aspect") == aspect)
        if polarity:
            matching = matching.filter(F.col("polarity") == polarity)
        found = found.join(matching.select("review_id"), "review_id", "left_semi")
    return found


def review_order() -> list[F.Column]:
    return [F.desc("reviewed_at"), F.col("review_id")]


def with_review_details(
    rows: DataFrame, results: DataFrame, labels: DataFrame, sample: DataFrame | None = None
) -> DataFrame:
    """Analysis status, sorted labels and sample membership of listed reviews.

    ``results`` and ``labels`` belong to one run. Attach this to a page of reviews,
    which is computed once; only its labels are grouped. The label array holds one
    review's labels.
    """
    rows = cut(rows)
    labelled = labels.join(rows.select("review_id").distinct(), "review_id", "left_semi").groupBy("review_id").agg(
        F.array_sort(
            F.collect_list(F.struct("aspect", "detail", "polarity", "label_id", "evidence"))
        ).alias("labels")
    )
    empty = F.array().cast(labelled.schema["labels"].dataType)
    detailed = (
        rows.join(results.select("review_id", "status"), "review_id", "left")
        .join(labelled, "review_id", "left")
        .withColumns({
            "analysis_status": F.coalesce("status", F.lit("not_started")),
            "labels": F.coalesce("labels", empty),
        })
        .drop("status")
    )
    if sample is None:
        return detailed.withColumn("in_analysis_sample", F.lit(None).cast("boolean"))
    members = sample.select("review_id", F.lit(True).alias("_member"))
    return (
        detailed.join(members, "review_id", "left")
        .withColumn("in_analysis_sample", F.coalesce("_member", F.lit(False)))
        .drop("_member")
    )


def product_detail(products: DataFrame, months: DataFrame) -> DataFrame:
    """A card with its month statistics as rows of an array (at most one per month)."""
    stats = months.groupBy("product_id").agg(
        F.array_sort(F.collect_list(F.struct(
            key_of_index(F.col("month_idx")).alias("month"), "review_count",
            rate(F.col("rating_sum"), F.col("review_count")).alias("average_rating"),
        ))).alias("monthly_stats")
    )
    return cards(products, months).join(stats, "product_id", "left")
