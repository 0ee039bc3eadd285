"""Product report: ratings, coverage, issues, complaints, months, latest change."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark import defaults as D
from tidemark.functions.months import key_of_index
from tidemark.functions.rates import period_status, rate, unprocessed
from tidemark.operators import compare
from tidemark.operators.facts import ISSUE, product_issues, product_rollup
from tidemark.operators.topk import top_per_group


def overview(products: DataFrame, months: DataFrame) -> DataFrame:
    """Review totals, rating distribution, coverage and polarity shares per product."""
    joined = products.select("product_id", "run_id").join(
        product_rollup(months), "product_id", "left"
    )
    counts = [c for c in joined.columns if c not in ("product_id", "run_id", "months")]
    filled = joined.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in counts})
    c = F.col
    return filled.select(
        "product_id", "run_id", "review_count",
        rate(c("rating_sum"), c("review_count")).alias("average_rating"),
        *[f"rating_{r}" for r in range(1, 6)],
        c("scope_total").alias("analysis_total"), "succeeded", "failed", "in_progress",
        unprocessed(c("scope_total"), c("succeeded"), c("failed"), c("in_progress")).alias(
            "unprocessed"
        ),
        rate(c("succeeded"), c("scope_total")).alias("processing_rate"),
        period_status(c("scope_total"), c("succeeded"), c("failed"), c("in_progress")).alias(
            "analysis_status"
        ),
        rate(c("positive_reviews"), c("succeeded")).alias("positive_share"),
        rate(c("negative_reviews"), c("succeeded")).alias("negative_share"),
        "months",
    )


def rating_distribution(over: DataFrame) -> DataFrame:
    """One row per product and rating 1 to 5; ratings without reviews show zero."""
    wide = over.select("product_id", *[F.col(f"rating_{r}").alias(str(r)) for r in range(1, 6)])
    return wide.unpivot(["product_id"], [str(r) for r in range(1, 6)], "rating", "review_count")\
        .withColumn("rating", F.col("rating").cast("int"))


def aspects(over: DataFrame, rollup: DataFrame) -> DataFrame:
    """Mentions and polarity counts of each issue with rates over analysed reviews."""
    joined = product_issues(rollup).join(over.select("product_id", "succeeded"), "product_id")
    return joined.select(
        "product_id", *ISSUE, F.col("mentions").alias("mention_count"),
        *[F.col(p).alias(f"{p}_count") for p in D.POLARITIES],
        rate(F.col("mentions"), F.col("succeeded")).alias("mention_rate"),
        rate(F.col("positive"), F.col("succeeded")).alias("positive_rate"),
        rate(F.col("negative"), F.col("succeeded")).alias("negative_rate"),
    )


def aspect_order() -> list[F.Column]:
    return [F.desc("mention_count"), F.col("aspect"), F.col("detail")]


def ranked_aspects(aspect_rows: DataFrame) -> DataFrame:
    """Aspects with their ``rank`` in the listing of their product."""
    return aspect_rows.withColumn("rank", F.row_number().over(Window.partitionBy("product_id").orderBy(*aspect_order())))


def top_complaints(aspect_rows: DataFrame, k: int = 3) -> DataFrame:
    """The issues with most negative reviews in each product."""
    complained = aspect_rows.filter(F.col("negative_count") > 0)
    return top_per_group(
        complained, ["product_id"], [F.desc("negative_count"), *map(F.col, ISSUE)], k
    ).select("product_id", "rank", *ISSUE, "negative_count", "negative_rate")


def label_examples(
    label_rows: DataFrame, k: int = 3, wanted: DataFrame | None = None
) -> DataFrame:
    """The newest ``k`` reviews of each (product, issue, polarity), one quote each.

    A review with several quotes shows the one with the lowest label id. ``wanted``
    restricts the issues (columns ``product_id``, ``aspect``, ``detail``, ``polarity``).
    """
    keys = ["product_id", *ISSUE, "polarity"]
    rows = label_rows
    if wanted is not None:
        rows = rows.join(wanted.select(*keys), keys, "left_semi")
    # a product has one run; keeping it in the key reuses the partitioning of the joins
    per_review = rows.groupBy("review_id", "run_id", *keys).agg(
        F.max("rating").alias("rating"), F.max("reviewed_at").alias("reviewed_at"),
        F.min_by("evidence", "label_id").alias("evidence"),
    )
    return top_per_group(
        per_review.drop("run_id"), keys, [F.desc("reviewed_at"), F.col("review_id")], k
    )


def monthly(months: DataFrame) -> DataFrame:
    """Stored months with review counts, ratings and shares of analysed reviews."""
    c = F.col
    return months.select(
        "product_id", key_of_index(c("month_idx")).alias("month"), "review_count",
        rate(c("rating_sum"), c("review_count")).alias("average_rating"),
        c("succeeded").alias("analyzed_count"),
        rate(c("positive_reviews"), c("succeeded")).alias("positive_review_share"),
        rate(c("negative_reviews"), c("succeeded")).alias("negative_review_share"),
    )


@dataclass(frozen=True)
class InsightReport:
    """The parts of the product report, each keyed by ``product_id``."""

    overview: DataFrame
    ratings: DataFrame
    aspects: DataFrame
    complaints: DataFrame
    examples: DataFrame
    monthly: DataFrame
    latest_pair: DataFrame
    latest_changes: DataFrame


def insight_report(
    products: DataFrame, months: DataFrame, rollup: DataFrame, label_rows: DataFrame
) -> InsightReport:
    """All parts for all products; callers filter by product."""
    over = overview(products, months)
    aspect_rows = aspects(over, rollup)
    complaints = top_complaints(aspect_rows)
    covered = compare.coverage(compare.latest_pair(months), months)
    changes = compare.issues(covered, rollup)
    wanted = complaints.withColumn("polarity", F.lit("negative"))
    return InsightReport(
        overview=over,
        ratings=rating_distribution(over),
        aspects=aspect_rows,
        complaints=complaints,
        examples=label_examples(label_rows, 3, wanted),
        monthly=monthly(months),
        latest_pair=compare.signals(covered, changes),
        latest_changes=compare.top_increases(changes),
    )


def with_names(df: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Attach display names of issues; unknown codes keep null names.

    ``df`` carries ``category``; ``taxonomy`` is one row per (category, aspect,
    detail). The taxonomy is a small dimension and Spark broadcasts it by size.
    """
    names = taxonomy.select("category", *ISSUE, "aspect_name", "detail_name")
    return df.join(names, ["category", *ISSUE], "left")
