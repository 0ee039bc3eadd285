"""Category profile: audit, product and month volumes, three-month windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark import defaults as D
from tidemark.functions.months import key_of_index, month_index
from tidemark.functions.products import compact_metadata, validity
from tidemark.operators.topk import top_per_group

FIELDS = ("parent_asin", "asin", "text", "rating", "timestamp")


def shard_volumes(shards: DataFrame, *by: str) -> DataFrame:
    """Row and validity counts per product and month, from one scan.

    Audit, product totals and month counts are all sums of these rows, so the raw
    shards are read once and combined in the map tasks. Rows that are not eligible
    have no month. ``by`` names columns of the shards to tell apart as well.
    """
    checks = validity()
    month = F.when(
        checks["eligible"], month_index(F.timestamp_millis("timestamp"))
    )
    flags = shards.select(
        *by, "parent_asin", month.alias("month_idx"), "timestamp",
        *[checks[f].alias(f"ok_{f}") for f in FIELDS], checks["eligible"].alias("eligible"),
    )
    return flags.groupBy(*by, "parent_asin", "month_idx").agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count_if(~F.col(f"ok_{f}")).alias(f"invalid_{f}") for f in FIELDS],
        F.count_if("eligible").alias("eligible_rows"),
        F.min(F.when(F.col("eligible"), F.col("timestamp"))).alias("first_timestamp"),
        F.max(F.when(F.col("eligible"), F.col("timestamp"))).alias("last_timestamp"),
    )


def add_up(volumes: DataFrame, *keys: str) -> DataFrame:
    """Volumes of parts of the shards as volumes of all, by the given keys."""
    return volumes.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("total_rows", *[f"invalid_{f}" for f in FIELDS], "eligible_rows")],
        F.min("first_timestamp").alias("first_timestamp"),
        F.max("last_timestamp").alias("last_timestamp"),
    )


def audit(volumes: DataFrame) -> DataFrame:
    """One row: totals, invalid counts per field, eligible products, month range."""
    per_product = add_up(volumes, "parent_asin")

    def month(value: F.Column) -> F.Column:
        return key_of_index(month_index(F.timestamp_millis(value)))

    return per_product.agg(
        *[F.sum(c).alias(c) for c in
          ("total_rows", *[f"invalid_{f}" for f in FIELDS], "eligible_rows")],
        F.count_if(F.col("eligible_rows") > 0).alias("eligible_product_count"),
        month(F.min("first_timestamp")).alias("first_observed_month"),
        month(F.max("last_timestamp")).alias("last_observed_month"),
    )


def candidate_months(
    volumes: DataFrame, minimum: int = 3 * D.WINDOW_MIN_PER_MONTH
) -> DataFrame:
    """Month counts of products with enough reviews for a window."""
    total = F.sum("eligible_rows").over(Window.partitionBy("parent_asin"))
    counted = volumes.filter(F.col("eligible_rows") > 0).withColumn("_total", total)
    return counted.filter(F.col("_total") >= minimum).select(
        "parent_asin", "month_idx", F.col("eligible_rows").alias("n")
    )


def best_windows(
    months: DataFrame,
    last_observed: DataFrame,
    per_month: int = D.WINDOW_MIN_PER_MONTH,
    smallest: int = D.WINDOW_MIN_TOTAL,
    largest: int = D.WINDOW_MAX_TOTAL,
    center: int = D.WINDOW_CENTER,
) -> DataFrame:
    """The best three complete consecutive months of each product.

    ``last_observed`` is one row with the last month index of the input, which is
    incomplete and never part of a window. Nearest to the center volume first,
    then the most even, then the latest.
    """
    span = Window.partitionBy("parent_asin").orderBy("month_idx").rangeBetween(-2, 0)
    c = F.col
    windows = months.select(
        "parent_asin", c("month_idx").alias("end_idx"),
        F.count(F.lit(1)).over(span).alias("present"),
        F.sum("n").over(span).alias("review_count"),
        F.min("n").over(span).alias("low"), F.max("n").over(span).alias("high"),
        F.collect_list("n").over(span).alias("counts"),
    )
    fits = (
        (c("present") == 3) & (c("low") >= per_month)
        & c("review_count").between(smallest, largest)
        & (c("end_idx") < last_observed.scalar())
    )
    scored = windows.filter(fits).withColumns({
        "balance_gap": c("high") - c("low"),
        "distance": F.abs(c("review_count") - center),
    })
    best = top_per_group(
        scored, ["parent_asin"], [c("distance"), c("balance_gap"), F.desc("end_idx")], 1
    )
    return best.select(
        "parent_asin", "end_idx", "review_count", "balance_gap", "distance", "counts",
        F.transform(F.sequence(c("end_idx") - 2, c("end_idx")), key_of_index).alias("months"),
    )


def window_order() -> list[F.Column]:
    return [F.col("distance"), F.col("balance_gap"), F.col("parent_asin")]


def ranked_candidates(
    windows: DataFrame,
    metadata: DataFrame,
    top: int = D.PROFILE_TOP,
    looked_up: int | None = None,
) -> DataFrame:
    """The first candidates that have metadata, in rank order.

    Windows without metadata are left out before the final ``top``. ``looked_up``
    limits the windows that are considered, best first; by default all are.
    """
    first = windows if looked_up is None else windows.orderBy(*window_order()).limit(looked_up)
    described = first.join(metadata.select("parent_asin", *compact_metadata()), "parent_asin")
    return described.orderBy(*window_order()).limit(top)
