"""Two-period comparison of issue rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark import defaults as D
from tidemark.functions.months import key_of_index, parse_month
from tidemark.functions.rates import change_pp, combined_status, period_status, rate, unprocessed
from tidemark.operators.facts import ISSUE, by_polarity

PAIR = ["product_id", "baseline_idx", "target_idx"]


def consecutive_pairs(months: DataFrame) -> DataFrame:
    """Neighbouring months in each product's stored sequence (gaps are skipped)."""
    window = Window.partitionBy("product_id").orderBy("month_idx")
    return (
        months.select("product_id", F.col("month_idx").alias("baseline_idx"),
                      F.lead("month_idx").over(window).alias("target_idx"))
        .filter(F.col("target_idx").isNotNull())
    )


def latest_pair(months: DataFrame) -> DataFrame:
    """The last two stored months of each product that has two."""
    # a product has at most one entry per month of the supported range
    ends = months.groupBy("product_id").agg(
        F.slice(F.sort_array(F.collect_list("month_idx"), asc=False), 1, 2).alias("ends")
    )
    return ends.filter(F.size("ends") == 2).select(
        "product_id", F.col("ends")[1].alias("baseline_idx"), F.col("ends")[0].alias("target_idx")
    )


def chosen_pair(products: DataFrame, baseline: str, target: str) -> DataFrame:
    """The same two months for every product."""
    first, second = parse_month(baseline), parse_month(target)
    if first >= second:
        raise ValueError("the baseline month must be earlier than the target month")
    return products.select(
        "product_id", F.lit(first).alias("baseline_idx"), F.lit(second).alias("target_idx")
    )


def adjacent_dense_pairs(months: DataFrame, minimum: int = D.MIN_REVIEW_COUNT) -> DataFrame:
    """Calendar-adjacent months that both hold at least ``minimum`` reviews."""
    window = Window.partitionBy("product_id").orderBy("month_idx")
    before = months.select(
        "product_id", "month_idx", "review_count",
        F.lag("month_idx").over(window).alias("baseline_idx"),
        F.lag("review_count").over(window).alias("baseline_count"),
    )
    dense = (
        (F.col("baseline_idx") == F.col("month_idx") - 1)
        & (F.col("baseline_count") >= minimum) & (F.col("review_count") >= minimum)
    )
    return before.filter(dense).select(
        "product_id", "baseline_idx", "baseline_count",
        F.col("month_idx").alias("target_idx"), F.col("review_count").alias("target_count"),
        (F.col("baseline_count") + F.col("review_count")).alias("total_count"),
    )


# Month rollup columns a comparison shows, and their names per period.
_PERIOD = {
    "review_count": "total",
    "rating_sum": "rating_sum",
    "scope_total": "scope_total",
    "succeeded": "succeeded",
    "failed": "failed",
    "in_progress": "in_progress",
    "labelled": "labelled",
}


def _sides(pairs: DataFrame, *extra: str) -> DataFrame:
    """Two rows per pair, one for each month, marked with its side."""
    both = F.array(
        F.struct(F.lit("target").alias("side"), F.col("target_idx").alias("month_idx")),
        F.struct(F.lit("baseline").alias("side"), F.col("baseline_idx").alias("month_idx")),
    )
    return pairs.select(*PAIR, *extra, F.inline(both))


def coverage(
    pairs: DataFrame, months: DataFrame, max_failure_rate: float = D.MAX_FAILURE_RATE
) -> DataFrame:
    """Totals, processing counts and status of both periods, one row per pair.

    A month without reviews counts as zero reviews, with no average rating.
    """
    joined = _sides(pairs).join(
        months.select("product_id", "month_idx", *_PERIOD), ["product_id", "month_idx"], "left"
    )
    sums = [
        F.coalesce(
            F.sum(F.when(F.col("side") == side, F.col(column))), F.lit(0)
        ).alias(f"{side}_{name}")
        for side in ("target", "baseline")
        for column, name in _PERIOD.items()
    ]
    wide = joined.groupBy(*PAIR).agg(*sums)
    for side in ("target", "baseline"):
        c = {n: F.col(f"{side}_{n}") for n in _PERIOD.values()}
        wide = wide.withColumns({
            f"{side}_average_rating": rate(c["rating_sum"], c["total"]),
            f"{side}_unprocessed": unprocessed(
                c["scope_total"], c["succeeded"], c["failed"], c["in_progress"]
            ),
            f"{side}_processing_rate": rate(c["succeeded"], c["scope_total"]),
            f"{side}_status": period_status(
                c["scope_total"], c["succeeded"], c["failed"], c["in_progress"], max_failure_rate
            ),
        })
    both_have_reviews = (F.col("target_total") > 0) & (F.col("baseline_total") > 0)
    any_succeeded = F.col("target_succeeded") + F.col("baseline_succeeded") > 0
    complete = (
        both_have_reviews & (F.col("target_status") == "complete")
        & (F.col("baseline_status") == "complete")
    )
    return wide.withColumns({
        "any_succeeded": any_succeeded,
        "complete": complete,
        "has_issues": both_have_reviews & any_succeeded,
        "status": F.when(~both_have_reviews, "insufficient_data").when(complete, "ok")
        .when(any_succeeded, "partial").otherwise("insufficient_data"),
        "analysis_status": combined_status(
            F.col("target_status"), F.col("baseline_status"), any_succeeded
        ),
    }).drop("target_rating_sum", "baseline_rating_sum")


def issues(
    covered: DataFrame,
    rollup: DataFrame,
    min_review_count: int = D.MIN_REVIEW_COUNT,
    min_negative_count: int = D.MIN_NEGATIVE_COUNT,
    min_increase_pp: float = D.MIN_INCREASE_PP,
) -> DataFrame:
    """Counts, rates and change of every issue seen in either period.

    Each pair looks up its two months in the issue rollup; summing by side fills
    the absent one with zero, so no outer join is needed.
    """
    carried = ["target_succeeded", "baseline_succeeded", "complete"]
    long = by_polarity(
        rollup.select("product_id", "month_idx", *ISSUE, *D.POLARITIES),
        ["product_id", "month_idx", *ISSUE],
    )
    sided = _sides(covered.filter("has_issues"), *carried).join(long, ["product_id", "month_idx"])
    counted = sided.groupBy(*PAIR, *ISSUE, "polarity").agg(
        *[F.first(c).alias(c) for c in carried],
        *[
            F.coalesce(F.sum(F.when(F.col("side") == s, F.col("review_count"))), F.lit(0))
            .alias(f"{s}_count")
            for s in ("target", "baseline")
        ],
    )
    rated = counted.withColumns({
        "target_rate": rate(F.col("target_count"), F.col("target_succeeded")),
        "baseline_rate": rate(F.col("baseline_count"), F.col("baseline_succeeded")),
    }).withColumn("change_pp", change_pp(F.col("target_rate"), F.col("baseline_rate")))
    meets = (
        (F.col("polarity") == "negative")
        & (F.least("target_succeeded", "baseline_succeeded") >= min_review_count)
        & (F.col("target_count") >= min_negative_count)
        & F.coalesce(F.col("change_pp") >= min_increase_pp, F.lit(False))
    )
    return rated.select(
        *PAIR, *ISSUE, "polarity", "target_count",
        F.col("target_succeeded").alias("target_total"), "target_rate", "baseline_count",
        F.col("baseline_succeeded").alias("baseline_total"), "baseline_rate", "change_pp",
        F.when(F.col("complete"), meets).alias("meets_threshold"), "complete",
    )


def issue_order() -> list[F.Column]:
    """Largest change first; issues without a change last."""
    return [F.abs("change_pp").desc_nulls_last(), F.col("aspect"), F.col("detail"), F.col("polarity")]


def ranked_issues(issue_rows: DataFrame) -> DataFrame:
    """Issues with their ``rank`` in the listing of their pair; a pair has as many as there are kinds of label."""
    return issue_rows.withColumn("rank", F.row_number().over(Window.partitionBy(*PAIR).orderBy(*issue_order())))


def signals(
    covered: DataFrame, issue_rows: DataFrame, min_review_count: int = D.MIN_REVIEW_COUNT
) -> DataFrame:
    """Pair coverage with its signal status."""
    rising = (
        issue_rows.groupBy(*PAIR)
        .agg(F.bool_or(F.coalesce("meets_threshold", F.lit(False))).alias("rising"))
    )
    signal = (
        F.when((F.col("target_total") == 0) | (F.col("baseline_total") == 0), "insufficient_data")
        .when(~F.col("complete"), "analysis_incomplete")
        .when(F.least("target_succeeded", "baseline_succeeded") < min_review_count,
              "insufficient_sample")
        .when(F.coalesce("rising", F.lit(False)), "increase_signal")
        .otherwise("no_increase_signal")
    )
    return covered.join(rising, PAIR, "left").withColumn("signal_status", signal).withColumn(
        "is_provisional", ~F.col("complete")
    ).drop("rising")


def top_increases(issue_rows: DataFrame, k: int = 3) -> DataFrame:
    """The negative issues that rose most in each pair."""
    rising = issue_rows.filter((F.col("polarity") == "negative") & (F.col("change_pp") > 0))
    window = Window.partitionBy(*PAIR).orderBy(F.desc("change_pp"), *ISSUE)
    return rising.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def evidence_rows(pairs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence reviews of both periods of each pair, one row per review."""
    return _sides(pairs).join(evidence, ["product_id", "month_idx"]).drop("side", "month_idx")


def first_evidence(
    wanted: DataFrame, evidence: DataFrame, k: int = D.RADAR_EVIDENCE
) -> DataFrame:
    """The first ``k`` evidence ids of each wanted issue as one sorted array."""
    keys: Sequence[str] = [*PAIR, *ISSUE, "polarity"]
    rows = _sides(wanted.select(*keys).distinct(), *ISSUE, "polarity").join(
        evidence, ["product_id", "month_idx", *ISSUE, "polarity"]
    )
    window = Window.partitionBy(*keys).orderBy("review_id")
    firsts = rows.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") <= k)
    return firsts.groupBy(*keys).agg(
        F.array_sort(F.collect_list("review_id")).alias("evidence_review_ids")
    )


def with_month_keys(df: DataFrame) -> DataFrame:
    """Replace pair indexes by ``baseline_month`` and ``target_month`` text."""
    return df.withColumns({
        "baseline_month": key_of_index(F.col("baseline_idx")),
        "target_month": key_of_index(F.col("target_idx")),
    }).drop("baseline_idx", "target_idx")
