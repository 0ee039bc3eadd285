"""Review facts and the two rollups every report is read from.

A review belongs to one product and one month, so every distinct-review count is a
sum over (product, month) once labels are reduced to one row per review and
issue. The rollups are small; reports join those and leave the facts alone.

Expected columns:
  reviews   product_id, review_id, source_mode, rating, reviewed_at, eligible
  results   run_id, review_id, status
  labels    run_id, review_id, label_id, aspect, detail, polarity, evidence
  products  product_id, source_mode, category
  runs      run_id, source_mode, is_active, created_at
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.defaults import OFFICIAL_CATEGORIES, POLARITIES
from tidemark.functions.months import in_supported_range, month_index

ISSUE = ["aspect", "detail"]


def active_runs(runs: DataFrame) -> DataFrame:
    """The newest active run of each source mode: ``source_mode, run_id``."""
    newest = F.max_by("run_id", F.struct("created_at", "run_id"))
    return runs.filter("is_active").groupBy("source_mode").agg(newest.alias("run_id"))


def attach_active_run(
    products: DataFrame,
    runs: DataFrame,
    official: Sequence[str] | None = OFFICIAL_CATEGORIES,
) -> DataFrame:
    """Add ``run_id``; real products outside the official categories have none."""
    joined = products.join(active_runs(runs), "source_mode", "left")
    if official is None:
        return joined
    excluded = (F.col("source_mode") == "real") & ~F.col("category").isin(*official)
    return joined.withColumn("run_id", F.when(~excluded, F.col("run_id")))


def scoped_reviews(
    reviews: DataFrame, products: DataFrame, sample: DataFrame | None = None
) -> DataFrame:
    """Eligible reviews with their product's run and sample membership.

    ``products`` carries ``product_id, run_id`` and, with a sample, ``sample_size``.
    ``sample`` holds the member ``review_id``s. A product without a sample size
    takes every review.
    """
    sized = "sample_size" in products.columns and sample is not None
    keep = ["product_id", "run_id"] + (["sample_size"] if sized else [])
    scoped = (
        reviews.filter("eligible")
        .select("product_id", "review_id", "rating", "reviewed_at",
                month_index(F.col("reviewed_at")).alias("month_idx"))
        .join(products.select(*keep), "product_id")
    )
    if not sized:
        return scoped.withColumn("in_sample", F.lit(True))
    members = sample.select("review_id", F.lit(True).alias("member"))
    inside = F.col("sample_size").isNull() | F.coalesce("member", F.lit(False))
    return (
        scoped.join(members, "review_id", "left")
        .withColumn("in_sample", inside)
        .drop("member", "sample_size")
    )


def run_reviews(reviews: DataFrame, run_id: str, sample: DataFrame | None = None) -> DataFrame:
    """Eligible reviews under one run, without a look at the product table.

    The usual case: reports are about one source mode, which has one active run.
    Reviews then meet results and labels on the review alone and are never
    shuffled by product. Which products a report covers is settled on the rollups
    (:func:`for_products`). ``sample`` holds the members of every product, as
    :func:`tidemark.operators.sampling.month_sample` gives them.
    """
    scoped = reviews.filter("eligible").select(
        "product_id", "review_id", "rating", "reviewed_at",
        month_index(F.col("reviewed_at")).alias("month_idx"), F.lit(run_id).alias("run_id"),
    )
    if sample is None:
        return scoped.withColumn("in_sample", F.lit(True))
    members = sample.select("review_id", F.lit(True).alias("member"))
    return (
        scoped.join(members, "review_id", "left")
        .withColumn("in_sample", F.coalesce("member", F.lit(False)))
        .drop("member")
    )


def review_facts(scoped: DataFrame, results: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per scoped review: status in its run, labelled flag, polarity flags.

    All joins and the reduction are on the review, so the labels meet the reviews
    in one co-partitioned pass and no group is larger than one review.
    """
    key = ["review_id", "run_id"]
    per_review = labels.groupBy(*key).agg(
        *[F.max(F.col("polarity") == p).alias(f"has_{p}") for p in POLARITIES]
    )
    status = results.select(*key, "status")
    joined = scoped.join(status, key, "left").join(
        per_review.withColumn("labelled", F.lit(True)), key, "left"
    )
    analysed = F.coalesce((F.col("status") == "succeeded") & F.col("in_sample"), F.lit(False))
    flags = [
        F.coalesce(analysed & F.col(f"has_{p}"), F.lit(False)).alias(f"has_{p}")
        for p in POLARITIES
    ]
    return joined.select(
        "product_id", "month_idx", "review_id", "run_id", "rating", "reviewed_at", "in_sample",
        "status", F.coalesce("labelled", F.lit(False)).alias("labelled"),
        analysed.alias("analysed"), *flags,
    )


def succeeded_reviews(scoped: DataFrame, results: DataFrame) -> DataFrame:
    """The reviews every rate is taken over: succeeded in the run, inside the sample."""
    done = results.filter(F.col("status") == "succeeded").select("review_id", "run_id")
    return scoped.filter("in_sample").join(done, ["review_id", "run_id"])


def analysed_labels(scoped: DataFrame, results: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of succeeded reviews, same review and same run throughout."""
    return succeeded_reviews(scoped, results).join(labels, ["review_id", "run_id"])


def issue_facts(label_rows: DataFrame) -> DataFrame:
    """One row per review and (aspect, detail) with a flag per polarity."""
    keys = ["review_id", "run_id", "product_id", "month_idx", *ISSUE]
    return label_rows.groupBy(*keys).agg(
        *[F.max(F.col("polarity") == p).alias(f"has_{p}") for p in POLARITIES]
    )


def _n(flag) -> F.Column:
    return F.count_if(flag)


def stored_months(reviews: DataFrame) -> DataFrame:
    """Eligible review counts and ratings per product and month, reviews alone."""
    return (
        reviews.filter("eligible")
        .groupBy("product_id", month_index(F.col("reviewed_at")).alias("month_idx"))
        .agg(*_review_counts())
    )


def _review_counts() -> list[F.Column]:
    return [
        F.count(F.lit(1)).alias("review_count"),
        F.sum("rating").cast("bigint").alias("rating_sum"),
        *[_n(F.col("rating") == r).alias(f"rating_{r}") for r in range(1, 6)],
    ]


def month_rollup(facts: DataFrame) -> DataFrame:
    """Counts per product and month, all additive over months."""
    sampled = F.col("in_sample")
    scope = {
        "scope_total": sampled,
        "succeeded": sampled & (F.col("status") == "succeeded"),
        "failed": sampled & (F.col("status") == "failed"),
        "in_progress": sampled & F.col("status").isin("pending", "running"),
        "labelled": sampled & F.col("labelled") & F.col("run_id").isNotNull(),
        "succeeded_all": F.col("status") == "succeeded",
    }
    return facts.groupBy("product_id", "month_idx").agg(
        *_review_counts(),
        *[_n(test).alias(name) for name, test in scope.items()],
        *[_n(F.col(f"has_{p}")).alias(f"{p}_reviews") for p in POLARITIES],
    )


ANALYSIS_COLUMNS = (
    "succeeded", "failed", "in_progress", "labelled", "succeeded_all",
    *[f"{p}_reviews" for p in POLARITIES],
)


def for_products(months: DataFrame, products: DataFrame) -> DataFrame:
    """The month rollup of the given products; those without a run count no analysis."""
    joined = months.join(products.select("product_id", F.col("run_id").alias("_run")), "product_id")
    none = F.lit(0).cast("bigint")
    return joined.withColumns({
        c: F.when(F.col("_run").isNull(), none).otherwise(F.col(c)) for c in ANALYSIS_COLUMNS
    }).drop("_run")


def product_rollup(months: DataFrame) -> DataFrame:
    """Product totals from the month rollup; coverage counts the supported range."""
    inside = in_supported_range(F.col("month_idx"))
    coverage = {"scope_total", "succeeded", "failed", "in_progress", "labelled"}
    skip = {"product_id", "month_idx"}
    sums = [
        F.sum(F.when(inside, F.col(c)).otherwise(0) if c in coverage else F.col(c)).alias(c)
        for c in months.columns
        if c not in skip
    ]
    month_list = F.array_sort(F.collect_list("month_idx"))
    return months.groupBy("product_id").agg(*sums, month_list.alias("months"))


def issue_rollup(issues: DataFrame) -> DataFrame:
    """Distinct reviews per product, month and issue: mentions and each polarity."""
    return issues.groupBy("product_id", "month_idx", *ISSUE).agg(
        F.count(F.lit(1)).alias("mentions"),
        *[_n(F.col(f"has_{p}")).alias(p) for p in POLARITIES],
    )


def product_issues(rollup: DataFrame) -> DataFrame:
    """Issue counts over all months of a product."""
    return rollup.groupBy("product_id", *ISSUE).agg(
        F.sum("mentions").alias("mentions"), *[F.sum(p).alias(p) for p in POLARITIES]
    )


def by_polarity(counts: DataFrame, keys: Sequence[str], value: str = "review_count") -> DataFrame:
    """Wide polarity counts as one row per polarity that occurs."""
    return (
        counts.unpivot(list(keys), list(POLARITIES), "polarity", value)
        .filter(F.col(value) > 0)
    )


def issue_evidence(issues: DataFrame) -> DataFrame:
    """The reviews behind each count, one row per review, issue and polarity.

    Rows, not arrays: a product's hottest issue has no bound, so its review list
    is never gathered into one record.
    """
    present = F.array_compact(
        F.array(*[F.when(F.col(f"has_{p}"), F.lit(p)) for p in POLARITIES])
    )
    return issues.select(
        "product_id", "month_idx", *ISSUE, F.explode(present).alias("polarity"), "review_id"
    )
