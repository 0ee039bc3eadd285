"""Counts, coverage and label aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.defaults import POLARITIES
from tidemark.functions.months import key_of_index
from tidemark.functions.rates import period_status, rate, unprocessed
from tidemark.operators import facts
from tidemark.plans import insights
from workload.binding import Facts, sql_rate, sql_status, sql_views
from workload.registry import query


def month() -> F.Column:
    return key_of_index(F.col("month_idx")).alias("month")


@query(f"""WITH {sql_views()}
SELECT product_id, month, count(*) AS review_count, avg(rating) AS average_rating
FROM reviews GROUP BY ALL""")
def monthly_stats(spark: SparkSession, sf: str) -> DataFrame:
    return Facts(spark, sf).stored_months.select(
        "product_id", month(), "review_count",
        rate(F.col("rating_sum"), F.col("review_count")).alias("average_rating"),
    )


@query(f"""WITH {sql_views()}
SELECT product_id, string_agg(DISTINCT month, ',' ORDER BY month) AS months
FROM reviews GROUP BY ALL""")
def available_months(spark: SparkSession, sf: str) -> DataFrame:
    over = facts.product_rollup(Facts(spark, sf).stored_months)
    keys = F.array_join(F.transform("months", key_of_index), ",")
    return over.select("product_id", keys.alias("months"))


@query(f"""WITH {sql_views()}
SELECT product_id, v AS rating, count(rating) AS review_count
FROM (SELECT DISTINCT product_id FROM reviews) p, (VALUES (1), (2), (3), (4), (5)) t(v)
LEFT JOIN reviews r ON r.product_id = p.product_id AND r.rating = v
GROUP BY ALL""".replace("SELECT product_id, v", "SELECT p.product_id AS product_id, v").replace(
    "FROM (SELECT DISTINCT product_id FROM reviews) p, (VALUES",
    "FROM (SELECT DISTINCT product_id FROM reviews) p CROSS JOIN (VALUES"))
def rating_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return insights.rating_distribution(facts.product_rollup(Facts(spark, sf).stored_months))


COVERAGE_SQL = """
cov AS (
  SELECT product_id, month, count(*) AS review_count, count(*) FILTER (WHERE in_sample) AS scope_total,
         count(*) FILTER (WHERE in_sample AND status = 'succeeded') AS succeeded,
         count(*) FILTER (WHERE in_sample AND status = 'failed') AS failed,
         count(*) FILTER (WHERE in_sample AND status IN ('pending', 'running')) AS in_progress,
         count(*) FILTER (WHERE in_sample AND review_id IN (SELECT review_id FROM labels)) AS labelled,
         sum(rating)::BIGINT AS rating_sum
  FROM rf GROUP BY ALL)
"""


@query(f"""WITH {sql_views()}, {COVERAGE_SQL}
SELECT product_id, month, scope_total AS total, succeeded, failed, in_progress, labelled,
       greatest(scope_total - succeeded - failed - in_progress, 0) AS unprocessed,
       {sql_rate('succeeded', 'scope_total')} AS processing_rate,
       {sql_status('scope_total', 'succeeded', 'failed', 'in_progress')} AS status
FROM cov""")
def coverage_by_month(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    parts = [c("scope_total"), c("succeeded"), c("failed"), c("in_progress")]
    return Facts(spark, sf).months.select(
        "product_id", month(), c("scope_total").alias("total"), "succeeded", "failed",
        "in_progress", "labelled", unprocessed(*parts).alias("unprocessed"),
        rate(c("succeeded"), c("scope_total")).alias("processing_rate"),
        period_status(*parts).alias("status"),
    )


@query(f"""WITH {sql_views("nation")}, {COVERAGE_SQL}
SELECT status, count(*) AS n FROM (
  SELECT {sql_status('scope_total', 'succeeded', 'failed', 'in_progress')} AS status FROM cov)
GROUP BY ALL""")
def period_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    status = period_status(c("scope_total"), c("succeeded"), c("failed"), c("in_progress"))
    return (
        Facts(spark, sf, "nation").months.groupBy(status.alias("status"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(f"""WITH {sql_views()}
SELECT product_id, polarity, count(DISTINCT review_id) AS review_count FROM lr GROUP BY ALL""")
def polarity_review_counts(spark: SparkSession, sf: str) -> DataFrame:
    over = facts.product_rollup(Facts(spark, sf).months)
    wide = over.select("product_id", *[F.col(f"{p}_reviews").alias(p) for p in POLARITIES])
    return facts.by_polarity(wide, ["product_id"])


@query(f"""WITH {sql_views()}
SELECT product_id, aspect, detail, polarity, count(DISTINCT review_id) AS review_count
FROM lr GROUP BY ALL""")
def label_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = facts.product_issues(Facts(spark, sf).rollup).drop("mentions")
    return facts.by_polarity(counts, ["product_id", *facts.ISSUE])


@query(f"""WITH {sql_views()}
SELECT product_id, aspect, detail, count(DISTINCT review_id) AS mentions FROM lr GROUP BY ALL""")
def mention_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = facts.product_issues(Facts(spark, sf).rollup)
    return counts.select("product_id", *facts.ISSUE, "mentions")


@query(f"""WITH {sql_views()}
SELECT product_id, month, aspect, detail, polarity, count(DISTINCT review_id) AS review_count
FROM lr GROUP BY ALL""")
def label_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    rollup = Facts(spark, sf).rollup.drop("mentions")
    long = facts.by_polarity(rollup, ["product_id", "month_idx", *facts.ISSUE])
    return long.withColumn("month", month()).drop("month_idx")


@query(f"""WITH {sql_views()}
SELECT DISTINCT product_id, month, aspect, detail, polarity, review_id FROM lr""")
def label_evidence_reviews(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts.issue_evidence(Facts(spark, sf).issue_facts)
    return rows.withColumn("month", month()).drop("month_idx")


@query(f"""WITH {sql_views()}
SELECT r.product_id, r.month, count(DISTINCT r.review_id) AS analyzed_count,
       count(DISTINCT CASE WHEN polarity = 'positive' THEN r.review_id END) AS positive_reviews,
       count(DISTINCT CASE WHEN polarity = 'negative' THEN r.review_id END) AS negative_reviews
FROM rf r LEFT JOIN labels l USING (review_id) WHERE r.status = 'succeeded' GROUP BY ALL""")
def monthly_analysis(spark: SparkSession, sf: str) -> DataFrame:
    return Facts(spark, sf).months.filter(F.col("succeeded") > 0).select(
        "product_id", month(), F.col("succeeded").alias("analyzed_count"), "positive_reviews",
        "negative_reviews",
    )


@query(f"""WITH {sql_views()},
n AS (SELECT product_id, count(*) AS n FROM rf WHERE status = 'succeeded' GROUP BY ALL),
c AS (SELECT product_id, aspect, detail, count(DISTINCT review_id) AS negative_count
      FROM lr WHERE polarity = 'negative' GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY product_id
                                   ORDER BY negative_count DESC, aspect, detail) AS rank FROM c)
SELECT product_id, CAST(rank AS INTEGER) AS rank, aspect, detail, negative_count,
       CAST(negative_count AS DOUBLE) / n AS negative_rate
FROM k JOIN n USING (product_id) WHERE rank <= 3""")
def top_complaints(spark: SparkSession, sf: str) -> DataFrame:
    f = Facts(spark, sf)
    return insights.top_complaints(insights.aspects(insights.overview(f.products, f.month_table), f.issue_table))


@query(f"""WITH {sql_views()},
one AS (SELECT product_id, aspect, detail, polarity, review_id, max(rating) AS rating,
               max(reviewed_at) AS reviewed_at, arg_min(evidence, label_id) AS evidence
        FROM lr GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY product_id, aspect, detail, polarity
                                   ORDER BY reviewed_at DESC, review_id) AS rank FROM one)
SELECT product_id, aspect, detail, polarity, review_id, rating,
       strftime(reviewed_at, '%Y-%m-%d') AS day, evidence, CAST(rank AS INTEGER) AS rank
FROM k WHERE rank <= 3""")
def label_examples_latest3(spark: SparkSession, sf: str) -> DataFrame:
    rows = insights.label_examples(Facts(spark, sf).label_rows)
    return rows.withColumn("day", F.date_format("reviewed_at", "yyyy-MM-dd")).drop("reviewed_at")


ASPECTS_SQL = f"""{sql_views()},
n AS (SELECT product_id, count(*) AS n FROM rf WHERE status = 'succeeded' GROUP BY ALL),
m AS (SELECT product_id, aspect, detail, count(DISTINCT review_id) AS mention_count,
        count(DISTINCT CASE WHEN polarity = 'positive' THEN review_id END) AS positive_count,
        count(DISTINCT CASE WHEN polarity = 'negative' THEN review_id END) AS negative_count,
        count(DISTINCT CASE WHEN polarity = 'neutral' THEN review_id END) AS neutral_count,
        count(DISTINCT CASE WHEN polarity = 'uncertain' THEN review_id END) AS uncertain_count
      FROM lr GROUP BY ALL)
SELECT m.*, CAST(mention_count AS DOUBLE) / n AS mention_rate,
       CAST(positive_count AS DOUBLE) / n AS positive_rate,
       CAST(negative_count AS DOUBLE) / n AS negative_rate
FROM m JOIN n USING (product_id)"""


@query(f"WITH {ASPECTS_SQL}")
def aspect_insights(spark: SparkSession, sf: str) -> DataFrame:
    f = Facts(spark, sf)
    return insights.aspects(insights.overview(f.products, f.month_table), f.issue_table)


@query(f"""WITH {ASPECTS_SQL.replace("SELECT m.*", ", asp AS (SELECT m.*")})
SELECT product_id, aspect, detail, mention_count, CAST(row_number() OVER (PARTITION BY product_id
  ORDER BY mention_count DESC, aspect, detail) AS INTEGER) AS rank FROM asp""")
def aspect_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Aspects in the order they are listed in."""
    return insights.ranked_aspects(aspect_insights(spark, sf)).select(
        "product_id", "aspect", "detail", "mention_count", "rank")


@query(f"""WITH {sql_views()}, {COVERAGE_SQL},
pos AS (SELECT product_id, count(DISTINCT CASE WHEN polarity = 'positive' THEN review_id END) AS p,
               count(DISTINCT CASE WHEN polarity = 'negative' THEN review_id END) AS n
        FROM lr GROUP BY ALL),
t AS (SELECT product_id, sum(review_count)::BIGINT AS review_count, sum(rating_sum) AS rating_sum,
             sum(succeeded)::BIGINT AS succeeded, sum(failed)::BIGINT AS failed,
             sum(in_progress)::BIGINT AS in_progress, sum(scope_total)::BIGINT AS analysis_total
      FROM cov GROUP BY ALL)
SELECT t.product_id, review_count, CAST(rating_sum AS DOUBLE) / review_count AS average_rating,
       analysis_total, succeeded, failed, in_progress,
       greatest(analysis_total - succeeded - failed - in_progress, 0) AS unprocessed,
       CAST(succeeded AS DOUBLE) / analysis_total AS processing_rate,
       {sql_status('analysis_total', 'succeeded', 'failed', 'in_progress')} AS analysis_status,
       CAST(p AS DOUBLE) / succeeded AS positive_share,
       CAST(n AS DOUBLE) / succeeded AS negative_share
FROM t LEFT JOIN pos USING (product_id)""")
def product_overview(spark: SparkSession, sf: str) -> DataFrame:
    f = Facts(spark, sf)
    over = insights.overview(f.products, f.months)
    return over.drop("run_id", "months", *[f"rating_{r}" for r in range(1, 6)])
