"""Month pairs, two-month comparisons, signals, statistics and the anomaly radar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.months import in_months
from tidemark.operators import compare, facts, statistics
from tidemark.plans import insights
from tidemark.plans.radar import radar, radar_items, radar_order, radar_summary
from workload.aggregates import COVERAGE_SQL
from workload.binding import RUN, Facts, sql_rate, sql_status, sql_views, table, timestamp
from workload.registry import query


@query(f"""WITH {sql_views()}, m AS (SELECT DISTINCT product_id, month FROM reviews)
SELECT * FROM (
  SELECT product_id, month AS baseline_month,
         lead(month) OVER (PARTITION BY product_id ORDER BY month) AS target_month FROM m)
WHERE target_month IS NOT NULL""")
def available_month_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return compare.with_month_keys(compare.consecutive_pairs(Facts(spark, sf).stored_months))


@query(f"""WITH {sql_views()},
m AS (SELECT product_id, date_trunc('month', reviewed_at) AS start, count(*) AS n
      FROM reviews GROUP BY ALL)
SELECT a.product_id, strftime(a.start, '%Y-%m') AS baseline_month, a.n AS baseline_count,
       strftime(b.start, '%Y-%m') AS target_month, b.n AS target_count, a.n + b.n AS total_count
FROM m a JOIN m b ON a.product_id = b.product_id AND b.start = a.start + INTERVAL 1 MONTH
WHERE a.n >= 30 AND b.n >= 30""")
def adjacent_month_candidates(spark: SparkSession, sf: str) -> DataFrame:
    pairs = compare.adjacent_dense_pairs(Facts(spark, sf).stored_months)
    return compare.with_month_keys(pairs).orderBy("total_count", "product_id", "baseline_month")


def pairs_sql(pairs: str) -> str:
    """``cp`` (coverage per pair) and ``iss`` (issues per pair) for a pair source."""
    side = "total, rating, scope, succeeded, failed, in_progress, labelled".split(", ")
    source = "review_count, rating_sum, scope_total, succeeded, failed, in_progress, labelled".split(", ")
    cols = ", ".join(
        f"coalesce({a}.{col}, 0) AS {p}_{name}"
        for a, p in (("t", "target"), ("b", "baseline"))
        for name, col in zip(side, source, strict=True)
    )
    status = {
        p: sql_status(f"{p}_scope", f"{p}_succeeded", f"{p}_failed", f"{p}_in_progress")
        for p in ("target", "baseline")
    }
    return f"""
pairs AS ({pairs}),
cp0 AS (SELECT p.*, {cols} FROM pairs p
  LEFT JOIN cov t ON t.product_id = p.product_id AND t.month = p.target_month
  LEFT JOIN cov b ON b.product_id = p.product_id AND b.month = p.baseline_month),
cp1 AS (SELECT *, {status['target']} AS target_status, {status['baseline']} AS baseline_status
        FROM cp0),
cp AS (SELECT *, target_total > 0 AND baseline_total > 0 AND target_status = 'complete'
              AND baseline_status = 'complete' AS complete,
              target_succeeded + baseline_succeeded > 0 AS any_succeeded FROM cp1),
lc AS (SELECT product_id, month, aspect, detail, polarity, count(DISTINCT review_id) AS n
       FROM lr GROUP BY ALL),
ti AS (SELECT p.product_id, baseline_month, target_month, aspect, detail, polarity, n
       FROM pairs p JOIN lc ON lc.product_id = p.product_id AND lc.month = p.target_month),
bi AS (SELECT p.product_id, baseline_month, target_month, aspect, detail, polarity, n
       FROM pairs p JOIN lc ON lc.product_id = p.product_id AND lc.month = p.baseline_month),
ij AS (SELECT product_id, baseline_month, target_month, aspect, detail, polarity,
              coalesce(ti.n, 0) AS target_count, coalesce(bi.n, 0) AS baseline_count
       FROM ti FULL OUTER JOIN bi
       USING (product_id, baseline_month, target_month, aspect, detail, polarity)),
ir AS (SELECT ij.*, target_succeeded AS target_total, baseline_succeeded AS baseline_total,
              {sql_rate('target_count', 'target_succeeded')} AS target_rate,
              {sql_rate('baseline_count', 'baseline_succeeded')} AS baseline_rate, complete
       FROM ij JOIN cp USING (product_id, baseline_month, target_month)
       WHERE cp.target_total > 0 AND cp.baseline_total > 0 AND any_succeeded),
iss AS (SELECT *, (target_rate - baseline_rate) * 100 AS change_pp,
  CASE WHEN complete THEN polarity = 'negative' AND least(target_total, baseline_total) >= 30
    AND target_count >= 5 AND coalesce((target_rate - baseline_rate) * 100 >= 10, FALSE) END
    AS meets_threshold FROM ir)
"""


CONSECUTIVE_SQL = """SELECT * FROM (SELECT product_id, month AS baseline_month,
  lead(month) OVER (PARTITION BY product_id ORDER BY month) AS target_month
  FROM (SELECT DISTINCT product_id, month FROM reviews)) WHERE target_month IS NOT NULL"""

LATEST_SQL = """SELECT product_id, min(month) AS baseline_month, max(month) AS target_month
  FROM (SELECT product_id, month, row_number() OVER (PARTITION BY product_id ORDER BY month DESC)
        AS k FROM (SELECT DISTINCT product_id, month FROM reviews)) WHERE k <= 2
  GROUP BY ALL HAVING count(*) = 2"""

ISSUE_COLUMNS = """product_id, baseline_month, target_month, aspect, detail, polarity,
  target_count, target_total, target_rate, baseline_count, baseline_total, baseline_rate,
  change_pp, meets_threshold, complete"""


@query(f"""WITH {sql_views()}, {COVERAGE_SQL}, {pairs_sql(CONSECUTIVE_SQL)}
SELECT {ISSUE_COLUMNS} FROM iss""")
def two_month_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return compare.with_month_keys(_issues(spark, sf))


def _issues(spark: SparkSession, sf: str) -> DataFrame:
    f = Facts(spark, sf)
    months = f.month_table
    covered = compare.coverage(compare.consecutive_pairs(months), months)
    return compare.issues(covered, f.issue_table)


@query(f"""WITH {sql_views()}, {COVERAGE_SQL}, {pairs_sql(CONSECUTIVE_SQL)}
SELECT product_id, baseline_month, target_month, aspect, detail, polarity, CAST(row_number() OVER (
  PARTITION BY product_id, baseline_month, target_month
  ORDER BY abs(change_pp) DESC NULLS LAST, aspect, detail, polarity) AS INTEGER) AS rank FROM iss""")
def issue_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Issues of every pair of months in the order they are listed in."""
    return compare.with_month_keys(compare.ranked_issues(_issues(spark, sf))).select(
        "product_id", "baseline_month", "target_month", "aspect", "detail", "polarity", "rank")


SIGNAL_SQL = """
  CASE WHEN target_total = 0 OR baseline_total = 0 THEN 'insufficient_data'
       WHEN NOT complete THEN 'analysis_incomplete'
       WHEN least(target_succeeded, baseline_succeeded) < 30 THEN 'insufficient_sample'
       WHEN coalesce(rising, FALSE) THEN 'increase_signal' ELSE 'no_increase_signal' END"""

OVERVIEW_SQL = f"""
SELECT product_id, baseline_month, target_month, target_total, baseline_total,
  target_labelled, baseline_labelled, target_succeeded, baseline_succeeded, target_failed,
  baseline_failed, target_in_progress, baseline_in_progress,
  {sql_rate('target_rating', 'target_total')} AS target_average_rating,
  {sql_rate('baseline_rating', 'baseline_total')} AS baseline_average_rating,
  greatest(target_scope - target_succeeded - target_failed - target_in_progress, 0)
    AS target_unprocessed,
  greatest(baseline_scope - baseline_succeeded - baseline_failed - baseline_in_progress, 0)
    AS baseline_unprocessed,
  {sql_rate('target_succeeded', 'target_scope')} AS target_processing_rate,
  {sql_rate('baseline_succeeded', 'baseline_scope')} AS baseline_processing_rate,
  target_status, baseline_status,
  CASE WHEN target_total = 0 OR baseline_total = 0 THEN 'insufficient_data'
       WHEN complete THEN 'ok' WHEN any_succeeded THEN 'partial' ELSE 'insufficient_data' END
    AS status,
  CASE WHEN 'partial_failure' IN (target_status, baseline_status) THEN 'partial_failure'
       WHEN target_status = 'complete' AND baseline_status = 'complete' THEN 'complete'
       WHEN any_succeeded OR 'in_progress' IN (target_status, baseline_status) THEN 'in_progress'
       ELSE 'not_started' END AS analysis_status,
  {SIGNAL_SQL} AS signal_status, NOT complete AS is_provisional
FROM cp LEFT JOIN (SELECT product_id, baseline_month, target_month,
                          bool_or(coalesce(meets_threshold, FALSE)) AS rising FROM iss GROUP BY ALL) s
USING (product_id, baseline_month, target_month)"""


def _signals(f: Facts, pairs: DataFrame, months: DataFrame) -> DataFrame:
    covered = compare.coverage(pairs, months)
    rows = compare.signals(covered, compare.issues(covered, f.issue_table))
    return compare.with_month_keys(rows).drop(
        "any_succeeded", "complete", "has_issues", "target_scope_total", "baseline_scope_total"
    )


@query(f"WITH {sql_views()}, {COVERAGE_SQL}, {pairs_sql(CONSECUTIVE_SQL)} {OVERVIEW_SQL}")
def comparison_signal(spark: SparkSession, sf: str) -> DataFrame:
    f = Facts(spark, sf)
    months = f.month_table
    return _signals(f, compare.consecutive_pairs(months), months)


@query(f"""WITH {sql_views("nation")}, {COVERAGE_SQL}, {pairs_sql(CONSECUTIVE_SQL)}
{OVERVIEW_SQL}""")
def comparison_signal_sparse(spark: SparkSession, sf: str) -> DataFrame:
    f = Facts(spark, sf, "nation")
    months = f.month_table
    return _signals(f, compare.consecutive_pairs(months), months)


CHOSEN_SQL = """SELECT DISTINCT product_id, '1997-03' AS baseline_month, '1997-09' AS target_month
  FROM customer JOIN (SELECT DISTINCT product_id FROM reviews) ON c_mktsegment = product_id"""


@query(f"WITH {sql_views()}, {COVERAGE_SQL}, {pairs_sql(CHOSEN_SQL)} {OVERVIEW_SQL}")
def chosen_months_signal(spark: SparkSession, sf: str) -> DataFrame:
    f = Facts(spark, sf)
    return _signals(f, compare.chosen_pair(f.products, "1997-03", "1997-09"), f.month_table)


@query(f"""WITH {sql_views()}, {COVERAGE_SQL}, {pairs_sql(LATEST_SQL)},
k AS (SELECT *, row_number() OVER (PARTITION BY product_id
                                   ORDER BY change_pp DESC, aspect, detail) AS rank
      FROM iss WHERE polarity = 'negative' AND change_pp > 0)
SELECT product_id, baseline_month, target_month, aspect, detail, target_count, baseline_count,
       target_rate, baseline_rate, change_pp, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3""")
def latest_change_top3(spark: SparkSession, sf: str) -> DataFrame:
    f = Facts(spark, sf)
    months = f.month_table
    covered = compare.coverage(compare.latest_pair(months), months)
    rows = compare.top_increases(compare.issues(covered, f.issue_table))
    return compare.with_month_keys(rows).drop(
        "polarity", "target_total", "baseline_total", "meets_threshold", "complete"
    )


@query(f"""WITH {sql_views()}, pairs AS ({LATEST_SQL})
SELECT DISTINCT p.product_id, baseline_month, target_month, aspect, detail, polarity, review_id
FROM pairs p JOIN lr ON lr.product_id = p.product_id
 AND (lr.month = p.target_month OR lr.month = p.baseline_month)""")
def latest_pair_evidence(spark: SparkSession, sf: str) -> DataFrame:
    f = Facts(spark, sf)
    pairs = compare.latest_pair(f.stored_months)
    rows = compare.evidence_rows(pairs, facts.issue_evidence(f.issue_facts))
    return compare.with_month_keys(rows)


@query(f"""WITH {sql_views()}
SELECT product_id, month, count(*) AS review_count, avg(rating) AS average_rating,
  count(*) FILTER (WHERE status = 'succeeded') AS analyzed_count,
  {sql_rate("count(*) FILTER (WHERE status = 'succeeded' AND review_id IN (SELECT review_id FROM labels WHERE polarity = 'positive'))",
            "count(*) FILTER (WHERE status = 'succeeded')")} AS positive_review_share,
  {sql_rate("count(*) FILTER (WHERE status = 'succeeded' AND review_id IN (SELECT review_id FROM labels WHERE polarity = 'negative'))",
            "count(*) FILTER (WHERE status = 'succeeded')")} AS negative_review_share
FROM rf GROUP BY ALL""")
def monthly_insights(spark: SparkSession, sf: str) -> DataFrame:
    return insights.monthly(Facts(spark, sf).months)


# --- statistics ------------------------------------------------------------------

# the upper hypergeometric tail, term by term
FISHER_SQL = """
CASE WHEN bt = 0 OR tt = 0 OR b + t = 0 THEN 1.0 ELSE least(1.0, list_sum(list_transform(
  range(t, least(b + t, tt) + 1),
  lambda k: exp(lgamma(b + t + 1) - lgamma(k + 1) - lgamma(b + t - k + 1)
     + lgamma(bt + tt - b - t + 1) - lgamma(tt - k + 1) - lgamma(bt - b - t + k + 1)
     - lgamma(bt + tt + 1) + lgamma(tt + 1) + lgamma(bt + 1))))) END"""

TESTS_SQL = f"""
tests AS (SELECT *, baseline_count AS b, baseline_total AS bt, target_count AS t,
                 target_total AS tt FROM iss
          WHERE polarity = 'negative' AND least(baseline_total, target_total) >= 10),
ps AS (SELECT *, {FISHER_SQL} AS p FROM tests),
-- equal count tables share one p
pd AS (SELECT round(p, 12) AS rp, count(*) AS n, min(p) AS p FROM ps GROUP BY ALL),
pr AS (SELECT *, sum(n) OVER (ORDER BY rp) AS rk, sum(n) OVER () AS m FROM pd),
pq AS (SELECT rp, least(1.0, min(p * m / rk) OVER (ORDER BY rp DESC)) AS q FROM pr),
qs AS (SELECT ps.*, q FROM ps JOIN pq ON round(ps.p, 12) = pq.rp)
"""


@query(f"""WITH {sql_views("nation")}, {COVERAGE_SQL}, {pairs_sql(CONSECUTIVE_SQL)}, {TESTS_SQL}
SELECT DISTINCT b AS baseline_count, bt AS baseline_total, t AS target_count, tt AS target_total,
       round(p, 9) AS p_value FROM ps""")
def fisher_p(spark: SparkSession, sf: str) -> DataFrame:
    f = Facts(spark, sf, "nation")
    tests = radar(f.month_table, f.issue_table).tests
    return tests.select(*statistics.FISHER_COUNTS, F.round("p_value", 9).alias("p_value")).distinct()


@query(f"""WITH {sql_views()}, {COVERAGE_SQL}, {pairs_sql(CONSECUTIVE_SQL)}, {TESTS_SQL}
SELECT product_id, baseline_month, target_month, aspect, detail, round(p, 9) AS p_value,
       round(q, 9) AS q_value FROM qs""")
def bh_qvalues(spark: SparkSession, sf: str) -> DataFrame:
    f = Facts(spark, sf)
    tests = radar(f.month_table, f.issue_table).tests
    return compare.with_month_keys(tests).select(
        "product_id", "baseline_month", "target_month", "aspect", "detail",
        F.round("p_value", 9).alias("p_value"), F.round("q_value", 9).alias("q_value"),
    )


LEVEL_SQL = """CASE WHEN q < 0.10 AND change_pp >= 10 AND target_count >= 3 THEN 'anomaly'
  WHEN p < 0.05 AND change_pp > 0 THEN 'watch' END"""


def radar_sql(views: str, more: str = "") -> str:
    return f"""WITH {views}, {COVERAGE_SQL}, {pairs_sql(CONSECUTIVE_SQL)}, {TESTS_SQL},
lv AS (SELECT *, {LEVEL_SQL} AS level FROM qs),
ev AS (SELECT v.product_id, v.baseline_month, v.target_month, v.aspect, v.detail, lr.review_id,
         row_number() OVER (PARTITION BY v.product_id, v.baseline_month, v.target_month, v.aspect,
                            v.detail ORDER BY lr.review_id) AS k
       FROM lv v JOIN (SELECT DISTINCT product_id, month, aspect, detail, review_id FROM lr
                       WHERE polarity = 'negative') lr
       ON lr.product_id = v.product_id AND lr.aspect = v.aspect AND lr.detail = v.detail
          AND (lr.month = v.target_month OR lr.month = v.baseline_month)
       WHERE v.level IS NOT NULL),
ea AS (SELECT product_id, baseline_month, target_month, aspect, detail,
              string_agg(CAST(review_id AS VARCHAR), ',' ORDER BY review_id) AS evidence_review_ids
       FROM ev WHERE k <= 5 GROUP BY ALL)
SELECT level, product_id, baseline_month, target_month, aspect, detail, baseline_count,
       baseline_total, target_count, target_total, baseline_rate, target_rate, change_pp,
       round(p, 5) AS p_value, round(q, 5) AS q_value, NOT complete AS is_provisional,
       evidence_review_ids{more}
FROM lv LEFT JOIN ea USING (product_id, baseline_month, target_month, aspect, detail)
WHERE level IS NOT NULL"""


@query(radar_sql(sql_views()))
def anomaly_radar(spark: SparkSession, sf: str) -> DataFrame:
    f = Facts(spark, sf)
    parts = radar(f.month_table, f.issue_table)
    rows = radar_items(parts, evidence=facts.issue_evidence(f.issue_facts))
    ids = F.array_join(F.col("evidence_review_ids").cast("array<string>"), ",")
    return compare.with_month_keys(rows).withColumn("evidence_review_ids", ids)


# one product, quarters for months, groups of brands for issues: dense enough for every data size
DENSE_SQL = (
    sql_views()
    .replace("c_mktsegment AS product_id", "'all' AS product_id")
    .replace("o_orderdate AS reviewed_at", "date_trunc('quarter', o_orderdate) AS reviewed_at")
    .replace("strftime(o_orderdate, '%Y-%m')", "strftime(date_trunc('quarter', o_orderdate), '%Y-%m')")
    .replace("p_type AS aspect, p_brand AS detail", "'brand' AS aspect, substr(p_brand, 1, 7) AS detail")
    .replace("CASE l_returnflag WHEN 'R' THEN 'negative' WHEN 'A' THEN 'positive' ELSE 'neutral' END",
             "CASE WHEN l_returnflag = 'R' OR o_orderdate >= TIMESTAMP '1998-01-01' THEN 'negative' ELSE 'positive' END")
    .replace("JOIN part ON l_partkey = p_partkey)", "JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey)")
)


def dense_facts(spark: SparkSession, sf: str) -> Facts:
    """Returned line items, and all from 1998 on, count as negative, so that their start stands out."""
    f = Facts(spark, sf)
    f.reviews = f.reviews.withColumns({
        "product_id": F.lit("all"), "reviewed_at": F.date_trunc("quarter", "reviewed_at")})
    c = F.col
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", c("p_name").alias("evidence"))
    dates = table(spark, sf, "orders").select("o_orderkey", timestamp("o_orderdate").alias("at"))
    lines = table(spark, sf, "lineitem").join(parts, c("l_partkey") == c("p_partkey")).join(
        dates, c("o_orderkey") == c("l_orderkey"))
    f.labels = lines.select(
        F.lit(RUN).alias("run_id"), c("l_orderkey").alias("review_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("label_id"),
        F.when((c("l_returnflag") == "R") | (c("at") >= F.lit("1998-01-01").cast("timestamp")), "negative")
        .otherwise("positive").alias("polarity"),
        F.lit("brand").alias("aspect"), F.substring("p_brand", 1, 7).alias("detail"), "evidence")
    f.scoped = facts.run_reviews(f.reviews, RUN)
    return f


@query(radar_sql(DENSE_SQL, """, CAST(row_number() OVER (PARTITION BY product_id ORDER BY level,
       round(q, 5), round(change_pp, 9) DESC, baseline_month, target_month, aspect, detail) AS INTEGER) AS rank"""))
def anomaly_radar_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: ranked radar rows of the dense binding, anomalies first."""
    f = dense_facts(spark, sf)
    parts = radar(f.month_table, f.issue_table)
    rows = radar_items(parts, evidence=facts.issue_evidence(f.issue_facts))
    place = Window.partitionBy("product_id").orderBy(
        *radar_order(), "baseline_idx", "target_idx", *facts.ISSUE)
    ids = F.array_join(F.col("evidence_review_ids").cast("array<string>"), ",")
    rounded = rows.withColumn("_change", F.col("change_pp")).withColumn("change_pp", F.round("change_pp", 9))
    ranked = rounded.withColumn("rank", F.row_number().over(place)).withColumn(
        "change_pp", F.col("_change")).drop("_change")
    return compare.with_month_keys(ranked).withColumn("evidence_review_ids", ids)


@query(f"""WITH {sql_views("nation")}, {COVERAGE_SQL}, {pairs_sql(CONSECUTIVE_SQL)},
sx AS (SELECT *, least(baseline_succeeded, target_succeeded) >= 10 AS sufficient FROM cp)
SELECT (SELECT count(*) FROM nation) AS products_total,
       count(DISTINCT product_id) FILTER (WHERE sufficient) AS products_evaluable,
       count(*) FILTER (WHERE sufficient) AS pairs_evaluated,
       count(*) FILTER (WHERE NOT sufficient) AS pairs_insufficient,
       (SELECT count(*) FROM iss WHERE polarity = 'negative'
         AND least(baseline_total, target_total) >= 10) AS tests FROM sx""")
def anomaly_radar_summary(spark: SparkSession, sf: str) -> DataFrame:
    f = Facts(spark, sf, "nation")
    return radar_summary(radar(f.month_table, f.issue_table), f.products)


# --- runs and periods ------------------------------------------------------------

# segments are source modes here: orders are runs, price bands tell the active ones
ACTIVE_SQL = """
SELECT c_mktsegment AS source_mode, o_orderkey AS run_id, o_orderdate AS created_at,
       o_orderstatus = 'F' AS is_active
FROM orders JOIN customer ON o_custkey = c_custkey"""


@query(f"""SELECT source_mode, run_id FROM (
  SELECT source_mode, run_id, row_number() OVER (PARTITION BY source_mode
    ORDER BY created_at DESC, run_id DESC) AS k FROM ({ACTIVE_SQL}) WHERE is_active) WHERE k = 1""")
def active_run(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    runs = table(spark, sf, "orders").join(
        customers, F.col("o_custkey") == F.col("c_custkey")
    ).select(
        F.col("c_mktsegment").alias("source_mode"), F.col("o_orderkey").alias("run_id"),
        F.col("o_orderdate").alias("created_at"), (F.col("o_orderstatus") == "F").alias("is_active"),
    )
    return facts.active_runs(runs)


@query(f"""WITH {sql_views()}
SELECT product_id, CAST(count(*) AS BIGINT) AS review_count, avg(rating) AS average_rating
FROM reviews WHERE (reviewed_at >= TIMESTAMP '1997-02-01' AND reviewed_at < TIMESTAMP '1997-04-01')
   OR (reviewed_at >= TIMESTAMP '1999-12-01' AND reviewed_at < TIMESTAMP '2000-01-01')
GROUP BY ALL""")
def period_review_counts(spark: SparkSession, sf: str) -> DataFrame:
    chosen = Facts(spark, sf).reviews.filter(
        in_months(F.col("reviewed_at"), ["1997-02", "1999-12", "1997-03"])
    )
    return facts.stored_months(chosen).groupBy("product_id").agg(
        F.sum("review_count").alias("review_count"),
        (F.sum("rating_sum") / F.sum("review_count")).alias("average_rating"),
    )


