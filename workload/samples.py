"""Quotas, samples, processing orders and sampled coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.months import key_of_index
from tidemark.functions.rates import period_status
from tidemark.functions.text import is_hard_case
from tidemark.operators import sampling
from tidemark.plans import jobs
from workload.aggregates import COVERAGE_SQL
from workload.binding import Facts, sql_status, sql_views, table
from workload.registry import query

SIZE = 100
SEED = "fixed-sample-v1"


def sizes(f: Facts) -> DataFrame:
    """Target sizes: a hundred, or everything for the product named BUILDING."""
    size = F.when(F.col("product_id") != "BUILDING", F.lit(SIZE))
    return f.products.select("product_id", size.alias("sample_size"))


def nation_sizes(f: Facts) -> DataFrame:
    """Target sizes 10, 20, ... by nation."""
    return f.products.select(
        "product_id", (F.col("product_id").cast("int") * 10 + 10).alias("sample_size")
    )


def sample_sql(size: str) -> str:
    return f"""
mc AS (SELECT product_id, month, count(*) AS n FROM reviews GROUP BY ALL),
mt AS (SELECT *, CAST(sum(n) OVER (PARTITION BY product_id) AS BIGINT) AS total,
              {size} AS sample_size FROM mc),
mq AS (SELECT *, CASE WHEN sample_size IS NULL OR sample_size >= total THEN n
                 ELSE least(n, CAST((sample_size * n + total - 1) // total AS BIGINT)) END AS quota
       FROM mt),
sr AS (SELECT r.*, q.n, q.quota, q.sample_size,
              row_number() OVER (PARTITION BY r.product_id, r.month
                ORDER BY sha256('processing-order|' || r.review_id), r.review_id) AS rank
       FROM reviews r JOIN mq q USING (product_id, month)),
sm AS (SELECT *, (rank - 0.5) / quota AS position FROM sr WHERE rank <= quota)
"""


SEGMENT_SIZE = f"CASE WHEN product_id <> 'BUILDING' THEN {SIZE} END"
NATION_SIZE = "CAST(product_id AS INTEGER) * 10 + 10"


@query(f"""WITH {sql_views()}, {sample_sql(SEGMENT_SIZE)}
SELECT product_id, month, n, total, quota FROM mq""")
def sample_quota(spark: SparkSession, sf: str) -> DataFrame:
    f = Facts(spark, sf)
    counts = f.stored_months.select("product_id", "month_idx", F.col("review_count").alias("n"))
    return sampling.month_quotas(counts.join(sizes(f), "product_id")).select(
        "product_id", key_of_index(F.col("month_idx")).alias("month"), "n", "total", "quota"
    )


@query(f"""WITH {sql_views()}, {sample_sql(SEGMENT_SIZE)}
SELECT product_id, month, review_id, rank FROM sm""")
def sample_members(spark: SparkSession, sf: str) -> DataFrame:
    f = Facts(spark, sf)
    return sampling.month_sample(f.reviews, sizes(f)).select(
        "product_id", key_of_index(F.col("month_idx")).alias("month"), "review_id", "rank"
    )


@query(f"""WITH {sql_views("nation")}, {sample_sql(NATION_SIZE)}
SELECT product_id, review_id, position, process_rank,
  CASE WHEN process_rank <= least(20, sample_size) THEN 1
       WHEN process_rank <= least(30, sample_size) THEN 2
       WHEN process_rank <= least(50, sample_size) THEN 3
       WHEN process_rank <= least(70, sample_size) THEN 4
       WHEN process_rank <= least(100, sample_size) THEN 5 ELSE 6 END AS stage
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY product_id ORDER BY position, month, review_id)
                AS INTEGER) AS process_rank FROM sm)""")
def staged_prefix(spark: SparkSession, sf: str) -> DataFrame:
    f = Facts(spark, sf, "nation")
    chosen = nation_sizes(f)
    staged = sampling.staged_sample(
        sampling.month_sample(f.reviews, chosen).drop("sample_size"), chosen
    )
    return staged.select("product_id", "review_id", "position", "process_rank", "stage")


@query(f"""WITH {sql_views()}
SELECT product_id, month, review_id,
  row_number() OVER (PARTITION BY product_id, month
    ORDER BY sha256('processing-order|' || review_id), review_id) AS rank
FROM reviews WHERE month IN ('1996-05', '1996-06', '1996-11')""")
def round_robin_months(spark: SparkSession, sf: str) -> DataFrame:
    ranked = sampling.product_month_order(
        Facts(spark, sf).reviews, ["1996-11", "1996-05", "1996-06"]
    )
    return ranked.select(
        "product_id", key_of_index(F.col("month_idx")).alias("month"), "review_id", "rank"
    )


@query(f"""WITH {sql_views()}, {sample_sql(SEGMENT_SIZE)},
srf AS (SELECT rf.* EXCLUDE (in_sample), rf.review_id IN (SELECT review_id FROM sm) AS in_sample
        FROM rf),
{COVERAGE_SQL.replace("FROM rf", "FROM srf")}
SELECT product_id, month, review_count, scope_total, succeeded, failed, in_progress, labelled,
  {sql_status('scope_total', 'succeeded', 'failed', 'in_progress')} AS status FROM cov""")
def sampled_coverage(spark: SparkSession, sf: str) -> DataFrame:
    f = Facts(spark, sf)
    sampled = Facts(spark, sf, sample=sampling.month_sample(f.reviews, sizes(f)))
    c = F.col
    return sampled.months.select(
        "product_id", key_of_index(c("month_idx")).alias("month"), "review_count", "scope_total",
        "succeeded", "failed", "in_progress", "labelled",
        period_status(c("scope_total"), c("succeeded"), c("failed"), c("in_progress"))
        .alias("status"),
    )


def greedy_sql(name: str, pool: str, seed: str, size: int, exclude: str = "") -> str:
    """Picks ``name`` (product_id, review_id, rating, month, turn) of a pool, a turn depending on those before it."""
    rest = f"WHERE review_id NOT IN (SELECT review_id FROM {exclude})" if exclude else ""
    return f"""
{name}_offer AS (
  SELECT p.*, t.turn, sha256('{seed}:' || product_id || ':' || t.turn || '|' || review_id) AS h
  FROM (SELECT product_id, review_id, rating, month FROM {pool} {rest}) p, range(0, {size}) AS t(turn)),
{name}_turn(product_id, turn, ids, months, best) AS (
  SELECT DISTINCT product_id, CAST(-1 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS VARCHAR[]),
    CAST(NULL AS STRUCT(other BOOLEAN, load BIGINT, h VARCHAR, review_id BIGINT, rating INTEGER, month VARCHAR))
  FROM {name}_offer
  UNION ALL
  SELECT product_id, turn, list_append(ids, best.review_id), list_append(months, best.month), best FROM (
    SELECT o.product_id, o.turn, any_value(p.ids) AS ids, any_value(p.months) AS months, min(CAST(struct_pack(
        other := o.rating <> 1 + o.turn % 5, load := len(list_filter(p.months, lambda m: m = o.month)), h := o.h,
        review_id := o.review_id, rating := o.rating, month := o.month)
      AS STRUCT(other BOOLEAN, load BIGINT, h VARCHAR, review_id BIGINT, rating INTEGER, month VARCHAR))) AS best
    FROM {name}_turn p JOIN {name}_offer o ON o.product_id = p.product_id AND o.turn = p.turn + 1
    WHERE NOT list_contains(p.ids, o.review_id) GROUP BY ALL)),
{name} AS (SELECT product_id, best.review_id AS review_id, best.rating AS rating, best.month AS month,
             CAST(turn AS INTEGER) AS turn FROM {name}_turn WHERE turn >= 0)"""


@query(f"""WITH RECURSIVE {sql_views()}, {greedy_sql("picks", "reviews", SEED, 5)} SELECT * FROM picks""")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    picks = sampling.stratified_sample(Facts(spark, sf).reviews, 5, SEED)
    return picks.withColumn("month", key_of_index(F.col("month_idx"))).drop("month_idx")


SUMMARY_SQL = """SELECT 'total' AS dimension, 'all' AS value, count(*) AS n FROM s
UNION ALL SELECT 'category', category, count(*) FROM s GROUP BY ALL
UNION ALL SELECT 'product_id', product_id, count(*) FROM s GROUP BY ALL
UNION ALL SELECT 'rating', CAST(rating AS VARCHAR), count(*) FROM s GROUP BY ALL
UNION ALL SELECT 'month', month, count(*) FROM s GROUP BY ALL"""


@query(f"""WITH RECURSIVE {sql_views()}, {greedy_sql("one", "reviews", SEED, 5)},
{greedy_sql("two", "reviews", "second-sample-v1", 10, "one")},
s AS (SELECT 'all' AS category, * FROM two) {SUMMARY_SQL}""")
def stratified_sample_independent(spark: SparkSession, sf: str) -> DataFrame:
    """A second sample that shares no review with the first, with its summary."""
    reviews = Facts(spark, sf).reviews
    first = sampling.stratified_sample(reviews, 5, SEED)
    second = sampling.stratified_sample(reviews, 10, "second-sample-v1", exclude=first)
    named = second.select(
        F.lit("all").alias("category"), "product_id", "rating",
        key_of_index(F.col("month_idx")).alias("month"),
    )
    return sampling.sample_summary(named)


# Documents as reviews: the language is the product, the quality of the text's length the rating; every tenth
# text is preceded by words that are easy to misread.
DOCUMENT_REVIEWS_SQL = """
dr AS (SELECT lang AS product_id, doc_id AS review_id, CAST(1 + n_chars % 5 AS INTEGER) AS rating,
         strftime(DATE '2024-01-01' + CAST(doc_id % 170 AS INTEGER), '%Y-%m') AS month,
         CASE WHEN doc_id % 10 = 0 THEN 'It never worked: ' WHEN doc_id % 10 = 1 THEN 'Fine, notable. ' ELSE '' END
           || source AS title FROM documents)
"""


def _document_reviews(spark: SparkSession, sf: str) -> DataFrame:
    last = F.pmod("doc_id", F.lit(10))
    before = F.when(last == 0, "It never worked: ").when(last == 1, "Fine, notable. ").otherwise("")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(170)).cast("int"))
    return table(spark, sf, "documents").select(
        F.col("lang").alias("product_id"), F.col("doc_id").alias("review_id"),
        (1 + F.pmod("n_chars", F.lit(5))).cast("int").alias("rating"), day.cast("timestamp").alias("reviewed_at"),
        F.lit(True).alias("eligible"), F.lit(None).cast("string").alias("title"),
        F.concat(before, "source").alias("text"))


@query(f"""WITH RECURSIVE {DOCUMENT_REVIEWS_SQL}, {greedy_sql("trial", "dr", "trial-v1", 5)},
{greedy_sql("evaluation", "dr", "evaluation-v1", 10, "trial")},
used AS (SELECT review_id FROM trial UNION ALL SELECT review_id FROM evaluation),
{greedy_sql("third", "dr", "hard-cases-v1", 5, "used")}
SELECT 'trial' AS sample, product_id, review_id, turn FROM trial
UNION ALL SELECT 'evaluation', product_id, review_id, turn FROM evaluation
UNION ALL SELECT 'hard_cases', t.product_id, review_id, turn FROM third t JOIN dr USING (review_id)
WHERE dr.title LIKE 'It never worked%'""")
def evaluation_samples(spark: SparkSession, sf: str) -> DataFrame:
    """The development and evaluation samples and the hard cases of a third draw, all disjoint."""
    drawn = jobs.evaluation_samples(_document_reviews(spark, sf))
    return reduce(DataFrame.unionByName, [
        rows.select(F.lit(name).alias("sample"), "product_id", "review_id", "turn")
        for name, rows in (("trial", drawn.trial), ("evaluation", drawn.evaluation), ("hard_cases", drawn.hard_cases))])


@query(f"""WITH {sql_views("nation")}, {sample_sql(NATION_SIZE)},
s AS (SELECT r_name AS category, product_id, rating, month FROM sm
      JOIN nation ON CAST(n_nationkey AS VARCHAR) = product_id
      JOIN region ON n_regionkey = r_regionkey)
SELECT 'total' AS dimension, 'all' AS value, count(*) AS n FROM s
UNION ALL SELECT 'category', category, count(*) FROM s GROUP BY ALL
UNION ALL SELECT 'product_id', product_id, count(*) FROM s GROUP BY ALL
UNION ALL SELECT 'rating', CAST(rating AS VARCHAR), count(*) FROM s GROUP BY ALL
UNION ALL SELECT 'month', month, count(*) FROM s GROUP BY ALL""")
def sample_summary(spark: SparkSession, sf: str) -> DataFrame:
    f = Facts(spark, sf, "nation")
    sample = sampling.month_sample(f.reviews, nation_sizes(f))
    rows = (
        sample.join(f.reviews.select("review_id", "rating"), "review_id")
        .join(f.products.select("product_id", "category"), "product_id")
        .select("category", "product_id", "rating",
                key_of_index(F.col("month_idx")).alias("month"))
    )
    return sampling.sample_summary(rows)


@query(f"""WITH {sql_views()}, {sample_sql(SEGMENT_SIZE)}
SELECT count(DISTINCT review_id) AS overlap FROM sm
WHERE review_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""")
def sample_overlap(spark: SparkSession, sf: str) -> DataFrame:
    f = Facts(spark, sf)
    sample = sampling.month_sample(f.reviews, sizes(f))
    other = table(spark, sf, "orders").filter(F.col("o_orderstatus") == "P").select(
        F.col("o_orderkey").alias("review_id")
    )
    return sampling.overlap(sample, other)


# the invented prose has none of the default words; these occur in it
HARD_WORDS = "with|mit|pour|sobres?"


@query(f"""SELECT doc_id FROM documents
WHERE regexp_matches(coalesce(source, '') || ' ' || text,
  '(?i)(^|[^\\p{{L}}\\p{{N}}_])({HARD_WORDS})($|[^\\p{{L}}\\p{{N}}_])')""")
def hard_cases(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    hard = is_hard_case(F.col("source"), F.col("text"), rf"\b({HARD_WORDS})\b")
    return documents.filter(hard).select("doc_id")


@query(f"""WITH {sql_views("nation")}
SELECT r_name AS category, product_id, reviewed_at, review_id FROM reviews
JOIN nation ON CAST(n_nationkey AS VARCHAR) = product_id JOIN region ON n_regionkey = r_regionkey""")
def official_review_order(spark: SparkSession, sf: str) -> DataFrame:
    f = Facts(spark, sf, "nation")
    return sampling.official_order(f.reviews, f.products).select(
        "category", "product_id", F.col("reviewed_at").cast("timestamp_ntz").alias("reviewed_at"),
        "review_id",
    )
