"""Remaining report queries: names, snapshots, translations, run summaries, sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import answers, evaluation, merge, quality, runs
from tidemark.plans import insights
from workload.binding import Facts, sql_views, table
from workload.listings import QUESTIONS_SQL, _question_facts
from workload.quality import evaluations
from workload.registry import query


def part_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    """Issue names from the part table; one brand is left without a name."""
    part = table(spark, sf, "part").filter(F.col("p_brand") != "Brand#7")
    return part.select(
        F.lit("all").alias("category"), F.col("p_type").alias("aspect"),
        F.col("p_brand").alias("detail"), F.lower("p_type").alias("aspect_name"),
        F.upper("p_brand").alias("detail_name"),
    ).distinct()


@query(f"""WITH {sql_views()},
t AS (SELECT DISTINCT p_type AS aspect, p_brand AS detail, lower(p_type) AS aspect_name,
        upper(p_brand) AS detail_name FROM part WHERE p_brand <> 'Brand#7'),
m AS (SELECT product_id, aspect, detail, count(DISTINCT review_id) AS mention_count FROM lr GROUP BY ALL)
SELECT product_id, aspect, detail, aspect_name, detail_name, mention_count
FROM m LEFT JOIN t USING (aspect, detail)""")
def aspect_names(spark: SparkSession, sf: str) -> DataFrame:
    f = Facts(spark, sf)
    rows = insights.aspects(insights.overview(f.products, f.month_table), f.issue_table)
    named = insights.with_names(
        rows.withColumn("category", F.lit("all")), part_taxonomy(spark, sf)
    )
    return named.select("product_id", "aspect", "detail", "aspect_name", "detail_name", "mention_count")


@query(f"""WITH {sql_views()}
SELECT product_id, 'run-1' AS current_version, count(*) FILTER (WHERE status = 'succeeded')
  AS current_count FROM rf GROUP BY ALL""")
def analysis_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    f = Facts(spark, sf)
    return answers.analysis_snapshot(f.products, f.months)


def translated(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews by nation; orders in process have no translation yet."""
    reviews = Facts(spark, sf, "nation").reviews
    status = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("review_id"),
        F.when(F.col("o_orderstatus") != "P", F.lit("done")).alias("text_ko"),
    )
    return reviews.join(status, "review_id")


@query(f"""WITH {sql_views("nation")}
SELECT product_id, review_id FROM reviews JOIN orders ON o_orderkey = review_id
JOIN nation ON CAST(n_nationkey AS VARCHAR) = product_id JOIN region ON n_regionkey = r_regionkey
WHERE o_orderstatus = 'P' AND r_name = 'ASIA'""")
def pending_translations(spark: SparkSession, sf: str) -> DataFrame:
    products = Facts(spark, sf, "nation").products
    return quality.pending_translations(translated(spark, sf), products, "ASIA").select(
        "product_id", "review_id"
    )


@query("""SELECT count(*) AS reviews, count(*) FILTER (WHERE o_orderstatus <> 'P') AS translated
FROM orders JOIN customer ON o_custkey = c_custkey""")
def translation_totals(spark: SparkSession, sf: str) -> DataFrame:
    return runs.translation_totals(translated(spark, sf))


@query("""
WITH e AS (SELECT o_orderkey AS review_id, o_orderstatus AS s,
             CAST(floor(o_totalprice) AS BIGINT) AS d FROM orders),
l AS (SELECT l_orderkey AS review_id, count(*) FILTER (WHERE l_returnflag = 'A') AS a,
        count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY ALL)
SELECT count(*) AS sample_size,
  count(*) FILTER (WHERE s = 'F') AS baseline_succeeded,
  count(*) FILTER (WHERE s = 'O') AS baseline_failed,
  count(*) FILTER (WHERE s <> 'P') AS improved_succeeded,
  count(*) FILTER (WHERE s = 'P') AS improved_failed_or_incomplete,
  round(avg(d) FILTER (WHERE s <> 'P'), 1) AS baseline_mean_duration_final,
  round(avg(d) FILTER (WHERE s = 'F'), 1) AS baseline_mean_duration_succeeded,
  round(avg(d + 1) FILTER (WHERE s <> 'P'), 1) AS improved_mean_duration,
  count(*) FILTER (WHERE s <> 'P' AND coalesce(a, 0) + coalesce(r, 0) > 0) AS changed_count
FROM e LEFT JOIN l USING (review_id)""")
def run_pair_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Order status decides both outcomes; accepted and returned lines are the labels."""
    orders = table(spark, sf, "orders").filter(F.col("o_orderstatus") != "P").select(
        F.col("o_orderkey").alias("review_id"), "o_orderstatus",
        F.floor("o_totalprice").alias("duration_ms"),
    )
    failed = F.when(F.col("o_orderstatus") == "O", "failed").otherwise("succeeded")
    results = orders.select(
        "review_id", F.lit("A").alias("run_id"), failed.alias("status"), "duration_ms"
    ).unionByName(orders.select(
        "review_id", F.lit("R").alias("run_id"), F.lit("succeeded").alias("status"),
        (F.col("duration_ms") + 1).alias("duration_ms"),
    ))
    labels = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("review_id"), F.col("l_returnflag").alias("run_id"),
        F.col("l_returnflag").alias("aspect"), F.col("l_linestatus").alias("detail"),
        F.lit("neutral").alias("polarity"), F.lit("").alias("evidence"),
    )
    sample = table(spark, sf, "orders").select(F.col("o_orderkey").alias("review_id"))
    return runs.comparison_summary(runs.compare_runs(sample, results, labels, "A", "R"))


@query("""SELECT c_custkey AS run_id, c_mktsegment AS model FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE c_mktsegment <> 'BUILDING' OR n_regionkey <> 2""")
def run_version_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as runs: expected are the BUILDING segment and one region."""
    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    rows = table(spark, sf, "customer").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    ).select(
        F.col("c_custkey").alias("run_id"), F.col("c_mktsegment").alias("model"),
        F.col("n_regionkey").cast("string").alias("prompt_version"),
        F.lit("s").alias("label_schema_version"), F.lit("real").alias("source_mode"),
    )
    expected = rows.select("run_id").withColumns({
        "model": F.lit("BUILDING"), "prompt_version": F.lit("2"),
        "label_schema_version": F.lit("s"), "source_mode": F.lit("real"),
    })
    return runs.version_mismatches(rows, expected).select("run_id", "model")


@query("""
WITH h AS (SELECT o_orderpriority AS run_id, o_orderkey AS review_id, 0 AS attempt_count,
             o_orderstatus = 'F' AS good, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey
               AND l_returnflag = 'R') AS errors FROM orders)
SELECT review_id, CAST(greatest(attempt_count, errors + CASE WHEN good THEN 1 ELSE 0 END) AS INTEGER)
  AS attempt_count FROM h""")
def repaired_attempt_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Returned lines are the failed attempts on an order."""
    errors = table(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R").groupBy(
        F.col("l_orderkey").alias("review_id")
    ).agg(F.collect_list("l_linenumber").alias("error_history"))
    results = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("review_id"), F.lit(0).alias("attempt_count"),
        F.when(F.col("o_orderstatus") == "F", "succeeded").otherwise("failed").alias("status"),
    ).join(errors, "review_id", "left")
    return runs.repaired_attempts(results).select("review_id", "attempt_count")


@query("""SELECT 'evaluation-' || CASE WHEN doc_id < 100 THEN lpad(CAST(doc_id AS VARCHAR), 3, '0')
    ELSE CAST(doc_id AS VARCHAR) END AS sample_id, lang AS category, text AS text_en,
  CASE WHEN lang = 'fr' THEN '자동 번역 참고용' ELSE '번역 없음' END AS translation_notice,
  CASE WHEN source = 'src4' THEN '[]' ELSE '["' || source || '"]' END AS gold_labels_json,
  CASE WHEN quality = 1 THEN 'completed' ELSE 'pending' END AS review_status
FROM labels JOIN documents USING (doc_id)""")
def evaluation_export(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("review_id"), F.col("lang").alias("product_id"),
        F.lit(3).alias("rating"), F.lit("2024-01-01").cast("timestamp").alias("reviewed_at"),
        F.lit(None).cast("string").alias("title"), "text",
        F.lit(None).cast("string").alias("title_ko"),
        F.when(F.col("lang") == "fr", "x").alias("text_ko"),
    )
    products = table(spark, sf, "documents").select(
        F.col("lang").alias("product_id"), F.col("lang").alias("category"),
        F.lit("A").alias("parent_asin"), F.lit(None).cast("string").alias("product_name_ko"),
    ).distinct()
    rows = evaluations(spark, sf).withColumn("notes", F.lit(None).cast("string"))
    return evaluation.export_rows(rows, docs, products).select(
        "sample_id", "category", "text_en", "translation_notice", "gold_labels_json",
        "review_status",
    )


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE known IS NULL) AS inserted,
  count(known) AS preserved FROM documents d
LEFT JOIN (SELECT doc_id AS known FROM labels JOIN documents USING (doc_id) WHERE lang = 'en') l
ON l.known = d.doc_id WHERE lang = 'en'""")
def evaluation_seed_counts(spark: SparkSession, sf: str) -> DataFrame:
    listed = table(spark, sf, "documents").filter(F.col("lang") == "en").select(
        F.col("doc_id").alias("review_id"), F.col("n_chars").alias("position")
    )
    return merge.seed_counts(evaluations(spark, sf), listed, "en")


@query(f"""WITH {QUESTIONS_SQL},
tc AS (SELECT query_id, nt.product_id, nt.rank, count(DISTINCT review_id) AS m,
    count(DISTINCT review_id) FILTER (WHERE polarity = 'negative') AS n,
    count(DISTINCT review_id) FILTER (WHERE polarity = 'positive') AS p
  FROM nt LEFT JOIN el ON el.product_id = nt.product_id AND el.aspect = nt.aspect
    AND el.detail = nt.detail GROUP BY ALL),
ok AS (SELECT er.product_id, er.review_id FROM er JOIN orders ON o_orderkey = er.review_id
       WHERE o_totalprice >= 6500 AND o_totalprice <= 480000),
s AS (SELECT product_id, count(*) AS s,
        count(*) FILTER (WHERE review_id IN (SELECT review_id FROM el WHERE polarity = 'positive')) AS ps,
        count(*) FILTER (WHERE review_id IN (SELECT review_id FROM el WHERE polarity = 'negative')) AS ns
      FROM ok GROUP BY ALL),
co AS (SELECT product_id, n, row_number() OVER (PARTITION BY product_id ORDER BY n DESC, aspect, detail) AS r
  FROM (SELECT product_id, aspect, detail, count(DISTINCT review_id) AS n FROM el WHERE polarity = 'negative' GROUP BY ALL)),
lm AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY month DESC) AS k
       FROM (SELECT DISTINCT product_id, month FROM er)),
ms AS (SELECT er.product_id, er.month, k, count(ok.review_id) AS s FROM er JOIN lm USING (product_id, month)
       LEFT JOIN ok ON ok.review_id = er.review_id WHERE k <= 2 GROUP BY ALL),
nc AS (SELECT el.product_id, er.month, aspect, detail, count(DISTINCT el.review_id) AS n
       FROM el JOIN er ON er.review_id = el.review_id WHERE polarity = 'negative' GROUP BY ALL),
ch AS (SELECT t.product_id, i.aspect, i.detail,
         coalesce(a.n, 0) / nullif(b.s, 0)::DOUBLE AS br, coalesce(c.n, 0) / nullif(t.s, 0)::DOUBLE AS tr
       FROM ms t JOIN ms b ON b.product_id = t.product_id AND t.k = 1 AND b.k = 2
       JOIN (SELECT DISTINCT product_id, aspect, detail FROM nc) i ON i.product_id = t.product_id
       LEFT JOIN nc a ON a.product_id = i.product_id AND a.month = b.month AND a.aspect = i.aspect AND a.detail = i.detail
       LEFT JOIN nc c ON c.product_id = i.product_id AND c.month = t.month AND c.aspect = i.aspect AND c.detail = i.detail),
up AS (SELECT product_id, br, tr, (tr - br) * 100 AS pp, row_number() OVER (PARTITION BY product_id
         ORDER BY (tr - br) * 100 DESC, aspect, detail) AS r FROM ch WHERE (tr - br) * 100 > 0),
v AS (SELECT query_id, 0 AS k, CAST(format('{{:.1f}}', ps / s::DOUBLE * 100) AS DOUBLE) AS x FROM qs JOIN s USING (product_id) WHERE s >= 30
  UNION ALL SELECT query_id, 1, CAST(format('{{:.1f}}', ns / s::DOUBLE * 100) AS DOUBLE) FROM qs JOIN s USING (product_id) WHERE s >= 30
  UNION ALL SELECT query_id, rank * 2, CAST(format('{{:.1f}}', n / s::DOUBLE * 100) AS DOUBLE) FROM tc JOIN s USING (product_id)
    WHERE s >= 30 AND m > 0
  UNION ALL SELECT query_id, rank * 2 + 1, CAST(format('{{:.1f}}', p / s::DOUBLE * 100) AS DOUBLE) FROM tc JOIN s USING (product_id)
    WHERE s >= 30 AND m > 0
  UNION ALL SELECT query_id, 100 + r, CAST(format('{{:.1f}}', n / s::DOUBLE * 100) AS DOUBLE) FROM co JOIN qs USING (product_id)
    JOIN s USING (product_id) WHERE s >= 30 AND r <= 3
  UNION ALL SELECT query_id, 200 + 10 * r, CAST(format('{{:.1f}}', br * 100) AS DOUBLE) FROM up JOIN qs USING (product_id)
    JOIN s USING (product_id) WHERE s >= 30 AND r <= 2
  UNION ALL SELECT query_id, 201 + 10 * r, CAST(format('{{:.1f}}', tr * 100) AS DOUBLE) FROM up JOIN qs USING (product_id)
    JOIN s USING (product_id) WHERE s >= 30 AND r <= 2
  UNION ALL SELECT query_id, 202 + 10 * r, CAST(format('{{:.1f}}', abs(pp)) AS DOUBLE) FROM up JOIN qs USING (product_id)
    JOIN s USING (product_id) WHERE s >= 30 AND r <= 2)
SELECT query_id, string_agg(CAST(x AS VARCHAR), ',' ORDER BY k) AS percents FROM v GROUP BY ALL""")
def question_percents(spark: SparkSession, sf: str) -> DataFrame:
    rows = _question_facts(spark, sf).percents
    return rows.filter(F.size("percents") > 0).select(
        "query_id", F.array_join(F.col("percents").cast("array<string>"), ",").alias("percents")
    )
