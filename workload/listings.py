"""Product cards, search, review lists, vector search and question facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import compare, facts, pivots, sampling, search, textsearch
from tidemark.operators.lineage import cut
from tidemark.operators.topk import page, total
from tidemark.plans import catalog, insights, questions
from workload.aggregates import COVERAGE_SQL
from workload.binding import RUN, Facts, sql_status, sql_views, table
from workload.registry import query
from workload.samples import NATION_SIZE, nation_sizes, sample_sql

PRODUCTS_SQL = """
prod AS (SELECT CAST(n_nationkey AS VARCHAR) AS product_id, n_name AS title, r_name AS category,
  lower(n_name) AS title_ko, 'ASIN' || n_nationkey AS parent_asin
  FROM nation JOIN region ON n_regionkey = r_regionkey)
"""


@query(f"""WITH {PRODUCTS_SQL} SELECT DISTINCT category FROM prod""")
def categories(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.categories(Facts(spark, sf, "nation").products, "real")


@query(f"""WITH {PRODUCTS_SQL}
SELECT product_id, title, category FROM prod WHERE (title ILIKE '%tion_1%' OR title_ko ILIKE '%tion_1%'
  OR parent_asin ILIKE '%tion_1%') AND category = 'AMERICA'""")
def product_search(spark: SparkSession, sf: str) -> DataFrame:
    found = catalog.filter_products(
        Facts(spark, sf, "nation").products, "  TION_1 ", "AMERICA"
    )
    return found.select("product_id", "title", "category")


@query(f"""WITH {PRODUCTS_SQL}
SELECT product_id, title, category FROM prod WHERE category IN ('ASIA', 'EUROPE')""")
def official_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Without a category, only products of the official ones."""
    found = catalog.filter_products(Facts(spark, sf, "nation").products, " ", official=("ASIA", "EUROPE"))
    return found.select("product_id", "title", "category")


# Customers as products; suppliers give the search strings: digits, words, wildcards, too short and too rare ones.
SEARCHES_SQL = """
items AS (SELECT c_custkey, c_name AS title, CASE WHEN c_nationkey % 3 > 0 THEN lower(c_mktsegment) END AS title_ko,
            'A' || c_custkey || '_' || c_nationkey AS parent_asin FROM customer),
searches AS (SELECT s_suppkey AS search_id, CASE s_suppkey % 8 WHEN 0 THEN ' MER#%' || s_suppkey || ' '
    WHEN 1 THEN 'a' || s_suppkey WHEN 2 THEN '_' || s_suppkey || '_' WHEN 3 THEN 'build_n' WHEN 4 THEN 'ma%y'
    WHEN 5 THEN '9_' || s_suppkey % 10 WHEN 6 THEN 'none of them' ELSE s_name END AS query FROM supplier)
"""


@query(f"""WITH {SEARCHES_SQL}
SELECT search_id, c_custkey FROM items JOIN searches ON title ILIKE '%' || trim(query) || '%'
  OR title_ko ILIKE '%' || trim(query) || '%' OR parent_asin ILIKE '%' || trim(query) || '%'""")
def product_search_many(spark: SparkSession, sf: str) -> DataFrame:
    """Many searches at once, through the index of letter groups."""
    c = F.col
    key = c("c_custkey").cast("string")
    items = table(spark, sf, "customer").select(
        "c_custkey", c("c_name").alias("title"),
        F.when(c("c_nationkey") % 3 > 0, F.lower("c_mktsegment")).alias("title_ko"),
        F.concat(F.lit("A"), key, F.lit("_"), c("c_nationkey").cast("string")).alias("parent_asin"))
    number = c("s_suppkey").cast("string")
    kind = c("s_suppkey") % 8
    searches = table(spark, sf, "supplier").select(
        c("s_suppkey").alias("search_id"),
        F.when(kind == 0, F.concat(F.lit(" MER#%"), number, F.lit(" "))).when(kind == 1, F.concat(F.lit("a"), number))
        .when(kind == 2, F.concat(F.lit("_"), number, F.lit("_"))).when(kind == 3, "build_n").when(kind == 4, "ma%y")
        .when(kind == 5, F.concat(F.lit("9_"), (c("s_suppkey") % 10).cast("string"))).when(kind == 6, "none of them")
        .otherwise(c("s_name")).alias("query"))
    fields = {name: c(name) for name in ("title", "title_ko", "parent_asin")}
    return textsearch.search_many(items, "c_custkey", fields, searches)


CARDS_SQL = f"""
tot AS (SELECT product_id, sum(review_count)::BIGINT AS review_count,
  sum(succeeded)::BIGINT AS succeeded, sum(failed)::BIGINT AS failed,
  sum(in_progress)::BIGINT AS in_progress, sum(scope_total)::BIGINT AS scope_total,
  string_agg(month, ',' ORDER BY month) AS available_months FROM cov GROUP BY ALL),
pol AS (SELECT product_id, count(DISTINCT review_id) FILTER (WHERE polarity = 'positive') AS p,
  count(DISTINCT review_id) FILTER (WHERE polarity = 'negative') AS n FROM lr GROUP BY ALL),
card AS (SELECT prod.product_id, title, category, review_count, succeeded AS analyzed_review_count,
  CAST(p AS DOUBLE) / succeeded AS positive_share, CAST(n AS DOUBLE) / succeeded AS negative_share,
  {sql_status('scope_total', 'succeeded', 'failed', 'in_progress')} AS analysis_status,
  available_months FROM prod JOIN tot USING (product_id) JOIN pol USING (product_id))
"""


def _cards(f: Facts) -> DataFrame:
    return catalog.cards(f.products, f.months).select(
        "product_id", "title", "category", "review_count", "analyzed_review_count",
        "positive_share", "negative_share", "analysis_status",
        F.array_join("available_months", ",").alias("available_months"),
    )


@query(f"""WITH {sql_views("nation")}, {COVERAGE_SQL}, {PRODUCTS_SQL}, {CARDS_SQL}
SELECT * FROM card ORDER BY title, product_id LIMIT 10 OFFSET 10""")
def product_cards(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of ten cards."""
    return catalog.card_page(_cards(Facts(spark, sf, "nation")), 2, 10)


@query(f"""WITH {sql_views("nation")}, {COVERAGE_SQL}, {PRODUCTS_SQL}, {CARDS_SQL}
SELECT *, CAST((row_number() OVER (ORDER BY title, product_id) + 9) // 10 AS INTEGER) AS page FROM card""")
def product_card_pages(spark: SparkSession, sf: str) -> DataFrame:
    """All pages of ten cards, and one that is empty."""
    cards = cut(_cards(Facts(spark, sf, "nation")))
    return reduce(DataFrame.unionByName, [
        catalog.card_page(cards, n, 10).withColumn("page", F.lit(n)) for n in range(1, 5)])


@query("""SELECT count(*) AS total FROM nation JOIN region ON n_regionkey = r_regionkey
WHERE r_name <> 'ASIA'""")
def product_total(spark: SparkSession, sf: str) -> DataFrame:
    products = Facts(spark, sf, "nation").products
    return total(products.filter(F.col("category") != "ASIA"))


@query(f"""WITH {sql_views("nation")}, {PRODUCTS_SQL}
SELECT product_id, title, month, count(*) AS review_count, avg(rating) AS average_rating
FROM prod JOIN reviews USING (product_id) GROUP BY ALL""")
def product_detail(spark: SparkSession, sf: str) -> DataFrame:
    f = Facts(spark, sf, "nation")
    detail = catalog.product_detail(f.products, f.month_table)
    return detail.select("product_id", "title", F.inline("monthly_stats"))


@query(f"""WITH {sql_views("nation")}, {PRODUCTS_SQL}, {sample_sql(NATION_SIZE)},
s AS (SELECT product_id, count(*) AS sample FROM sm GROUP BY ALL),
r AS (SELECT product_id, count(*) AS reviews FROM reviews GROUP BY ALL)
SELECT product_id, category, parent_asin, title, title_ko, reviews, sample,
  CAST(product_id AS INTEGER) * 10 + 10 AS sample_size,
  CAST(product_id AS INTEGER) / 5.0::DOUBLE AS source_average_rating
FROM prod JOIN r USING (product_id) JOIN s USING (product_id)""")
def product_inventory(spark: SparkSession, sf: str) -> DataFrame:
    f = Facts(spark, sf, "nation")
    sample = sampling.month_sample(f.reviews, nation_sizes(f))
    return catalog.inventory(f.products, f.stored_months, sample).select(
        "product_id", "category", "parent_asin", "title", "title_ko", "reviews", "sample",
        "sample_size", "source_average_rating",
    )


@query(f"""WITH {sql_views()},
hit AS (SELECT * FROM rf WHERE month = '1998-04' AND product_id = 'MACHINERY' AND review_id IN
  (SELECT review_id FROM labels WHERE aspect = 'PROMO' AND polarity = 'negative')),
pg AS (SELECT * FROM hit ORDER BY reviewed_at DESC, review_id LIMIT 20)
SELECT pg.review_id, rating, coalesce(status, 'not_started') AS analysis_status,
  (SELECT count(*) FROM labels l WHERE l.review_id = pg.review_id) AS n_labels FROM pg""")
def review_list_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """First page of a month's reviews with a negative label on one aspect."""
    f = Facts(spark, sf)
    found = catalog.filter_reviews(
        f.reviews.filter(F.col("product_id") == "MACHINERY"), "1998-04", f.labels, "PROMO",
        "negative",
    )
    first = page(found, catalog.review_order(), 1, 20)
    detailed = catalog.with_review_details(first, f.results, f.labels)
    return detailed.select(
        "review_id", "rating", "analysis_status",
        F.size("labels").cast("bigint").alias("n_labels"),
    )


@query(f"""WITH {sql_views()}
SELECT product_id, count(*) AS total FROM rf WHERE review_id IN
  (SELECT review_id FROM labels WHERE aspect = 'PROMO' AND polarity = 'negative') GROUP BY ALL""")
def review_list_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Filtered review totals of every product over all months."""
    f = Facts(spark, sf)
    found = catalog.filter_reviews(f.reviews, None, f.labels, "PROMO", "negative")
    return found.groupBy("product_id").agg(F.count(F.lit(1)).alias("total"))


# --- vectors ---------------------------------------------------------------------


def embedded_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that have a vector; the vector's label is the product."""
    vectors = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("review_id"), F.col("label").cast("string").alias("product_id")
    )
    orders = Facts(spark, sf).reviews.drop("product_id")
    return vectors.join(orders, "review_id").withColumn("text", F.lit("review"))


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("review_id"), F.lit("m").alias("model"), "embedding"
    )


def product_queries(spark: SparkSession, sf: str) -> DataFrame:
    """One query per product: the vector of its first review."""
    first = table(spark, sf, "embeddings").groupBy("label").agg(
        F.min_by("embedding", "vec_id").alias("vector")
    )
    return first.select(
        F.col("label").alias("query_id"), F.col("label").cast("string").alias("product_id"),
        F.lit("all").alias("category"), F.lit(None).cast("array<string>").alias("months"),
        "vector", F.lit("m").alias("model"),
    )


VECTORS_SQL = """
er AS (SELECT vec_id AS review_id, CAST(label AS VARCHAR) AS product_id, embedding::DOUBLE[] AS v,
         strftime(o_orderdate, '%Y-%m') AS month, o_orderdate AS reviewed_at
       FROM embeddings JOIN orders ON vec_id = o_orderkey JOIN customer ON o_custkey = c_custkey
       WHERE o_totalprice >= 5000),
qs AS (SELECT label AS query_id, CAST(label AS VARCHAR) AS product_id,
         arg_min(embedding, vec_id)::DOUBLE[] AS q FROM embeddings GROUP BY ALL),
sc AS (SELECT query_id, er.product_id, review_id, 1 - list_cosine_similarity(v, q) AS distance, month
       FROM er JOIN qs USING (product_id))
"""


@query(f"""WITH {VECTORS_SQL}
SELECT query_id, product_id, review_id, CAST(rank AS INTEGER) AS rank,
  round(1 - distance, 4) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY round(distance, 12), review_id) AS rank FROM sc) WHERE rank <= 8""")
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    return search.nearest_reviews(
        product_queries(spark, sf), embedded_reviews(spark, sf), embeddings(spark, sf)
    ).drop("distance")


@query(f"""WITH {VECTORS_SQL}
SELECT query_id, product_id, review_id, CAST(rank AS INTEGER) AS rank,
  round(1 - distance, 4) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY round(distance, 12), review_id) AS rank FROM sc) WHERE rank <= 8""")
def cosine_topk_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """The same through stored distances to a few pivots of each product."""
    index = pivots.pivot_index(embedded_reviews(spark, sf), embeddings(spark, sf))
    return pivots.nearest_indexed(product_queries(spark, sf), index).nearest.drop("distance")


PERIOD = ["1996-01", "1996-02", "1996-03", "1998-07", "1998-08"]


@query(f"""WITH {VECTORS_SQL}
SELECT query_id, product_id, review_id, CAST(rank AS INTEGER) AS rank,
  round(1 - distance, 4) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY round(distance, 12), review_id) AS rank FROM sc WHERE month IN {tuple(PERIOD)})
WHERE rank <= 3""")
def cosine_topk_in_period(spark: SparkSession, sf: str) -> DataFrame:
    queries = product_queries(spark, sf).withColumn("months", F.array(*map(F.lit, PERIOD)))
    return search.nearest_reviews(
        queries, embedded_reviews(spark, sf), embeddings(spark, sf), 3
    ).drop("distance")


@query(f"""WITH {VECTORS_SQL}
SELECT query_id, count(review_id) FILTER (WHERE month IN {tuple(PERIOD)}) AS embedded_reviews,
  count(review_id) FILTER (WHERE month IN {tuple(PERIOD)}) AS total_reviews
FROM qs LEFT JOIN er USING (product_id) GROUP BY ALL""")
def search_coverage(spark: SparkSession, sf: str) -> DataFrame:
    queries = product_queries(spark, sf).withColumn("months", F.array(*map(F.lit, PERIOD)))
    return search.search_coverage(queries, embedded_reviews(spark, sf), embeddings(spark, sf))


@query(f"""WITH {sql_views()}
SELECT product_id AS query_id, count(e.vec_id) AS embedded_reviews, count(*) AS total_reviews
FROM reviews LEFT JOIN embeddings e ON vec_id = review_id WHERE month IN {tuple(PERIOD)}
GROUP BY ALL""")
def search_coverage_partial(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage where only some reviews have a vector."""
    f = Facts(spark, sf)
    queries = f.products.select(
        F.col("product_id").alias("query_id"), "product_id", F.lit("m").alias("model"),
        F.array(*map(F.lit, PERIOD)).alias("months"),
    )
    return search.search_coverage(queries, f.reviews, embeddings(spark, sf))


def topics(spark: SparkSession, sf: str) -> DataFrame:
    """A vector per part type and brand: that of the first part with a vector."""
    part = table(spark, sf, "part").select("p_partkey", "p_type", "p_brand")
    vectors = table(spark, sf, "embeddings").join(part, F.col("vec_id") == F.col("p_partkey"))
    return vectors.groupBy(
        F.lit("all").alias("category"), F.col("p_type").alias("aspect"),
        F.col("p_brand").alias("detail"),
    ).agg(F.min_by("embedding", "vec_id").alias("vector"))


TOPICS_SQL = """
tp AS (SELECT p_type AS aspect, p_brand AS detail, arg_min(embedding, vec_id)::DOUBLE[] AS v
       FROM embeddings JOIN part ON vec_id = p_partkey GROUP BY ALL)
"""


@query(f"""WITH {TOPICS_SQL}
SELECT vec_id AS query_id, CAST(rank AS INTEGER) AS rank, aspect, detail,
  round(s, 3) AS similarity FROM (
  SELECT vec_id, aspect, detail, s, row_number() OVER (PARTITION BY vec_id
    ORDER BY round(-s, 12), aspect, detail) AS rank
  FROM (SELECT vec_id, aspect, detail, list_cosine_similarity(embedding::DOUBLE[], v) AS s
        FROM embeddings CROSS JOIN tp)) WHERE rank <= 2""")
def nearest_taxonomy_top2(spark: SparkSession, sf: str) -> DataFrame:
    queries = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.lit("all").alias("category"),
        F.col("embedding").alias("vector"),
    )
    return search.nearest_topics(queries, search.topic_vectors(topics(spark, sf)))


@query("""
WITH fq AS (SELECT 'faq' || label AS faq_key, arg_min(embedding, vec_id)::DOUBLE[] AS v
            FROM embeddings GROUP BY label),
s AS (SELECT vec_id, faq_key, list_cosine_similarity(embedding::DOUBLE[], v) AS s
      FROM embeddings CROSS JOIN fq)
SELECT vec_id AS query_id, faq_key, round(s, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 12) DESC, faq_key) AS k
  FROM s) WHERE k = 1 AND s >= 0.3""")
def faq_match(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    faq = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector")).select(
        F.concat(F.lit("faq"), "label").alias("faq_key"), "vector", F.col("label").alias("position")
    )
    queries = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return search.best_faq(queries, faq, 0.3).select(
        "query_id", "faq_key", F.round("similarity", 6).alias("similarity")
    )


@query("""
WITH fq AS (SELECT label AS f, 'faq' || label AS faq_key, arg_min(embedding, vec_id)::DOUBLE[] AS v
            FROM embeddings GROUP BY label),
s AS (SELECT vec_id, label, f, faq_key, list_cosine_similarity(embedding::DOUBLE[], v) AS s
      FROM embeddings CROSS JOIN fq),
b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 12) DESC, f) AS k FROM s)
SELECT vec_id AS query_id, faq_key, round(s, 6) AS similarity, 'answer ' || label || '/' || f AS answer
FROM b WHERE k = 1 AND s >= 0.3 AND (label + f) % 4 <> 0 AND (label * f) % 3 <> 0""")
def fresh_faq_match(spark: SparkSession, sf: str) -> DataFrame:
    """The stored answer of the nearest question, where there is one and it is fresh."""
    vectors = table(spark, sf, "embeddings")
    faq = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector")).select(
        F.concat(F.lit("faq"), "label").alias("faq_key"), "vector", F.col("label").alias("position")
    )
    queries = vectors.select(
        F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("product_id"),
        F.col("embedding").alias("vector"))
    # each product (label) has stored some of the questions, and some of the answers are stale
    stored = vectors.select("label").distinct().select("label", F.explode(F.sequence(
        F.lit(0), F.lit(99))).alias("f"))
    rows = stored.select(
        F.col("label").cast("string").alias("product_id"), F.concat(F.lit("faq"), "f").alias("faq_key"),
        F.when((F.col("label") + F.col("f")) % 4 != 0, F.concat(
            F.lit("answer "), "label", F.lit("/"), "f")).alias("answer"),
        ((F.col("label") * F.col("f")) % 3 == 0).alias("is_stale"))
    found = questions.fresh_faq_match(search.best_faq(queries, faq, 0.3), queries, rows)
    return found.select("query_id", "faq_key", F.round("similarity", 6).alias("similarity"), "answer")


def _question_facts(spark: SparkSession, sf: str) -> questions.QuestionFacts:
    texts = table(spark, sf, "documents").select(
        F.col("doc_id").alias("review_id"), F.col("source").alias("title"), "text")
    reviews = embedded_reviews(spark, sf).drop("text").join(texts, "review_id", "left")
    f = Facts(spark, sf)
    f.products = reviews.select("product_id").distinct().withColumn("run_id", F.lit(RUN))
    f.reviews = reviews
    f.scoped = facts.run_reviews(reviews, RUN)
    over = insights.overview(f.products, f.month_table)
    aspects = insights.aspects(over, f.issue_table)
    covered = compare.coverage(compare.latest_pair(f.month_table), f.month_table)
    return questions.question_facts(
        product_queries(spark, sf), topics(spark, sf), over, aspects, f.label_rows, reviews,
        embeddings(spark, sf), insights.top_complaints(aspects),
        compare.top_increases(compare.issues(covered, f.issue_table)),
    )


QUESTIONS_SQL = f"""
{VECTORS_SQL}, {TOPICS_SQL},
labels AS (
  SELECT l_orderkey AS review_id, p_type AS aspect, p_brand AS detail, p_name AS evidence,
         l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS label_id,
         CASE l_returnflag WHEN 'R' THEN 'negative' WHEN 'A' THEN 'positive' ELSE 'neutral' END
           AS polarity
  FROM lineitem JOIN part ON l_partkey = p_partkey),
el AS (SELECT er.product_id, er.review_id, reviewed_at, aspect, detail, polarity, evidence, label_id
       FROM er JOIN labels USING (review_id) JOIN orders ON o_orderkey = er.review_id
       WHERE o_totalprice >= 6500 AND o_totalprice <= 480000),
nt AS (SELECT query_id, product_id, aspect, detail, rank FROM (
  SELECT query_id, product_id, aspect, detail, row_number() OVER (PARTITION BY query_id
    ORDER BY round(-list_cosine_similarity(q, v), 12), aspect, detail) AS rank
  FROM qs CROSS JOIN tp) WHERE rank <= 2)
"""


@query(f"""WITH {QUESTIONS_SQL}
SELECT query_id, nt.product_id, CAST(nt.rank AS INTEGER) AS rank, nt.aspect, nt.detail,
  count(DISTINCT review_id) AS mention_count,
  count(DISTINCT review_id) FILTER (WHERE polarity = 'positive') AS positive_count,
  count(DISTINCT review_id) FILTER (WHERE polarity = 'negative') AS negative_count
FROM nt LEFT JOIN el ON el.product_id = nt.product_id AND el.aspect = nt.aspect
  AND el.detail = nt.detail GROUP BY ALL""")
def question_topics(spark: SparkSession, sf: str) -> DataFrame:
    return _question_facts(spark, sf).topics.drop("similarity")


@query(f"""WITH {QUESTIONS_SQL},
one AS (SELECT product_id, aspect, detail, polarity, review_id, max(reviewed_at) AS reviewed_at,
          arg_min(evidence, label_id) AS evidence FROM el WHERE polarity <> 'neutral' GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY product_id, aspect, detail, polarity
        ORDER BY reviewed_at DESC, review_id) AS example_rank FROM one),
ex AS (SELECT query_id, nt.rank AS a, CASE polarity WHEN 'negative' THEN 0 ELSE 1 END AS b,
         0 AS part, review_id, polarity AS label, evidence AS text
       FROM nt JOIN k USING (product_id, aspect, detail) WHERE example_rank = 1),
rel AS (SELECT query_id, rank AS a, 0 AS b, 1 AS part, review_id, 'related' AS label,
          substr(trim(regexp_replace(coalesce(source, '') || ' ' || coalesce(text, ''), '\\s+', ' ', 'g')), 1, 100) AS text
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id
            ORDER BY round(distance, 12), review_id) AS rank FROM sc) LEFT JOIN documents ON doc_id = review_id
        WHERE rank <= 2),
al AS (SELECT *, row_number() OVER (PARTITION BY query_id, review_id ORDER BY part, a, b) AS dup
       FROM (SELECT * FROM ex UNION ALL SELECT * FROM rel))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY part, a, b) AS INTEGER)
  AS number, review_id, label, text FROM al WHERE dup = 1""")
def question_digest_sources(spark: SparkSession, sf: str) -> DataFrame:
    return _question_facts(spark, sf).sources


@query(f"""WITH {QUESTIONS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 12), review_id) AS rank FROM sc)
SELECT query_id, r.review_id, CAST(rank AS INTEGER) AS rank, CAST(format('{{:.3f}}', 1 - distance) AS DOUBLE) AS similarity,
  CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS rating, CAST(o_orderdate AS DATE) AS date,
  coalesce(source, '') AS title, substr(text, 1, 300) AS text,
  coalesce((SELECT string_agg(DISTINCT detail || ':' || polarity, ',' ORDER BY detail || ':' || polarity)
            FROM el WHERE el.review_id = r.review_id), '') AS labels
FROM r JOIN orders ON o_orderkey = r.review_id LEFT JOIN documents ON doc_id = r.review_id WHERE rank <= 4""")
def question_related(spark: SparkSession, sf: str) -> DataFrame:
    """Related reviews of each question as shown: title, excerpt, rating, date, labels."""
    rows = _question_facts(spark, sf).related
    return rows.select(
        "query_id", "review_id", "rank", "similarity", "rating", "date", "title", "text",
        F.array_join("labels", ",").alias("labels"))


