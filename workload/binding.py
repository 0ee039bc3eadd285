"""Review-shaped views of the test tables, and the same views in SQL.

An order is a review: its customer's market segment (or nation) is the product,
its priority the rating, its date the review time, its price decides eligibility
and processing status. A line item is a label: part type and brand are aspect and
detail, the return flag is the polarity, the part name the quote.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import facts
from tidemark.operators.lineage import cut

RUN = "run-1"


# Declared schemas, so that opening a table reads no footers.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def timestamp(column: str) -> F.Column:
    return F.col(column).cast("timestamp")


def reviews(spark: SparkSession, sf: str, product: str = "segment") -> DataFrame:
    """Reviews; ``product`` is ``segment`` (few, dense) or ``nation`` (25)."""
    key = {"segment": F.col("c_mktsegment"), "nation": F.col("c_nationkey").cast("string")}
    customers = table(spark, sf, "customer").select("c_custkey", key[product].alias("product_id"))
    orders = table(spark, sf, "orders").select(
        "o_custkey",
        F.col("o_orderkey").alias("review_id"),
        F.lit("real").alias("source_mode"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("rating"),
        timestamp("o_orderdate").alias("reviewed_at"),
        (F.col("o_totalprice") >= 5000).alias("eligible"),
    )
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).drop(
        "o_custkey", "c_custkey"
    )


def results(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("o_totalprice")
    status = (
        F.when(price > 480000, "failed").when(price < 6000, "pending")
        .when(price < 6500, "running").otherwise("succeeded")
    )
    return table(spark, sf, "orders").select(
        F.lit(RUN).alias("run_id"), F.col("o_orderkey").alias("review_id"), status.alias("status")
    )


def labels(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select(
        "p_partkey", F.col("p_type").alias("aspect"), F.col("p_brand").alias("detail"),
        F.col("p_name").alias("evidence"),
    )
    lines = table(spark, sf, "lineitem").select(
        "l_partkey",
        F.lit(RUN).alias("run_id"),
        F.col("l_orderkey").alias("review_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("label_id"),
        F.when(F.col("l_returnflag") == "R", "negative")
        .when(F.col("l_returnflag") == "A", "positive").otherwise("neutral").alias("polarity"),
    )
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).drop(
        "l_partkey", "p_partkey"
    )


def products(spark: SparkSession, sf: str, product: str = "segment") -> DataFrame:
    """Products with their run; nations carry title, category and metadata."""
    if product == "segment":
        return (
            table(spark, sf, "customer").select(F.col("c_mktsegment").alias("product_id"))
            .distinct().withColumn("run_id", F.lit(RUN))
        )
    region = table(spark, sf, "region")
    nation = table(spark, sf, "nation")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("string").alias("product_id"),
        F.lit("real").alias("source_mode"),
        F.col("n_name").alias("title"),
        F.col("r_name").alias("category"),
        F.concat(F.lit("ASIN"), F.col("n_nationkey")).alias("parent_asin"),
        F.lit(None).cast("string").alias("image_url"),
        F.to_json(F.struct(
            F.lower("n_name").alias("title_ko"),
            (F.col("n_nationkey") / 5.0).alias("source_average_rating"),
            (F.col("n_nationkey") * 10 + 10).alias("analysis_sample_size"),
        )).alias("metadata_json"),
        F.lit(RUN).alias("run_id"),
    )


class Facts:
    """The facts and rollups of one binding, built once per query."""

    def __init__(self, spark: SparkSession, sf: str, product: str = "segment",
                 sample: DataFrame | None = None):
        self.products = products(spark, sf, product)
        self.reviews = reviews(spark, sf, product)
        self.results = results(spark, sf)
        self.labels = labels(spark, sf)
        self.scoped = facts.run_reviews(self.reviews, RUN, sample)

    @property
    def review_facts(self) -> DataFrame:
        return facts.review_facts(self.scoped, self.results, self.labels)

    @property
    def stored_months(self) -> DataFrame:
        return facts.stored_months(self.reviews)

    @property
    def months(self) -> DataFrame:
        return facts.month_rollup(self.review_facts)

    @property
    def label_rows(self) -> DataFrame:
        return facts.analysed_labels(self.scoped, self.results, self.labels)

    @property
    def issue_facts(self) -> DataFrame:
        return facts.issue_facts(self.label_rows)

    @property
    def rollup(self) -> DataFrame:
        return facts.issue_rollup(self.issue_facts)

    # Rollups that several parts of a report read are stored once.

    @cached_property
    def month_table(self) -> DataFrame:
        return cut(self.months)

    @cached_property
    def issue_table(self) -> DataFrame:
        return cut(self.rollup)


# --- the same views in SQL -------------------------------------------------------

_PRODUCT_SQL = {"segment": "c_mktsegment", "nation": "CAST(c_nationkey AS VARCHAR)"}


def sql_views(product: str = "segment", in_sample: str = "TRUE") -> str:
    """``WITH`` list: reviews, results, labels, rf (review facts), lr (label rows)."""
    return f"""
reviews AS (
  SELECT {_PRODUCT_SQL[product]} AS product_id, o_orderkey AS review_id,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS rating, o_orderdate AS reviewed_at,
         strftime(o_orderdate, '%Y-%m') AS month
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice >= 5000),
results AS (
  SELECT o_orderkey AS review_id,
         CASE WHEN o_totalprice > 480000 THEN 'failed' WHEN o_totalprice < 6000 THEN 'pending'
              WHEN o_totalprice < 6500 THEN 'running' ELSE 'succeeded' END AS status
  FROM orders),
labels AS (
  SELECT l_orderkey AS review_id, p_type AS aspect, p_brand AS detail, p_name AS evidence,
         l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS label_id,
         CASE l_returnflag WHEN 'R' THEN 'negative' WHEN 'A' THEN 'positive' ELSE 'neutral' END
           AS polarity
  FROM lineitem JOIN part ON l_partkey = p_partkey),
sampled AS (SELECT r.*, {in_sample} AS in_sample FROM reviews r),
rf AS (SELECT r.*, s.status FROM sampled r LEFT JOIN results s USING (review_id)),
lr AS (
  SELECT rf.*, l.aspect, l.detail, l.evidence, l.label_id, l.polarity
  FROM rf JOIN labels l USING (review_id) WHERE rf.status = 'succeeded' AND rf.in_sample)
"""


def sql_status(total: str, ok: str, failed: str, running: str) -> str:
    return f"""CASE
  WHEN {total} > 0 AND {ok} + {failed} >= {total} AND {running} = 0
    THEN CASE WHEN {failed} / CAST({total} AS DOUBLE) <= 0.05 THEN 'complete'
         ELSE 'partial_failure' END
  WHEN {ok} > 0 OR {failed} > 0 OR {running} > 0 THEN 'in_progress'
  ELSE 'not_started' END"""


def sql_rate(a: str, b: str) -> str:
    return f"(CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} END)"
