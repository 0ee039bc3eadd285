"""Raw shards: audit, profile, windows, import waterfall, merges.

A line item is a raw review: part type is the product, supplier the variant and
the user, part name the text, quantity band the rating, ship date the time.
Unusual tax and discount values stand for broken fields.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.defaults import WINDOW_MIN_TOTAL
from tidemark.functions import hashing
from tidemark.functions.months import key_of_index
from tidemark.functions.products import description_text, first_image
from tidemark.operators import growing, ingest, merge, profile
from tidemark.operators.keyed import KeyedTable
from tidemark.operators.lineage import cut, new_path
from tidemark.sources.shards import latest_metadata, missing_keys
from workload.binding import table
from workload.registry import query


def shards(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_type", "p_name")
    c = F.col
    tax, discount = c("l_tax"), c("l_discount")
    lines = table(spark, sf, "lineitem").join(part, c("l_partkey") == c("p_partkey"))
    return lines.select(
        F.when(tax == 0.08, 4.5).otherwise(F.ceil(c("l_quantity") / 10).cast("double"))
        .alias("rating"),
        c("l_linestatus").alias("title"),
        F.when((tax == 0.0) & (discount == 0.0), "  ").otherwise(c("p_name")).alias("text"),
        F.when((tax == 0.05) & (discount == 0.05), F.lit(None))
        .otherwise(c("l_suppkey").cast("string")).alias("asin"),
        F.when((tax == 0.01) & (discount == 0.07), " ").otherwise(c("p_type"))
        .alias("parent_asin"),
        c("l_suppkey").cast("string").alias("user_id"),
        F.when((tax == 0.02) & (discount == 0.03), F.lit(-1).cast("bigint"))
        .otherwise(F.unix_millis(c("l_shipdate").cast("timestamp"))).alias("timestamp"),
    )


SHARDS_SQL = """
shards AS (
  SELECT CASE WHEN l_tax = 0.08 THEN 4.5 ELSE ceil(l_quantity / 10) END AS rating,
    l_linestatus AS title,
    CASE WHEN l_tax = 0 AND l_discount = 0 THEN '  ' ELSE p_name END AS text,
    CASE WHEN l_tax = 0.05 AND l_discount = 0.05 THEN NULL ELSE CAST(l_suppkey AS VARCHAR) END
      AS asin,
    CASE WHEN l_tax = 0.01 AND l_discount = 0.07 THEN ' ' ELSE p_type END AS parent_asin,
    CAST(l_suppkey AS VARCHAR) AS user_id,
    CASE WHEN l_tax = 0.02 AND l_discount = 0.03 THEN -1 ELSE epoch_ms(l_shipdate) END
      AS timestamp
  FROM lineitem JOIN part ON l_partkey = p_partkey),
checked AS (
  SELECT *, trim(parent_asin) <> '' AS ok_parent, coalesce(trim(asin) <> '', FALSE) AS ok_asin,
    trim(text) <> '' AS ok_text, rating BETWEEN 1 AND 5 AND rating = floor(rating) AS ok_rating,
    timestamp >= 631152000000 AND timestamp < 4133980800000 AS ok_timestamp FROM shards),
raw AS (
  SELECT *, ok_parent AND ok_asin AND ok_text AND ok_rating AND ok_timestamp AS eligible,
    CASE WHEN ok_parent AND ok_asin AND ok_text AND ok_rating AND ok_timestamp
         THEN strftime(make_timestamp(timestamp * 1000), '%Y-%m') END AS month FROM checked)
"""


AUDIT_SQL = f"""WITH {SHARDS_SQL}
SELECT count(*) AS total_rows, count(*) FILTER (WHERE NOT ok_parent) AS invalid_parent_asin,
  count(*) FILTER (WHERE NOT ok_asin) AS invalid_asin,
  count(*) FILTER (WHERE NOT ok_text) AS invalid_text,
  count(*) FILTER (WHERE NOT ok_rating) AS invalid_rating,
  count(*) FILTER (WHERE NOT ok_timestamp) AS invalid_timestamp,
  count(*) FILTER (WHERE eligible) AS eligible_rows,
  count(DISTINCT parent_asin) FILTER (WHERE eligible) AS eligible_product_count,
  min(month) AS first_observed_month, max(month) AS last_observed_month FROM raw"""


@query(AUDIT_SQL)
def shard_audit(spark: SparkSession, sf: str) -> DataFrame:
    return profile.audit(profile.shard_volumes(shards(spark, sf)))


@query(AUDIT_SQL)
def growing_shard_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The same of three shards of which the last arrives later; then it alone is scanned."""
    rows = shards(spark, sf)
    folder, state = new_path(spark), new_path(spark)
    third = F.pmod(F.xxhash64("asin", "text"), F.lit(3))
    for k in (0, 1):
        rows.filter(third == k).write.mode("append").parquet(folder)
    growing.grow_profile(spark, state, folder)
    rows.filter(third == 2).write.mode("append").parquet(folder)
    return profile.audit(growing.grow_profile(spark, state, folder).volumes)


@query(f"""WITH {SHARDS_SQL}
SELECT parent_asin, month, n FROM (
  SELECT *, sum(n) OVER (PARTITION BY parent_asin) AS total FROM (
    SELECT parent_asin, month, count(*) AS n FROM raw WHERE eligible GROUP BY ALL))
WHERE total >= 90""")
def product_month_counts(spark: SparkSession, sf: str) -> DataFrame:
    months = profile.candidate_months(profile.shard_volumes(shards(spark, sf)))
    return months.withColumn("month", key_of_index(F.col("month_idx"))).drop("month_idx")


WINDOWS_SQL = """
pm AS (SELECT parent_asin, month, CAST(substr(month, 1, 4) AS INTEGER) * 12
         + CAST(substr(month, 6, 2) AS INTEGER) - 1 AS i, count(*) AS n
       FROM raw WHERE eligible GROUP BY ALL),
wn AS (SELECT a.parent_asin, c.i AS i, a.n AS n1, b.n AS n2, c.n AS n3, a.month AS m1,
              b.month AS m2, c.month AS m3, a.n + b.n + c.n AS review_count,
              greatest(a.n, b.n, c.n) - least(a.n, b.n, c.n) AS balance_gap
       FROM pm a JOIN pm b ON b.parent_asin = a.parent_asin AND b.i = a.i + 1
       JOIN pm c ON c.parent_asin = a.parent_asin AND c.i = a.i + 2
       WHERE least(a.n, b.n, c.n) >= 30 AND a.n + b.n + c.n BETWEEN 150 AND 600
         AND c.i < (SELECT max(i) FROM pm)),
bw AS (SELECT *, row_number() OVER (PARTITION BY parent_asin
         ORDER BY abs(review_count - 375), balance_gap, i DESC) AS k FROM wn)
"""


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    volumes = cut(profile.shard_volumes(shards(spark, sf)))
    months = profile.candidate_months(volumes)
    last = volumes.agg(F.max("month_idx"))
    return profile.best_windows(months, last)


@query(f"""WITH {SHARDS_SQL}, {WINDOWS_SQL}
SELECT parent_asin, review_count, balance_gap, m1 || ',' || m2 || ',' || m3 AS months,
       n1 || ',' || n2 || ',' || n3 AS monthly_counts FROM bw WHERE k = 1""")
def best_three_month_window(spark: SparkSession, sf: str) -> DataFrame:
    return _windows(spark, sf).select(
        "parent_asin", "review_count", "balance_gap", F.array_join("months", ",").alias("months"),
        F.array_join(F.col("counts").cast("array<string>"), ",").alias("monthly_counts"),
    )


def metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Part rows as metadata shards: many rows per type, the last filled title wins."""
    name = F.col("p_name")
    urls = F.array(F.lit(None).cast("string"), F.lit(""), F.concat(F.lit("img/"), name))
    none = F.lit(None).cast("array<string>")
    large = F.when(F.col("p_size") > 25, urls)
    return table(spark, sf, "part").select(
        F.col("p_type").alias("parent_asin"),
        F.when(F.col("p_size") == 1, "  ").otherwise(name).alias("title"),
        F.col("p_brand").alias("main_category"),
        (F.col("p_size") / 10.0).alias("average_rating"),
        F.col("p_partkey").alias("rating_number"),
        F.col("p_brand").alias("store"),
        F.struct(none.alias("hi_res"), large.alias("large"), F.array(name).alias("thumb"))
        .alias("images"),
        F.split(F.concat_ws("|", F.lit(" "), name, F.lit(""), "p_brand"), "[|]").alias("description"),
        F.array("p_name", "p_brand", "p_type", "p_name").alias("features"),
        F.col("p_partkey").alias("shard_order"),
    )


METADATA_SQL = """
md AS (SELECT parent_asin, p_name, p_brand, p_size, p_partkey FROM (
  SELECT p_type AS parent_asin, *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey DESC)
    AS k FROM part WHERE p_size <> 1) WHERE k = 1)
"""


@query(f"""WITH {METADATA_SQL}
SELECT parent_asin, p_name AS title, p_brand AS store, p_size / 10.0::DOUBLE AS average_rating,
  p_partkey AS rating_number, CASE WHEN p_size > 25 THEN 'img/' || p_name ELSE p_name END
    AS image_url, p_name || chr(10) || p_brand AS description FROM md""")
def metadata_last_title(spark: SparkSession, sf: str) -> DataFrame:
    return latest_metadata(metadata(spark, sf)).select(
        "parent_asin", "title", "store", "average_rating", "rating_number",
        first_image(F.col("images")).alias("image_url"),
        description_text(F.col("description")).alias("description"),
    )


@query(f"""WITH {SHARDS_SQL}, {WINDOWS_SQL}, {METADATA_SQL}
SELECT parent_asin, review_count, balance_gap, p_name AS title, TRUE AS has_image,
       TRUE AS has_description, p_name || ',' || p_brand || ',' || parent_asin AS feature_preview
FROM bw JOIN md USING (parent_asin) WHERE k = 1""")
def profile_candidates(spark: SparkSession, sf: str) -> DataFrame:
    windows = _windows(spark, sf)
    found = latest_metadata(metadata(spark, sf), windows)
    rows = profile.ranked_candidates(windows, found)
    return rows.select(
        "parent_asin", "review_count", "balance_gap", "title", "has_image", "has_description",
        F.array_join("feature_preview", ",").alias("feature_preview"),
    )


MONTHS = ("1997-01", "1997-02", "1997-03")


def selection(spark: SparkSession, sf: str) -> DataFrame:
    """Every part type but one, with a fixed three-month window."""
    return (
        table(spark, sf, "part").select(F.col("p_type").alias("parent_asin")).distinct()
        .filter(F.col("parent_asin") != "PROMO")
        .withColumn("months", F.array(*[F.lit(m) for m in MONTHS]))
    )


IMPORT_SQL = f"""
picked AS (SELECT *, CASE WHEN month IS NULL THEN 'ineligible'
    WHEN month NOT IN {MONTHS} THEN 'outside_period' ELSE 'candidate' END AS disposition
  FROM raw WHERE parent_asin IN (SELECT p_type FROM part WHERE p_type <> 'PROMO')),
uniq AS (SELECT DISTINCT asin, parent_asin, rating, text, timestamp, title, user_id, month
         FROM picked WHERE disposition = 'candidate')
"""


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.classified_rows(shards(spark, sf), selection(spark, sf))


@query(f"""WITH {SHARDS_SQL}, {IMPORT_SQL}
SELECT count(*) AS selected_source_rows,
  count(*) FILTER (WHERE disposition = 'ineligible') AS excluded_ineligible,
  count(*) FILTER (WHERE disposition = 'outside_period') AS excluded_outside_period,
  count(*) FILTER (WHERE disposition = 'candidate') - (SELECT count(*) FROM uniq)
    AS excluded_exact_duplicate,
  (SELECT count(*) FROM uniq) AS eligible_unique_import_rows FROM picked""")
def import_waterfall(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.import_audit(_classified(spark, sf))


@query(f"""WITH {SHARDS_SQL}, {IMPORT_SQL}
SELECT 'amazon-' || substr(identity, 1, 40) AS review_id, 'amazon-' || parent_asin AS product_id,
  'amazon-reviews-2023:' || identity AS source_record_key, asin, title, trim(text) AS text,
  CAST(rating AS INTEGER) AS rating, make_timestamp(timestamp * 1000) AS reviewed_at
FROM (SELECT *, sha256(CAST(json_object('asin', asin, 'parent_asin', parent_asin, 'rating', rating, 'text', text,
        'timestamp', timestamp, 'title', title, 'user_id', user_id) AS VARCHAR)) AS identity FROM uniq)""")
def import_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = ingest.review_rows(ingest.unique_candidates(_classified(spark, sf)))
    return rows.select(
        "review_id", "product_id", "source_record_key", "asin", "title", "text", "rating",
        F.col("reviewed_at").cast("timestamp_ntz").alias("reviewed_at"),
    )


@query("""SELECT text, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY ALL""")
def exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Exact copies of whole texts collapse onto one identity hash, the first kept."""
    identity = F.sha2("text", 256).alias("identity")
    return table(spark, sf, "documents").groupBy(identity).agg(
        F.first("text").alias("text"), F.min("doc_id").alias("doc_id"),
        F.count(F.lit(1)).alias("copies"),
    ).drop("identity")


@query(f"""WITH {SHARDS_SQL}, {IMPORT_SQL},
mc AS (SELECT parent_asin, month, count(*) AS n FROM uniq GROUP BY ALL),
w AS (SELECT DISTINCT p_type AS parent_asin, m.month FROM part,
      (VALUES {", ".join(f"('{m}')" for m in MONTHS)}) m(month) WHERE p_type <> 'PROMO'),
j AS (SELECT w.*, coalesce(n, 0) AS n FROM w LEFT JOIN mc USING (parent_asin, month))
SELECT parent_asin, month, n, 'month_below_minimum' AS problem FROM j WHERE n < 110
UNION ALL SELECT parent_asin, NULL, CAST(sum(n) AS BIGINT), 'total_out_of_range' FROM j
GROUP BY ALL HAVING sum(n) NOT BETWEEN {WINDOW_MIN_TOTAL} AND 330""")
def selection_volume_check(spark: SparkSession, sf: str) -> DataFrame:
    unique = ingest.unique_candidates(_classified(spark, sf))
    return ingest.volume_problems(
        selection(spark, sf), ingest.imported_months(unique), per_month=110, largest=330
    )


@query("""SELECT DISTINCT p_type AS parent_asin FROM part
WHERE p_type NOT IN (SELECT p_type FROM part WHERE p_size = 25
  AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3'))""")
def missing_metadata_keys(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    known = part.filter((F.col("p_size") == 25) & F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3"))
    key = F.col("p_type").alias("parent_asin")
    return missing_keys(part.select(key), known.select(key), "parent_asin")


# --- merges ----------------------------------------------------------------------


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN
  (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def insert_once_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Orders not yet stored, where orders with a returned line are stored."""
    stored = table(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("o_orderkey")
    )
    incoming = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return merge.new_rows(stored, incoming, "o_orderkey")


ORDER_ROWS = "o_orderkey bigint, o_custkey bigint"


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN
  (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def keyed_insert_once(spark: SparkSession, sf: str) -> DataFrame:
    """What the second of two batches adds to a keyed table: all orders, after those with a returned line."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    returned = table(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("o_orderkey")
    )
    stored = KeyedTable(spark, new_path(spark), ORDER_ROWS, ["o_orderkey"], buckets=16)
    stored.insert_once(orders.join(returned.distinct(), "o_orderkey"))
    return stored.insert_once(orders).rows


UPSERT_SQL = """
WITH last AS (SELECT user_id, event_type, arg_max(value, event_id) AS value,
                     max(event_id) AS event_id FROM events WHERE event_type <> 'view' GROUP BY ALL),
first AS (SELECT user_id, event_type, arg_min(value, event_id) AS value, min(event_id) AS event_id
          FROM events WHERE event_type <> 'signup' GROUP BY ALL)
SELECT coalesce(l.user_id, f.user_id) AS user_id, coalesce(l.event_type, f.event_type) AS event_type,
       CASE WHEN l.user_id IS NOT NULL THEN l.value ELSE f.value END AS value,
       coalesce(l.event_id, f.event_id) AS event_id
FROM first f FULL OUTER JOIN last l ON f.user_id = l.user_id AND f.event_type = l.event_type"""


@query(UPSERT_SQL)
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    """First events per key as the stored table, last events as the updates."""
    return merge.upsert(*_event_rows(spark, sf), EVENT_KEYS)


EVENT_KEYS = ["user_id", "event_type"]


def _event_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Stored rows and updates."""
    events = table(spark, sf, "events").select("user_id", "event_type", "value", "event_id")
    stored = events.filter(F.col("event_type") != "signup")
    updates = events.filter(F.col("event_type") != "view")
    return (merge.latest_per_key(stored, EVENT_KEYS, -F.col("event_id")),
            merge.latest_per_key(updates, EVENT_KEYS, F.col("event_id")))


@query(UPSERT_SQL)
def keyed_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The same through a keyed table: the stored rows are one version, the updates the next."""
    first, updates = _event_rows(spark, sf)
    stored = KeyedTable(
        spark, new_path(spark), "user_id bigint, event_type string, value double, event_id bigint", EVENT_KEYS, buckets=16)
    stored.insert_once(first)
    stored.upsert(updates)
    return stored.read()


@query("""SELECT doc_id, 'amazon-' || substr(sha256(text), 1, 40) AS review_id,
  sha256(coalesce(source, '') || chr(10) || text) AS input_hash,
  'embedding:' || sha256('m|' || doc_id) AS row_id,
  sha256('salt|' || doc_id) AS order_hash FROM documents""")
def record_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", hashing.review_id(F.sha2("text", 256)).alias("review_id"),
        hashing.input_hash(F.col("source"), F.col("text")).alias("input_hash"),
        hashing.row_id("embedding", F.lit("m"), F.col("doc_id").cast("string")).alias("row_id"),
        hashing.order_hash("salt", F.col("doc_id")).alias("order_hash"),
    )


