"""Documents, sheets, reports and shards, written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import sampling
from tidemark.operators.lineage import new_path
from tidemark.sources import documents, shards
from workload.binding import Facts, sql_views, table
from workload.ingestion import SHARDS_SQL
from workload.ingestion import shards as raw_reviews
from workload.registry import query
from workload.samples import NATION_SIZE, nation_sizes, sample_sql


def _stored_document(spark: SparkSession, content: DataFrame) -> str:
    """One JSON document in a file of its own."""
    path = new_path(spark)
    content.coalesce(1).write.text(path)
    return path


# Regions are categories and nations their products; every third nation has a gap in its months, every
# fourth a size that is no number, and one occurs twice.
SELECTION_SQL = """
sel AS (SELECT r_name AS category, 'P' || (CASE WHEN n_nationkey = 24 THEN 23 ELSE n_nationkey END) AS parent_asin,
    CASE WHEN n_nationkey % 3 = 0 THEN '1997-01,1997-02,1997-04' ELSE '1996-12,1997-01,1997-02' END AS months,
    CASE n_nationkey % 4 WHEN 0 THEN 'many' WHEN 1 THEN CAST(n_nationkey AS VARCHAR) END AS analysis_sample_size,
    n_name AS title_ko, n_nationkey
  FROM nation JOIN region ON n_regionkey = r_regionkey)
"""


def _selection(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("n_nationkey")
    months = F.when(key % 3 == 0, "1997-01,1997-02,1997-04").otherwise("1996-12,1997-01,1997-02")
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    product = F.struct(
        F.concat(F.lit("P"), F.when(key == 24, 23).otherwise(key)).alias("parent_asin"),
        F.split(months, ",").alias("months"),
        F.when(key % 4 == 0, "many").when(key % 4 == 1, key.cast("string")).alias("analysis_sample_size"),
        F.col("n_name").alias("title_ko"))
    # a selection lists a few products of each category
    chosen = rows.groupBy("r_name").agg(F.struct(F.collect_list(product).alias("products")).alias("chosen"))
    document = chosen.agg(F.map_from_entries(F.collect_list(F.struct("r_name", "chosen"))).alias("categories"))
    return documents.read_selection(spark, _stored_document(spark, document.select(F.to_json(F.struct("categories")))))


@query(f"""WITH {SELECTION_SQL} SELECT category, parent_asin, months, analysis_sample_size, title_ko FROM sel""")
def selection_document(spark: SparkSession, sf: str) -> DataFrame:
    """Products of a selection document."""
    return _selection(spark, sf).select(
        "category", "parent_asin", F.array_join("months", ",").alias("months"), "analysis_sample_size", "title_ko")


@query(f"""WITH {SELECTION_SQL}
SELECT category, parent_asin, CASE WHEN n_nationkey % 3 = 0 THEN 'months_not_consecutive' ELSE 'bad_sample_size' END
  AS problem FROM sel WHERE n_nationkey % 3 = 0 OR n_nationkey % 4 = 0
UNION ALL SELECT category, NULL, CASE WHEN count(*) <> 5 THEN 'wrong_product_count' ELSE 'repeated_product' END
FROM sel GROUP BY category HAVING count(*) <> 5 OR count(DISTINCT parent_asin) < count(*)""")
def selection_validation(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with a selection document."""
    return documents.selection_problems(_selection(spark, sf), 5)


# Part types are aspects and brands details: common ones for small parts, a region's own for large ones; where both list
# a code, the region's entry is the later one.
TAXONOMY_SQL = """
codes AS (SELECT DISTINCT p_type AS aspect, p_brand AS detail, p_size > 25 AS own FROM part),
cats AS (SELECT r_name AS category FROM region),
every AS (SELECT category, aspect, detail, own FROM codes, cats WHERE NOT own OR category <> 'AFRICA')
"""


@query(f"""WITH {TAXONOMY_SQL}
SELECT category, aspect, detail, 'name of ' || aspect AS aspect_name,
  CASE WHEN bool_or(own) THEN 'own ' ELSE 'common ' END || detail AS detail_name
FROM every GROUP BY category, aspect, detail""")
def taxonomy_document(spark: SparkSession, sf: str) -> DataFrame:
    """Issue codes and names of every category of a taxonomy document."""
    def groups(own: bool) -> DataFrame:
        size = F.col("p_size") > 25
        codes = table(spark, sf, "part").filter(size if own else ~size).select("p_type", "p_brand").distinct()
        kind = F.lit("own " if own else "common ")
        detail = F.struct(
            F.col("p_brand").alias("detail_code"), F.concat(kind, "p_brand").alias("name_ko"),
            F.lit("in").alias("include"), F.lit("out").alias("exclude"))
        # as many groups as part types, as many details as brands
        aspects = codes.groupBy("p_type").agg(F.collect_list(detail).alias("details"))
        return aspects.agg(F.collect_list(F.struct(
            F.col("p_type").alias("aspect_code"), F.concat(F.lit("name of "), "p_type").alias("aspect_name_ko"),
            "details")).alias("own" if own else "common"))

    regions = [r[0] for r in table(spark, sf, "region").select("r_name").collect()]
    named = [x for r in regions if r != "AFRICA" for x in (F.lit(r), F.col("own"))]
    both = groups(False).withColumn("own", groups(True).scalar())
    document = both.select(F.to_json(F.struct(
        F.lit("v1").alias("version"), F.array(F.lit("positive")).alias("polarities"), "common",
        F.create_map(*named).alias("categories"))))
    codes = documents.read_taxonomy(spark, _stored_document(spark, document), regions)
    return codes.select("category", "aspect", "detail", "aspect_name", "detail_name")


@query(f"""WITH {sql_views("nation")}, {sample_sql(NATION_SIZE)},
listed AS (SELECT review_id FROM sm UNION ALL SELECT review_id FROM sm WHERE rank = 1)
SELECT CAST(review_id AS VARCHAR) AS review_id, count(*) AS n FROM listed GROUP BY ALL""")
def review_id_list(spark: SparkSession, sf: str) -> DataFrame:
    """How often each id of a sample file is listed; the first of each month occurs twice."""
    f = Facts(spark, sf, "nation")
    sample = sampling.month_sample(f.reviews, nation_sizes(f)).select("review_id", "rank")
    listed = sample.select("review_id").unionByName(sample.filter("rank = 1").select("review_id"))
    # a sample is bounded by its products' sizes
    document = listed.agg(F.to_json(F.struct(
        F.lit(1).alias("version"), F.collect_list(F.col("review_id").cast("string")).alias("review_ids"))))
    ids = documents.read_review_ids(spark, _stored_document(spark, document))
    often = documents.repeated_keys(ids)
    return ids.select("review_id").distinct().join(often, "review_id", "left").select(
        "review_id", F.coalesce("n", F.lit(1).cast("long")).alias("n"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(text, '') || chr(10) || '"' || coalesce(source, '') || '", ' AS text,
  '["' || lang || '","' || source || '"]' AS labels FROM documents""")
def sheet_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as a sheet with byte-order mark, quotes, line ends and a nested column, read back."""
    rows = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit('\n"'), F.coalesce("source", F.lit("")), F.lit('", ')).alias("text"),
        F.array("lang", "source").alias("labels"))
    path = new_path(spark)
    documents.write_csv(rows, path)
    return documents.read_csv(spark, path, "doc_id string, text string, labels string")


@query("""SELECT user_id, CAST(event_type AS VARCHAR) AS event_type, count(*) AS n,
  max(value) FILTER (WHERE event_type <> 'view') AS most FROM events GROUP BY ALL""")
def report_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A report as JSON lines that keep their nulls, read back."""
    value = F.when(F.col("event_type") != "view", F.col("value"))
    report = table(spark, sf, "events").groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.max(value).alias("most"))
    path = new_path(spark)
    documents.write_json_report(report, path)
    return spark.read.schema(report.schema).json(path)


@query(f"""WITH {SHARDS_SQL}
SELECT parent_asin, asin, user_id, rating, title, text, timestamp, count(*) AS n FROM shards GROUP BY ALL""")
def review_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Raw reviews written as two shards and scanned together."""
    rows = raw_reviews(spark, sf)
    paths = [new_path(spark), new_path(spark)]
    rows.filter("timestamp % 2 = 0").write.parquet(paths[0])
    rows.filter("timestamp % 2 <> 0").write.parquet(paths[1])
    names = ["parent_asin", "asin", "user_id", "rating", "title", "text", "timestamp"]
    return shards.read_reviews(spark, *paths).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
