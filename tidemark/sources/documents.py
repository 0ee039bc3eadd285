"""JSON and CSV inputs and outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from tidemark.defaults import OFFICIAL_CATEGORIES, PRODUCTS_PER_CATEGORY
from tidemark.functions.months import index_of_key

SELECTION_SCHEMA = (
    "categories map<string, struct<products: array<struct<parent_asin: string, "
    "months: array<string>, analysis_sample_size: string, title_ko: string, "
    "title_ko_source: string, description_ko: string, product_type: string>>>>"
)
_GROUP = (
    "struct<aspect_code: string, aspect_name_ko: string, details: array<struct<"
    "detail_code: string, name_ko: string, include: string, exclude: string, example: string>>>"
)
TAXONOMY_SCHEMA = (
    f"version string, polarities array<string>, common array<{_GROUP}>, "
    f"categories map<string, array<{_GROUP}>>"
)


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    """Selected products, one row each with its category."""
    document = spark.read.schema(SELECTION_SCHEMA).json(path, multiLine=True)
    return document.select(F.explode("categories").alias("category", "chosen")).select(
        "category", F.inline("chosen.products")
    )


def selection_problems(
    selection: DataFrame, per_category: int = PRODUCTS_PER_CATEGORY
) -> DataFrame:
    """Violations ``category, parent_asin, problem``: counts, duplicates, months, sizes."""
    c = F.col
    counts = selection.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("parent_asin").alias("d")
    )
    by_category = counts.select(
        "category", F.lit(None).cast("string").alias("parent_asin"),
        F.when(c("n") != per_category, "wrong_product_count")
        .when(c("d") != c("n"), "repeated_product").alias("problem"),
    )
    indexes = F.transform("months", index_of_key)
    first = F.get(indexes, F.lit(0))
    consecutive = (F.size("months") == 3) & F.forall(
        F.transform(indexes, lambda m, i: m - i == first), lambda ok: F.coalesce(ok, F.lit(False))
    )
    size = c("analysis_sample_size")
    bad_size = size.isNotNull() & ~F.coalesce(size.try_cast("int") >= 1, F.lit(False))
    by_product = selection.select(
        "category", "parent_asin",
        F.when(~F.coalesce(consecutive, F.lit(False)), "months_not_consecutive")
        .when(bad_size, "bad_sample_size").alias("problem"),
    )
    return by_category.unionByName(by_product).filter(c("problem").isNotNull())


def read_taxonomy(
    spark: SparkSession, path: str, categories: Sequence[str] = OFFICIAL_CATEGORIES
) -> DataFrame:
    """Issue codes and names per category: the common groups and its own.

    A code listed twice takes the later entry. The document is one small file.
    """
    document = spark.read.schema(TAXONOMY_SCHEMA).json(path, multiLine=True)
    own = F.coalesce(F.col("categories")[F.col("category")],
                     F.array().cast(document.schema["common"].dataType))
    groups = (
        document.withColumn("category", F.explode(F.array(*[F.lit(x) for x in categories])))
        .select("category", F.posexplode(F.concat("common", own)).alias("place", "g"))
    )
    details = groups.select(
        "category", "place", F.col("g.aspect_code").alias("aspect"),
        F.col("g.aspect_name_ko").alias("aspect_name"), F.posexplode("g.details"),
    )
    entry = F.struct(
        "aspect_name", F.col("col.name_ko").alias("detail_name"), "col.include", "col.exclude"
    )
    return (
        details.groupBy("category", "aspect", F.col("col.detail_code").alias("detail"))
        .agg(F.max_by(entry, F.struct("place", "pos")).alias("_last"))
        .select("category", "aspect", "detail", "_last.*")
    )


def read_review_ids(spark: SparkSession, path: str) -> DataFrame:
    """Review ids of a sample file."""
    document = spark.read.schema("review_ids array<string>").json(path, multiLine=True)
    return document.select(F.posexplode("review_ids").alias("position", "review_id"))


def repeated_keys(rows: DataFrame, key: str = "review_id") -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header, quoted newlines and an optional byte-order mark."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    rows = reader.csv(path)
    rows = rows.toDF(*[c.lstrip("\ufeff") for c in rows.columns])
    if schema is None:
        return rows
    kinds = StructType.fromDDL(schema)
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in kinds.fields])


def flatten_nested(rows: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for CSV."""
    nested = [
        f.name for f in rows.schema.fields if isinstance(f.dataType, ArrayType | MapType | StructType)
    ]
    return rows.withColumns({c: F.to_json(c) for c in nested}) if nested else rows


def write_csv(rows: DataFrame, path: str, byte_order_mark: bool = True) -> None:
    """CSV with a header; nested columns become JSON text.

    The byte-order mark lets spreadsheet programs read the text as UTF-8.
    """
    flat = flatten_nested(rows)
    if byte_order_mark:
        first, *rest = flat.columns
        flat = flat.toDF("\ufeff" + first, *rest)
    flat.write.mode("overwrite").options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def write_json_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)
