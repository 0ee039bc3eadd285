"""Raw review and product metadata shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import is_filled

REVIEW_SCHEMA = (
    "rating double, title string, text string, asin string, parent_asin string, "
    "user_id string, timestamp bigint"
)
METADATA_SCHEMA = (
    "parent_asin string, title string, main_category string, average_rating double, "
    "rating_number bigint, store string, "
    "images struct<hi_res: array<string>, large: array<string>, thumb: array<string>>, "
    "description array<string>, features array<string>"
)


def read_reviews(spark: SparkSession, *paths: str) -> DataFrame:
    """Review shards; a declared schema keeps the scan to the listed columns."""
    return spark.read.schema(REVIEW_SCHEMA).parquet(*paths)


def read_metadata(spark: SparkSession, *paths: str) -> DataFrame:
    """Metadata shards with ``shard_order``, the place of each row in the input."""
    raw = spark.read.schema(METADATA_SCHEMA).parquet(*paths)
    order = F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    return raw.withColumn("shard_order", order)


def latest_metadata(metadata: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The last row with a filled title for each product.

    ``ids`` (column ``parent_asin``) limits the products. The reduction keeps one
    candidate per product in each task, so copies are dropped before the shuffle.
    """
    rows = metadata.filter(is_filled(F.col("title")))
    if ids is not None:
        rows = rows.join(ids.select("parent_asin"), "parent_asin", "left_semi")
    fields = [c for c in metadata.columns if c not in ("parent_asin", "shard_order")]
    return (
        rows.groupBy("parent_asin")
        .agg(F.max_by(F.struct(*fields), F.col("shard_order")).alias("_last"))
        .select("parent_asin", "_last.*")
    )


def missing_keys(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Wanted keys that are not present; must be empty before an import."""
    return wanted.select(key).distinct().join(present.select(key), key, "left_anti")


def require_empty(violations: DataFrame, message: str, shown: int = 5) -> None:
    """Stop when a check found something; reads only the first few rows."""
    found: Sequence = violations.take(shown)
    if found:
        raise ValueError(f"{message}: {[tuple(r) for r in found]}")
