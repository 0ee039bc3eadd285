"""Raw review and product metadata expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.months import millis_in_range
from tidemark.functions.text import is_filled, strip


def validity() -> dict[str, Column]:
    """One boolean per checked field of a raw review, and ``eligible`` for all."""
    rating = F.col("rating")
    checks = {
        "parent_asin": is_filled(F.col("parent_asin")),
        "asin": is_filled(F.col("asin")),
        "text": is_filled(F.col("text")),
        "rating": F.coalesce(
            (rating >= 1) & (rating <= 5) & (rating == F.floor(rating)), F.lit(False)
        ),
        "timestamp": millis_in_range(F.col("timestamp")),
    }
    eligible = F.lit(True)
    for check in checks.values():
        eligible = eligible & check
    return {**checks, "eligible": eligible}


def first_image(images: Column) -> Column:
    """First usable URL, high resolution before large before thumbnail."""
    empty = F.array().cast("array<string>")
    urls = F.concat(*[F.coalesce(images[size], empty) for size in ("hi_res", "large", "thumb")])
    return F.get(F.filter(urls, lambda u: u.isNotNull() & (u != "")), F.lit(0))


def description_text(parts: Column) -> Column:
    """Filled description lines, one per row of text; null when none is left."""
    lines = F.transform(F.filter(parts, is_filled), strip)
    return F.nullif(F.array_join(lines, "\n"), F.lit(""))


def has_items(values: Column) -> Column:
    return F.coalesce(F.size(values) > 0, F.lit(False))


def compact_metadata() -> list[Column]:
    """The metadata fields a candidate listing shows."""
    images = F.col("images")
    return [
        F.col("title"),
        F.col("main_category"),
        F.col("store"),
        F.col("average_rating").alias("source_average_rating"),
        F.col("rating_number").alias("source_rating_number"),
        images.isNotNull().alias("has_image"),
        has_items(F.col("description")).alias("has_description"),
        F.coalesce(F.slice("features", 1, 3), F.array().cast("array<string>")).alias(
            "feature_preview"
        ),
    ]
