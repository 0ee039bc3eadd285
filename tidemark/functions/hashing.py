"""Stable identities and hash orders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import strip

# Default salt of the processing order; callers with stored samples pass theirs.
PROCESSING_SALT = "processing-order"

# Id prefixes and the columns that identify a raw review.
PRODUCT_PREFIX = "amazon-"
REVIEW_PREFIX = "amazon-"
RECORD_PREFIX = "amazon-reviews-2023:"
IDENTITY_COLUMNS = (
    "asin", "parent_asin", "rating", "text", "timestamp", "title", "user_id",
)


# Control characters whose code Spark's JSON writes with capitals.
_CAPITAL_CODES = tuple(f"{c:04X}" for c in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)))


def record_identity() -> Column:
    """SHA-256 of the identifying columns as compact JSON, by name, nulls kept apart from blanks.

    Strings are escaped as in plain JSON: short forms or four small hexadecimal digits below U+0020, nothing above.
    """
    document = F.to_json(F.struct(*IDENTITY_COLUMNS), {"ignoreNullFields": "false"})
    small = document
    for code in _CAPITAL_CODES:
        # an escape follows an even number of backslashes
        small = F.regexp_replace(small, rf"(?<!\\)((?:\\\\)*)\\u{code}", rf"$1\\u{code.lower()}")
    capitals = F.concat_ws("", "asin", "parent_asin", "text", "title", "user_id").rlike("[\x0b\x0e\x0f\x1a-\x1f]")
    return F.sha2(F.when(capitals, small).otherwise(document), 256)


def product_id(parent_asin: Column) -> Column:
    return F.concat(F.lit(PRODUCT_PREFIX), parent_asin)


def review_id(identity: Column) -> Column:
    return F.concat(F.lit(REVIEW_PREFIX), F.substring(identity, 1, 40))


def source_record_key(identity: Column) -> Column:
    return F.concat(F.lit(RECORD_PREFIX), identity)


def _title_and_text(title: Column, text: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), text)


def input_hash(title: Column, text: Column) -> Column:
    """Hash of the labelling input."""
    return F.sha2(_title_and_text(title, text), 256)


def content_hash(title: Column, text: Column) -> Column:
    """Hash of the embedding input (stripped)."""
    return F.sha2(strip(_title_and_text(title, text)), 256)


def order_hash(salt: str | Column, key: Column) -> Column:
    """Order that looks random, ignores dates and is the same on every run."""
    prefix = F.lit(salt) if isinstance(salt, str) else salt
    return F.sha2(F.concat_ws("|", prefix, key.cast("string")), 256)


def row_id(prefix: str, *parts: Column) -> Column:
    """``prefix:sha256(a|b|...)``."""
    return F.concat(F.lit(f"{prefix}:"), F.sha2(F.concat_ws("|", *parts), 256))
