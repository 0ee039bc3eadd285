"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.lineage import cut, scratch

__all__ = ["bound_batches", "cut", "numbered", "part_count", "placed", "release_memory", "released", "scratch", "without"]

ROW = "_row"
DOC = "_doc"
PLACE = "_place"
BATCH_ROWS = 2000


def numbered(df: DataFrame, *columns: F.Column | str) -> DataFrame:
    """The chosen columns with a row number in ``_row``, stored.

    Keys of the input may be null or repeat; the stored number tells its rows apart. It is
    computed in the job that writes the table, so later reads agree on it.
    """
    return cut(df.select(F.monotonically_increasing_id().alias(ROW), *columns))


def placed(df: DataFrame, stored: bool) -> DataFrame:
    """All columns in the struct ``_doc``, and in ``_place`` the file of each row and its number in it.

    A row's place tells it from every other and any later scan finds it again, so nothing is copied if ``df`` is
    ``stored``: a table as read from Parquet, no row of it repeated by a join or explode. Otherwise it is stored first.
    """
    df = df.select(F.struct("*").alias(DOC)) if stored else cut(df.select(F.struct("*").alias(DOC)))
    of = df.metadataColumn("_metadata")
    return df.select(DOC, F.struct(of["file_path"].alias("file"), of["row_index"].alias("at")).alias(PLACE))


def without(rows: DataFrame, places: DataFrame) -> DataFrame:
    """The documents of ``placed`` rows, but those at the given places (``file, at``)."""
    gone = places.select(F.col("file").alias("_file"), F.col("at").alias("_at"))
    at = F.col(PLACE)
    return rows.join(gone, (at["file"] == F.col("_file")) & (at["at"] == F.col("_at")), "left_anti").select(f"{DOC}.*")


def part_count(df: DataFrame) -> int:
    """Shuffle partitions of the session, for explicit repartitioning by a key."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bound_batches(spark: SparkSession) -> None:
    """Let Python get ``BATCH_ROWS`` rows at once at most: a batch is held by the JVM and by Python. The setting stays in the session."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = int(spark.conf.get(name))
    spark.conf.set(name, str(min(own, BATCH_ROWS) if own > 0 else BATCH_ROWS))


def release_memory() -> None:
    """Give freed memory of a Python worker back: it lives on between tasks and would keep each one's peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task that releases its memory at the end."""
    try:
        yield from batches
    finally:
        release_memory()
