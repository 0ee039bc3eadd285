"""A profile that grows with its shards.

The counts of each file are stored once, by file and time of change; a later run scans the new files alone and
adds all counts up. A file that was changed counts as new, one that is gone no longer counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.keyed import KeyedTable
from tidemark.operators.lineage import cut
from tidemark.operators.profile import add_up, shard_volumes
from tidemark.sources.shards import read_reviews

FILE = ("file", "modified")
STATE_KEYS = (*FILE, "parent_asin", "month_idx")


@dataclass(frozen=True)
class Growth:
    """Counts per product and month of all shards, and the files that were scanned for them."""

    volumes: DataFrame
    scanned: list[str]


def shard_files(spark: SparkSession, *paths: str) -> DataFrame:
    """``path, file, modified`` of every Parquet file below the paths; nothing of the files is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
        "pathGlobFilter", "*.parquet").load(list(paths))
    of = F.col("_metadata")
    return listed.select("path", of["file_path"].alias("file"), of["file_modification_time"].alias("modified"))


def grow_profile(spark: SparkSession, state: str, *paths: str) -> Growth:
    """Profile all shards below the paths, scanning only files that the state at ``state`` does not have.

    A crash leaves the state as it was before. The number of new files must fit the driver, which lists them for the scan.
    """
    files = cut(shard_files(spark, *paths))
    empty = shard_volumes(read_reviews(spark, *paths).select(
        "*", F.lit("").alias("file"), F.current_timestamp().alias("modified")), *FILE)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in empty.schema)
    stored = KeyedTable(spark, state, schema, STATE_KEYS)
    known = stored.read().select(*FILE).distinct()
    fresh = sorted(r.path for r in files.join(known, list(FILE), "left_anti").select("path").collect())
    if fresh:
        rows = read_reviews(spark, *fresh)
        of = rows.metadataColumn("_metadata")
        stored.insert_once(shard_volumes(
            rows.select("*", of["file_path"].alias("file"), of["file_modification_time"].alias("modified")), *FILE))
    live = stored.read().join(files.select(*FILE), list(FILE), "left_semi")
    return Growth(add_up(live, "parent_asin", "month_idx"), fresh)
