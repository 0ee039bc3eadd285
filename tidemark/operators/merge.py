"""Keyed, idempotent merges.

The functions on frames describe the merged table. The functions on paths apply a
merge to a stored table: ``append_once`` to a keyed table in versions (see
``tidemark.operators.keyed``), ``upsert_partitions`` to a partitioned Parquet table, of
which only partitions that receive updates are read and replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidemark.operators.keyed import KeyedTable, is_keyed


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: F.Column) -> DataFrame:
    """The last row of each key by ``order``; reduces in the map tasks first."""
    fields = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), order).alias("_last"))
        .select(*keys, "_last.*").select(*rows.columns)
    )


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Updates replace target rows with the same key; other target rows stay."""
    kept = target.join(updates.select(*keys), list(keys), "left_anti")
    return kept.unionByName(updates.select(*target.columns))


def new_rows(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key is not stored, once each."""
    return incoming.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


ANSWER_KEY = ("product_id", "question_key", "prompt_version")


def merge_answers(stored: DataFrame, saved: DataFrame) -> DataFrame:
    """Store answers; a later cache save keeps the ``faq`` kind of a stored row.

    ``saved`` has at most one row per key (see :func:`latest_per_key`) and only
    answered, non-empty answers are stored.
    """
    fresh = saved.filter(
        (F.col("status") == "answered") & (F.coalesce(F.col("answer"), F.lit("")) != "")
    )
    key = list(ANSWER_KEY)
    joined = (
        stored.select(*key, F.struct(*stored.columns).alias("s"))
        .join(fresh.select(*key, F.struct(*stored.columns).alias("u")), key, "full_outer")
    )
    keeps_kind = F.col("u.faq_key").isNull() & F.col("s").isNotNull() & F.col("u").isNotNull()

    def pick(column: str) -> F.Column:
        if column in ("kind", "faq_key"):
            own = F.when(F.col("u").isNotNull(), F.col(f"u.{column}")).otherwise(
                F.col(f"s.{column}")
            )
            return F.when(keeps_kind, F.col(f"s.{column}")).otherwise(own).alias(column)
        return F.when(F.col("u").isNotNull(), F.col(f"u.{column}")).otherwise(
            F.col(f"s.{column}")
        ).alias(column)

    return joined.select(*[c if c in key else pick(c) for c in stored.columns])


def seed_evaluations(stored: DataFrame, listed: DataFrame, dataset_id: str) -> DataFrame:
    """Put listed reviews into an evaluation set without touching human input.

    ``listed`` has ``position, review_id``. New reviews start pending with an empty
    list of gold labels; known ones only get their position and split again.
    """
    ours = stored.filter(F.col("dataset_id") == dataset_id)
    others = stored.filter(F.col("dataset_id") != dataset_id)
    joined = ours.drop("dataset_id").join(
        listed.select("review_id", F.col("position").alias("_position")), "review_id", "full_outer"
    )
    is_listed = F.col("_position").isNotNull()
    is_new = F.col("status").isNull()
    values = {
        "dataset_id": F.lit(dataset_id),
        "position": F.coalesce("_position", "position").cast("int"),
        "split": F.when(is_listed, F.lit("independent_evaluation")).otherwise(F.col("split")),
        "prompt_tuning_used": F.when(is_listed, F.lit(False)).otherwise(
            F.col("prompt_tuning_used")
        ),
        "status": F.coalesce("status", F.lit("pending")),
        "is_normal_empty": F.when(is_new, F.lit(False)).otherwise(F.col("is_normal_empty")),
    }
    if "gold_labels" in stored.columns:
        empty = F.array().cast(stored.schema["gold_labels"].dataType)
        values["gold_labels"] = F.when(is_new, empty).otherwise(F.col("gold_labels"))
    merged = joined.select(*[values.get(c, F.col(c)).alias(c) for c in stored.columns])
    return others.unionByName(merged)


def seed_counts(stored: DataFrame, listed: DataFrame, dataset_id: str) -> DataFrame:
    """How many listed reviews a seeding inserts and how many it preserves."""
    known = stored.filter(F.col("dataset_id") == dataset_id).select(
        "review_id", F.lit(True).alias("_known")
    )
    return listed.join(known, "review_id", "left").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("_known").isNull()).alias("inserted"),
        F.count("_known").alias("preserved"),
    )


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, keyed or plain, empty when nothing was written yet."""
    if is_keyed(spark, path):
        return KeyedTable(spark, path, schema, ()).read()
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_once(incoming: DataFrame, path: str, schema: str, key: str) -> None:
    """Add the rows that are not stored to a keyed table; running it again adds nothing."""
    KeyedTable(incoming.sparkSession, path, schema, [key]).insert_once(incoming)


def upsert_partitions(
    updates: DataFrame, path: str, schema: str, keys: Sequence[str], partition_by: Sequence[str]
) -> None:
    """Upsert into a table partitioned by ``partition_by`` (part of the key).

    Only partitions named in the updates are read, merged and replaced.
    """
    spark = updates.sparkSession
    parts = list(partition_by)
    stored = read_table(spark, path, schema)
    touched = stored.join(updates.select(*parts).distinct(), parts, "left_semi")
    (
        upsert(touched, updates, keys)
        .repartition(*parts, *[k for k in keys if k not in parts])
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*parts).parquet(path)
    )
