"""Top-k per group and exact ranks that survive hot groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows of each group.

    The limit on ``row_number`` lets Spark keep at most ``k`` rows per group in
    every map task, so a hot group ships ``k`` rows per task to its reducer.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """One page of a sorted listing."""
    if number < 1 or size < 1:
        raise ValueError("page number and size start at 1")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def total(df: DataFrame) -> DataFrame:
    """Row count of a listing, asked for apart from its pages."""
    return df.agg(F.count(F.lit(1)).alias("total"))


SLICE_DIGITS = 2  # hash digits that tell the slices of a group: at most 256


def slice_counts(df: DataFrame, keys: Sequence[str], hash_col: str) -> DataFrame:
    """``keys, _slice, _n, _before``: rows of each slice of a group, and rows in the slices before it.

    Slices are the first digits of the hash, which follow its order. Counted in the map tasks first.
    """
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.groupBy(*keys, F.substring(hash_col, 1, SLICE_DIGITS).alias("_slice"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    )


def rank_in_slices(
    df: DataFrame,
    slices: DataFrame,
    keys: Sequence[str],
    hash_col: str,
    id_col: str,
    limit: str | None = None,
    rank: str = "rank",
) -> DataFrame:
    """Exact 1-based rank by (hash, id) inside each group, from its counted slices.

    Rows take on the further columns of their slice. Rows whose slice is not listed are dropped by the join, before
    anything is sorted, and in the scan itself where the slices are few enough to be broadcast;
    so with slices up to a ``limit`` only about as many rows as that are shuffled. A slice is ranked by one
    task, a group by up to 256.
    """
    inner = Window.partitionBy(*keys, "_slice").orderBy(hash_col, id_col)
    placed = df.withColumn("_slice", F.substring(hash_col, 1, SLICE_DIGITS)).join(slices.drop("_n"), [*keys, "_slice"])
    ranked = placed.withColumn(rank, F.col("_before") + F.row_number().over(inner))
    if limit is not None:
        ranked = ranked.filter(F.col(rank) <= F.col(limit))
    return ranked.drop("_slice", "_before")


def hash_rank(
    df: DataFrame,
    keys: Sequence[str],
    hash_col: str,
    id_col: str,
    limit: str | None = None,
    rank: str = "rank",
) -> DataFrame:
    """Exact 1-based rank by (hash, id) inside each group, groups split into slices.

    With ``limit`` (a column, the same for all rows of a group) only ranks up to it are kept.
    """
    keys = list(keys)
    slices = slice_counts(df, [*keys, limit] if limit else keys, hash_col)
    if limit is not None:
        slices = slices.filter(F.col("_before") < F.col(limit)).drop(limit)
    return rank_in_slices(df, slices, keys, hash_col, id_col, limit, rank)


def cumulative_counts(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    count: str,
    pieces: int | None = None,
) -> DataFrame:
    """Running count over the values of each group, without one task per group.

    ``df`` has one row per (keys, value) with its ``count``. Adds ``piece`` (a value
    range), ``at_most`` (rows with a value up to this one) and ``total``. Ranges are
    cut at approximate quantiles, so rows spread evenly even when all share one key;
    only the per-range sums, at most ``pieces + 1`` per key, are summed in one place.
    By default there are as many ranges as the session has shuffle partitions.
    """
    keys = list(keys)
    pieces = pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts_at = F.array(*[F.lit(i / pieces) for i in range(1, pieces)])
    cuts = df.groupBy(*keys).agg(
        F.array_distinct(F.percentile_approx(value, cuts_at, F.lit(10_000))).alias("_cuts")
    )
    cut = F.filter("_cuts", lambda c: c < F.col(value))
    if keys:
        pieced = df.join(cuts, keys).withColumn("piece", F.size(cut)).drop("_cuts")
    else:
        pieced = df.withColumn("_cuts", cuts.scalar()).withColumn("piece", F.size(cut)).drop("_cuts")
    per_piece = pieced.groupBy(*keys, "piece").agg(F.sum(count).alias("_n"))
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    before = group.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_piece.select(
        *keys, "piece",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(group).alias("total"),
    )
    inner = Window.partitionBy(*keys, "piece").orderBy(value)
    return (
        pieced.join(offsets, [*keys, "piece"])
        .withColumn("at_most", F.col("_before") + F.sum(count).over(inner))
        .drop("_before")
    )
