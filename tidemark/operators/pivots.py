"""Exact nearest vectors with pruning by the triangle inequality.

Of each product and model a few vectors are pivots, and every vector's distances to them are stored with it. Distance is the
chord between directions, which grows with the cosine distance and obeys the triangle inequality; so a query's
distances to the same pivots bound its distance to every vector from both sides, by a few subtractions
in place of a whole product. Vectors whose lower bound lies beyond the k-th best known distance are never multiplied.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import defaults as D
from tidemark.functions.hashing import order_hash
from tidemark.functions.months import index_of_key, month_index
from tidemark.functions.rates import rounded
from tidemark.functions.vectors import cosine, dot, norm
from tidemark.operators.lineage import cut
from tidemark.operators.topk import top_per_group

PIVOTS = 8
GROUP = ["product_id", "model"]
SLACK = 1e-7  # what rounding can add to a bound: chords of nearly equal directions lose half their digits
FARTHEST = 2.0


@dataclass(frozen=True)
class PivotIndex:
    """Stored vectors with their distances to the pivots of their product, and the pivots."""

    vectors: DataFrame
    pivots: DataFrame


def chord(distance: Column) -> Column:
    """Distance of two directions from their cosine distance."""
    return F.sqrt(F.greatest(2 * distance, F.lit(0.0)))


def _distance(a: Column, norm_a: Column, b: Column, norm_b: Column) -> Column:
    return 1 - cosine(dot(a, b), norm_a, norm_b)


def _far(vector: Column, length: Column, pivots: Column) -> Column:
    """Distances to the pivots; null for a vector without direction, which is bounded by nothing."""
    return F.when(length > 0, F.transform(
        pivots, lambda p: chord(_distance(vector, length, p["embedding"], p["norm"]))))


def pivot_index(reviews: DataFrame, embeddings: DataFrame, pivots: int = PIVOTS, salt: str = "pivots") -> PivotIndex:
    """Index of the eligible reviews' vectors; pivots are the first with a direction in a hash order."""
    dated = reviews.filter("eligible").select(
        "product_id", "review_id", month_index(F.col("reviewed_at")).alias("month_idx"))
    vectors = dated.join(embeddings.select("review_id", "model", "embedding"), "review_id").withColumn(
        "norm", norm(F.col("embedding")))
    hashed = vectors.filter("norm > 0").select(*GROUP, "review_id", order_hash(salt, F.col("review_id")).alias("h"))
    first = top_per_group(hashed, GROUP, [F.col("h"), F.col("review_id")], pivots).select(*GROUP, "review_id", "rank")
    chosen = cut(first.join(vectors, [*GROUP, "review_id"]).groupBy(*GROUP).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "embedding", "norm"))),
        lambda p: F.struct(p["embedding"].alias("embedding"), p["norm"].alias("norm"))).alias("pivots")))
    placed = vectors.join(chosen, GROUP, "left").withColumn("far", _far(F.col("embedding"), F.col("norm"), F.col("pivots")))
    return PivotIndex(cut(placed.drop("pivots")), chosen)


@dataclass(frozen=True)
class Found:
    """The closest reviews of every query, and how many vectors it had and multiplied."""

    nearest: DataFrame
    effort: DataFrame


def nearest_indexed(queries: DataFrame, index: PivotIndex, limit: int = D.SEARCH_LIMIT) -> Found:
    """The ``limit`` closest reviews of each query's product and months; the same rows as a search without index.

    ``queries`` has ``query_id, product_id, months, vector, model``; months are ``YYYY-MM`` or null for all.
    """
    length = norm(F.col("vector"))
    asked = cut(queries.join(index.pivots, GROUP, "left").select(
        "query_id", *GROUP, "vector", F.transform("months", index_of_key).alias("_months"), length.alias("_length"),
        _far(F.col("vector"), length, F.col("pivots")).alias("_query_far")))
    in_period = F.col("_months").isNull() | F.array_contains("_months", F.col("month_idx"))
    gaps = F.zip_with("far", "_query_far", lambda a, b: F.abs(a - b))
    ways = F.zip_with("far", "_query_far", lambda a, b: a + b)
    met = index.vectors.join(asked, GROUP).filter(in_period).withColumns({
        "_low": F.coalesce(F.array_max(gaps), F.lit(0.0)),
        "_high": F.coalesce(F.array_min(ways), F.lit(FARTHEST)),
    })
    distance = _distance(F.col("embedding"), F.col("norm"), F.col("vector"), F.col("_length"))

    def bar(rows: DataFrame, value: Column) -> DataFrame:
        """The k-th best of a query; none if it has fewer."""
        return rows.groupBy("query_id").agg(
            F.when(F.count(F.lit(1)) >= limit, F.max(value)).alias("bar"))

    by_high = top_per_group(met.select("query_id", "review_id", "_high"), ["query_id"],
                            [F.col("_high"), F.col("review_id")], limit)
    by_low = top_per_group(met.select("query_id", "review_id", "_low", distance.alias("d")), ["query_id"],
                           [F.col("_low"), F.col("review_id")], limit)
    bars = cut(bar(by_high, F.col("_high")).unionByName(bar(by_low, chord(F.col("d")))).groupBy("query_id").agg(
        F.min("bar").alias("_bar")))
    open_ = F.col("_bar").isNull() | (F.col("_low") <= F.col("_bar") + SLACK)
    judged = met.join(bars, "query_id").withColumn("_open", open_)
    effort = judged.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if("_open").alias("multiplied"))
    scored = judged.filter("_open").select("query_id", "product_id", "review_id", distance.alias("distance"))
    best = top_per_group(scored, ["query_id"], [F.col("distance"), F.col("review_id")], limit)
    return Found(best.withColumn("similarity", rounded(1 - F.col("distance"), 4)), effort)
