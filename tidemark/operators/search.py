"""Exact vector search inside a product and period, nearest topics, best FAQ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import defaults as D
from tidemark.functions.months import index_of_key, month_index
from tidemark.functions.rates import rounded
from tidemark.functions.vectors import cosine, dot, norm
from tidemark.operators.lineage import bounded
from tidemark.operators.topk import top_per_group

MOST_TOPICS = 10_000  # of all categories together; they are put into one row
MOST_QUESTIONS = 1_000


def nearest_reviews(
    queries: DataFrame, reviews: DataFrame, embeddings: DataFrame, limit: int = D.SEARCH_LIMIT
) -> DataFrame:
    """The ``limit`` closest reviews of each query's product and months.

    ``queries`` has ``query_id, product_id, months, vector, model``; months are
    ``YYYY-MM`` or null for all. Product and period cut the reviews before they
    meet the vectors; norms are computed once per vector. Every task keeps only its best
    ``limit`` per query, so a hot product does not gather in one place.
    """
    if not 1 <= limit <= 30:
        raise ValueError("limit must be between 1 and 30")
    asked = queries.select(
        "query_id", "product_id", "model", "vector",
        F.transform("months", index_of_key).alias("_months"),
        norm(F.col("vector")).alias("_query_norm"),
    )
    in_period = F.col("_months").isNull() | F.array_contains("_months", F.col("_month"))
    dated = reviews.filter("eligible").select(
        "product_id", "review_id", month_index(F.col("reviewed_at")).alias("_month")
    )
    scope = asked.select("product_id", "_months")
    wanted = dated.join(
        scope,
        (dated["product_id"] == scope["product_id"])
        & (scope["_months"].isNull() | F.array_contains(scope["_months"], dated["_month"])),
        "left_semi",
    )
    vectors = embeddings.select("review_id", "model", "embedding")
    candidates = wanted.join(vectors, "review_id").withColumn("_norm", norm(F.col("embedding")))
    scored = (
        candidates.join(asked, ["product_id", "model"])
        .filter(in_period)
        .withColumn("distance", 1 - cosine(
            dot(F.col("embedding"), F.col("vector")), F.col("_norm"), F.col("_query_norm")
        ))
        .select("query_id", "product_id", "review_id", "distance")
    )
    best = top_per_group(scored, ["query_id"], [F.col("distance"), F.col("review_id")], limit)
    return best.withColumn("similarity", rounded(1 - F.col("distance"), 4))


def search_coverage(
    queries: DataFrame, reviews: DataFrame, embeddings: DataFrame
) -> DataFrame:
    """Embedded and total reviews in each query's product and months.

    Reviews are cut to the asked products and months, counted, and looked up by the
    queries.
    """
    wanted = queries.select(
        "query_id", "product_id", "model",
        F.explode(F.array_distinct(F.transform("months", index_of_key))).alias("_month"),
    )
    counted = (
        reviews.filter("eligible")
        .select("product_id", "review_id", month_index(F.col("reviewed_at")).alias("_month"))
        .join(wanted.select("product_id", "_month").distinct(), ["product_id", "_month"], "left_semi")
    )
    totals = counted.groupBy("product_id", "_month").agg(F.count(F.lit(1)).alias("total"))
    per_model = counted.join(embeddings.select("review_id", "model"), "review_id").distinct().groupBy(
        "product_id", "_month", "model"
    ).agg(F.count(F.lit(1)).alias("embedded"))
    found = wanted.join(totals, ["product_id", "_month"], "left").join(
        per_model, ["product_id", "_month", "model"], "left"
    )
    zero = F.lit(0).cast("bigint")
    return found.groupBy("query_id").agg(
        F.coalesce(F.sum("embedded"), zero).alias("embedded_reviews"),
        F.coalesce(F.sum("total"), zero).alias("total_reviews"),
    )


def pending_embeddings(reviews: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Reviews without a vector for their current text.

    ``reviews`` carries ``content_hash``; a changed text has another hash.
    """
    return reviews.filter("eligible").join(
        embeddings.select("review_id", "content_hash"), ["review_id", "content_hash"], "left_anti"
    )


def topic_vectors(taxonomy: DataFrame) -> DataFrame:
    """The vectors of each category's topics as one array.

    ``taxonomy`` has ``category, aspect, detail, vector``: a fixed list of some tens
    of entries per category, so the array is small and queries need no pair rows.
    """
    entry = F.struct("aspect", "detail", "vector", norm(F.col("vector")).alias("norm"))
    return bounded(taxonomy, MOST_TOPICS, "taxonomy").groupBy("category").agg(F.sort_array(F.collect_list(entry)).alias("_topics"))


def nearest_topics(
    queries: DataFrame, topics: DataFrame, k: int = D.NEAREST_TOPICS
) -> DataFrame:
    """The ``k`` topics closest to each query: rank, aspect, detail, similarity.

    ``queries`` has ``query_id, category, vector``; ``topics`` comes from
    :func:`topic_vectors`. Equal similarities keep code order. The fixed topic lists ride
    along as one map, so queries stay where they are; a category without topics gives
    no rows.
    """
    lists = topics.agg(F.map_from_entries(F.collect_list(F.struct("category", "_topics")))).scalar()
    asked = queries.filter(F.col("category").isNotNull()).withColumns({
        "_norm": norm(F.col("vector")), "_topics": F.try_element_at(lists, F.col("category")),
    }).filter(F.col("_topics").isNotNull())
    scored = F.transform("_topics", lambda t: F.struct(
        (-cosine(dot(t["vector"], F.col("vector")), t["norm"], F.col("_norm"))).alias("away"),
        t["aspect"].alias("aspect"), t["detail"].alias("detail"),
    ))
    best = F.slice(F.array_sort(scored), 1, k)
    return asked.select("query_id", F.posexplode(best).alias("pos", "t")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), "t.aspect", "t.detail",
        rounded(-F.col("t.away"), 3).alias("similarity"),
    )


def best_faq(
    queries: DataFrame, faq_vectors: DataFrame, threshold: float = D.FAQ_MATCH_SIMILARITY
) -> DataFrame:
    """The closest FAQ of each query, kept only when it is close enough.

    ``faq_vectors`` (``faq_key, vector, position``) is the fixed question list; it rides
    along each query as one array. Among equals the first of the list is taken.
    """
    entry = F.struct("position", "faq_key", "vector", norm(F.col("vector")).alias("norm"))
    listed = bounded(faq_vectors, MOST_QUESTIONS, "questions").agg(F.sort_array(F.collect_list(entry))).scalar()
    scored = F.transform("_faq", lambda t: F.struct(
        cosine(dot(t["vector"], F.col("vector")), t["norm"], F.col("_norm")).alias("similarity"),
        (-t["position"]).alias("place"), t["faq_key"].alias("faq_key"),
    ))
    return (
        queries.withColumns({"_norm": norm(F.col("vector")), "_faq": listed})
        .withColumn("_best", F.array_max(scored))
        .filter(F.col("_best.similarity") >= threshold)
        .select("query_id", "_best.faq_key", "_best.similarity")
    )
