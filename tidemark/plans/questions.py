"""Facts for answering questions about a product, without a language model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import defaults as D
from tidemark.functions.rates import rounded
from tidemark.operators import search
from tidemark.operators.answers import digest_sources, quotable_percents
from tidemark.operators.facts import ISSUE
from tidemark.plans.insights import label_examples


@dataclass(frozen=True)
class QuestionFacts:
    """Parts of an instant answer, each keyed by ``query_id``."""

    topics: DataFrame
    examples: DataFrame
    related: DataFrame
    sources: DataFrame
    percents: DataFrame


def question_facts(
    queries: DataFrame,
    taxonomy: DataFrame,
    overview: DataFrame,
    aspects: DataFrame,
    label_rows: DataFrame,
    reviews: DataFrame,
    embeddings: DataFrame,
    complaints: DataFrame,
    changes: DataFrame,
) -> QuestionFacts:
    """Nearest topics with their statistics and quotes, related reviews, digest.

    ``queries`` has ``query_id, product_id, category, months, vector, model``;
    ``reviews`` carries ``title`` and ``text`` for related excerpts; ``complaints`` and
    ``changes`` are those of the product report. Topics come first, so quotes
    are looked up only for the few issues the questions are about.
    """
    asked = queries.select("query_id", "product_id", "category", "vector")
    nearest = search.nearest_topics(asked, search.topic_vectors(taxonomy)).join(
        queries.select("query_id", "product_id"), "query_id"
    )
    counts = ["mention_count", "positive_count", "negative_count"]
    stats = aspects.select("product_id", *ISSUE, *counts)
    topics = nearest.join(stats, ["product_id", *ISSUE], "left").withColumns(
        {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in counts}
    )

    sides = F.explode(F.array(F.lit("negative"), F.lit("positive"))).alias("polarity")
    wanted = nearest.select("product_id", *ISSUE, sides).distinct()
    quotes = label_examples(label_rows, D.TOPIC_EXAMPLES, wanted)
    examples = nearest.select("query_id", "product_id", F.col("rank").alias("topic_rank"), *ISSUE).join(
        quotes.withColumnRenamed("rank", "example_rank"), ["product_id", *ISSUE]
    ).withColumn("text", F.substring("evidence", 1, D.QUICK_EXCERPT_CHARS))

    found = search.nearest_reviews(queries, reviews, embeddings, D.RELATED_REVIEWS)
    related = found.join(
        reviews.select("review_id", "rating", F.to_date("reviewed_at").alias("date"), "title", "text"),
        "review_id",
    ).withColumns({
        "title": F.coalesce("title", F.lit("")),
        "text": F.substring("text", 1, D.QUICK_EXCERPT_CHARS),
        "similarity": rounded(1 - F.col("distance"), 3),
    })

    shown = label_rows.join(related.select("review_id").distinct(), "review_id", "left_semi")
    names = shown.groupBy("review_id").agg(F.array_sort(F.collect_set(
        F.concat_ws(":", "detail", "polarity"))).alias("labels"))
    related = related.join(names, "review_id", "left").withColumn(
        "labels", F.coalesce("labels", F.array().cast("array<string>")))

    listed = topics.groupBy("query_id", "product_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "mention_count", "negative_count", "positive_count"
    ))).alias("topics"))
    worst = complaints.groupBy("product_id").agg(F.transform(F.array_sort(F.collect_list(
        F.struct("rank", "negative_rate"))), lambda c: c["negative_rate"]).alias("complaints"))
    rose = changes.filter(F.col("rank") <= D.CHANGES_IN_DIGEST).groupBy("product_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "baseline_rate", "target_rate", "change_pp"))
                     ).alias("changes"))
    facts = listed.join(overview, "product_id").join(worst, "product_id", "left").join(
        rose, "product_id", "left")
    percents = facts.select("query_id", quotable_percents(
        F.col("succeeded"), F.col("positive_share"), F.col("negative_share"), F.col("topics"),
        F.coalesce("complaints", F.array().cast("array<double>")),
        F.coalesce("changes", F.from_json(F.lit("[]"), facts.schema["changes"].dataType)),
    ).alias("percents"))
    return QuestionFacts(
        topics=topics,
        examples=examples,
        related=related,
        sources=digest_sources(examples, related),
        percents=percents,
    )


def fresh_faq_match(best: DataFrame, queries: DataFrame, faq_rows: DataFrame) -> DataFrame:
    """The matched FAQ answer of each query, when one is stored and fresh."""
    return (
        best.join(queries.select("query_id", "product_id"), "query_id")
        .join(faq_rows, ["product_id", "faq_key"])
        .filter(F.col("answer").isNotNull() & ~F.col("is_stale"))
    )
