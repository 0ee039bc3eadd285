"""Stored answers: lookup, freshness, work lists, audits, digests."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark import defaults as D
from tidemark.functions.rates import percent, rounded
from tidemark.functions.text import citation_markers, collapse, percent_mentions, question_key


def analysis_snapshot(products: DataFrame, months: DataFrame) -> DataFrame:
    """Run and succeeded reviews of each product, outside any sample too."""
    counted = months.groupBy("product_id").agg(F.sum("succeeded_all").alias("_n"))
    joined = products.select("product_id", "run_id").join(counted, "product_id", "left")
    return joined.select(
        "product_id",
        F.coalesce("run_id", F.lit("not-analyzed")).alias("current_version"),
        F.when(F.col("run_id").isNull(), F.lit(0)).otherwise(F.coalesce("_n", F.lit(0)))
        .cast("bigint").alias("current_count"),
    )


def latest_answers(answers: DataFrame, accepted: Sequence[str] | None = None) -> DataFrame:
    """The newest answer per product and question among accepted prompt versions."""
    rows = answers if accepted is None else answers.filter(
        F.col("prompt_version").isin(*accepted)
    )
    keys = ["product_id", "question_key"]
    fields = [c for c in rows.columns if c not in keys]
    order = F.struct("created_at", "prompt_version")
    return (
        rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), order).alias("_a"))
        .select(*keys, "_a.*")
    )


def is_stale(
    version: Column, count: Column, current_version: Column, current_count: Column,
    ratio: float = D.STALE_RATIO, minimum: int = D.STALE_MIN_COUNT,
) -> Column:
    """Another run, or a count that moved by more than 5 % (at least two)."""
    tolerance = F.greatest(F.lit(minimum).cast("bigint"), F.ceil(count * ratio))
    return (version != current_version) | (F.abs(current_count - count) > tolerance)


def faq_list(
    snapshot: DataFrame, latest: DataFrame,
    questions: Sequence[tuple[str, str]] = D.FAQ_QUESTIONS,
) -> DataFrame:
    """Every product with each FAQ question, its stored answer and its freshness.

    The question list is fixed and short; it is attached to each product as an
    array and unrolled.
    """
    listed = F.array(*[
        F.struct(F.lit(key).alias("faq_key"), F.lit(text).alias("question"))
        for key, text in questions
    ])
    asked = snapshot.select("*", F.inline(listed)).withColumn(
        "question_key", question_key(F.col("question"))
    )
    answers = latest.select(
        "product_id", "question_key", "answer", "analysis_version", "analyzed_count",
        "prompt_version", "created_at",
    )
    return asked.join(answers, ["product_id", "question_key"], "left").withColumn(
        "is_stale",
        F.when(F.col("analysis_version").isNotNull(), is_stale(
            F.col("analysis_version"), F.col("analyzed_count"), F.col("current_version"),
            F.col("current_count"),
        )),
    )


def faq_work(listed: DataFrame, force: bool = False, only: Sequence[str] = ()) -> DataFrame:
    """FAQ answers to produce: missing or stale, or all when forced."""
    rows = listed.filter(F.col("faq_key").isin(*only)) if only else listed
    if force:
        return rows
    return rows.filter(F.col("analysis_version").isNull() | F.col("is_stale"))


@F.pandas_udf(DoubleType())
def text_similarity(head: pd.Series, previous: pd.Series) -> pd.Series:
    """Share of matching characters, ``2 * matches / total``."""
    return pd.Series([
        None if a is None or b is None else SequenceMatcher(None, a, b).ratio()
        for a, b in zip(head, previous, strict=True)
    ])


def repeats_previous(answer: Column, previous: Column) -> Column:
    """An answer whose start is nearly the remembered start of the previous one.

    What is remembered of an answer is its first 200 characters.
    """
    kept = F.substring(previous, 1, D.PREVIOUS_ANSWER_CHARS)
    head = F.substr(collapse(answer), F.lit(1), F.char_length(kept))
    similar = text_similarity(head, kept) >= D.REPEAT_SIMILARITY
    return F.coalesce((F.char_length(kept) > 0) & similar, F.lit(False))


def unknown_citations(answer: Column, source_count: Column) -> Column:
    return F.filter(citation_markers(answer), lambda n: (n < 1) | (n > source_count))


def unknown_percents(answer: Column, allowed: Column) -> Column:
    """Percentages in the answer that no allowed value explains."""
    return F.filter(
        percent_mentions(answer),
        lambda p: ~F.exists(allowed, lambda a: F.abs(p - a) <= D.PERCENT_TOLERANCE),
    )


def internal_terms(answer: Column, terms: Sequence[str] = D.INTERNAL_TERMS) -> Column:
    found = [
        F.when(F.contains(F.lower(answer), F.lit(t.lower())), F.lit(t)) for t in sorted(terms)
    ]
    return F.array_compact(F.array(*found))


def audit_answers(answers: DataFrame, check_repeats: bool = True) -> DataFrame:
    """Problems of generated answers.

    ``answers`` has ``answer, source_count, topic_sources`` (sources tied to a topic
    rather than merely related), ``allowed`` (quotable percentages) and ``previous``.
    Adds ``citations``, the cited numbers that exist, and ``problems``. Only the
    repeat check needs Python.
    """
    answer = F.col("answer")
    markers = citation_markers(answer)
    unknown = unknown_citations(answer, F.col("source_count"))
    checks = [
        F.when(F.size(unknown) > 0, "unknown_citation"),
        F.when((F.size(markers) == 0) & (F.col("topic_sources") > 0), "no_citation"),
        F.when(F.size(unknown_percents(answer, F.col("allowed"))) > 0, "unknown_percent"),
        F.when(F.size(internal_terms(answer)) > 0, "internal_term"),
    ]
    rows = answers
    if check_repeats:
        rows = rows.withColumn("_repeats", repeats_previous(answer, F.col("previous")))
        checks.append(F.when(F.col("_repeats"), "repeats_previous"))
    return rows.withColumns({
        "citations": F.array_except(markers, unknown),
        "problems": F.array_compact(F.array(*checks)),
    }).drop("_repeats")


def audit_cited_reviews(answers: DataFrame) -> DataFrame:
    """Cited review ids that are not among the retrieved ones.

    ``answers`` has arrays ``cited_review_ids`` and ``retrieved_review_ids``.
    """
    return answers.withColumn(
        "unknown_ids",
        F.array_except(F.array_distinct("cited_review_ids"), F.col("retrieved_review_ids")),
    )


def quotable_percents(
    succeeded: Column, positive_share: Column, negative_share: Column, topics: Column,
    complaints: Column | None = None, changes: Column | None = None,
    minimum: int = D.MIN_ANALYZED_FOR_RATES,
) -> Column:
    """Percentages an answer may quote; none below the minimum sample.

    ``topics`` is an array of structs with ``mention_count, negative_count,
    positive_count``, ``complaints`` one of the top complaints' negative rates and
    ``changes`` one of structs with ``baseline_rate, target_rate, change_pp``. The overall
    shares come first, then topics, complaints and, per change, before, after and
    the size of the change.
    """
    complaints = F.array().cast("array<double>") if complaints is None else complaints
    changes = F.from_json(
        F.lit("[]"), "array<struct<baseline_rate: double, target_rate: double, change_pp: double>>"
    ) if changes is None else changes

    def share(value: Column) -> Column:
        return rounded(value * 100, 1)

    overall = F.array_compact(F.array(share(positive_share), share(negative_share)))
    mentioned = F.filter(topics, lambda t: t["mention_count"] > 0)
    by_topic = F.flatten(F.transform(mentioned, lambda t: F.array(
        percent(t["negative_count"], succeeded), percent(t["positive_count"], succeeded)
    )))
    by_complaint = F.transform(F.filter(complaints, lambda r: r.isNotNull()), share)
    rated = F.filter(changes, lambda c: c["baseline_rate"].isNotNull() & c["target_rate"].isNotNull())
    by_change = F.flatten(F.transform(rated, lambda c: F.array_compact(F.array(
        share(c["baseline_rate"]), share(c["target_rate"]), rounded(F.abs(c["change_pp"]), 1)
    ))))
    everything = F.concat(overall, by_topic, by_complaint, by_change)
    return F.when(succeeded >= minimum, everything).otherwise(
        F.array().cast("array<double>")
    )


def digest_sources(examples: DataFrame, related: DataFrame) -> DataFrame:
    """Numbered evidence of each question, one entry per review.

    ``examples``: ``query_id, topic_rank, polarity, example_rank, review_id, text``;
    the first negative, then the first positive quote of each topic. ``related``:
    ``query_id, rank, review_id, title, text``; the first two related reviews follow, title
    and text together. A
    review already listed is not repeated.
    """
    first = examples.filter(
        F.col("polarity").isin("negative", "positive") & (F.col("example_rank") == 1)
    ).select(
        "query_id", "review_id", F.col("polarity").alias("label"),
        F.substring("text", 1, D.DIGEST_EXCERPT_CHARS).alias("text"),
        F.struct(F.lit(0).alias("part"), F.col("topic_rank").cast("int").alias("a"),
                 F.when(F.col("polarity") == "negative", 0).otherwise(1).alias("b")).alias("place"),
    )
    extra = related.filter(F.col("rank") <= D.RELATED_IN_DIGEST).select(
        "query_id", "review_id", F.lit(D.RELATED_LABEL).alias("label"),
        F.substring(
            collapse(F.concat_ws(" ", "title", "text")), 1, D.DIGEST_EXCERPT_CHARS).alias("text"),
        F.struct(F.lit(1).alias("part"), F.col("rank").cast("int").alias("a"),
                 F.lit(0).alias("b")).alias("place"),
    )
    once = extra.unionByName(first).groupBy("query_id", "review_id").agg(
        F.min_by(F.struct("label", "text"), F.col("place")).alias("_s"),
        F.min("place").alias("place"),
    )
    # at most two sources per topic and two related reviews
    listed = once.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "review_id", "_s"))).alias("_all")
    )
    return listed.select("query_id", F.posexplode("_all").alias("pos", "e")).select(
        "query_id", (F.col("pos") + 1).alias("number"), "e.review_id", "e._s.label", "e._s.text"
    )
