"""Batch jobs: profile a category, import a selection, build evaluation samples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import defaults as D
from tidemark.functions.text import is_hard_case
from tidemark.operators import ingest, profile, sampling
from tidemark.operators.keyed import KeyedTable
from tidemark.operators.lineage import cut
from tidemark.sources.documents import selection_problems
from tidemark.sources.shards import latest_metadata, missing_keys, require_empty
from tidemark.streaming.imports import REVIEW_TABLE_SCHEMA

PRODUCT_TABLE_SCHEMA = (
    "product_id string, source_mode string, parent_asin string, title string, category string, "
    "image_url string, metadata_json string"
)
PRODUCT_BUCKETS = 8


@dataclass(frozen=True)
class Profile:
    """Audit, windows and described candidates of one category."""

    audit: DataFrame
    possible_products: DataFrame
    windows: DataFrame
    candidates: DataFrame


def profile_category(shards: DataFrame, metadata: DataFrame, top: int = D.PROFILE_TOP) -> Profile:
    """Find products with three dense consecutive months.

    The shards are scanned once into counts per product and month; everything else
    reads those. Metadata is read for the products that have a window.
    """
    volumes = cut(profile.shard_volumes(shards))
    months = profile.candidate_months(volumes)
    windows = cut(profile.best_windows(months, volumes.agg(F.max("month_idx"))))
    described = latest_metadata(metadata, windows.select("parent_asin"))
    return Profile(
        audit=profile.audit(volumes),
        possible_products=months.select("parent_asin").distinct(),
        windows=windows,
        candidates=profile.ranked_candidates(windows, described, top=top),
    )


def import_category(
    shards: DataFrame,
    metadata: DataFrame,
    selection: DataFrame,
    product_table: str,
    review_table: str,
    per_category: int = D.PRODUCTS_PER_CATEGORY,
    per_month: int = D.WINDOW_MIN_PER_MONTH,
    smallest: int = D.WINDOW_MIN_TOTAL,
    largest: int = D.WINDOW_MAX_TOTAL,
    review_revision: str = "",
    metadata_revision: str = "",
) -> DataFrame:
    """Import a checked selection and return the import report (one row).

    Stops before writing when the selection, its metadata or its volumes break a
    rule. Products are upserted, reviews are added once; a second run adds none. Both tables are keyed
    tables in versions: a crash leaves each at a whole version, and a rerun ends where one run would have.
    """
    spark = shards.sparkSession
    require_empty(selection_problems(selection, per_category), "selection")
    described = latest_metadata(metadata, selection)
    require_empty(missing_keys(selection, described, "parent_asin"), "no metadata")
    classified = cut(ingest.only_candidate_texts(ingest.classified_rows(shards, selection)))
    unique = cut(ingest.unique_candidates(classified))
    require_empty(
        ingest.volume_problems(
            selection, ingest.imported_months(unique), per_month, smallest, largest
        ),
        "volumes",
    )
    products = ingest.product_rows(
        selection, described, review_revision=review_revision, metadata_revision=metadata_revision
    )
    upserted = KeyedTable(spark, product_table, PRODUCT_TABLE_SCHEMA, ["product_id"], PRODUCT_BUCKETS).upsert(products)
    reviews = KeyedTable(spark, review_table, REVIEW_TABLE_SCHEMA, ["source_record_key"])
    inserted = reviews.insert_once(ingest.review_rows(unique))
    ours = upserted.rows.select("product_id").join(products.select("product_id"), "product_id", "left_semi")
    return ingest.import_audit(classified).withColumns({
        "products_upserted": F.lit(ours.count()),
        "reviews_inserted": F.lit(inserted.rows.count()),
        "reviews_present": F.lit(reviews.read().join(ours, "product_id", "left_semi").count()),
    })


@dataclass(frozen=True)
class EvaluationSamples:
    """A development sample, an independent one and hard cases, all disjoint."""

    trial: DataFrame
    evaluation: DataFrame
    hard_cases: DataFrame
    overlap: DataFrame


def evaluation_samples(
    reviews: DataFrame,
    seeds: tuple[str, str, str] = ("trial-v1", "evaluation-v1", "hard-cases-v1"),
    trial_size: int = 5,
    evaluation_size: int = 10,
    products: DataFrame | None = None,
) -> EvaluationSamples:
    """Draw the samples one after the other, each without the earlier ones.

    ``reviews`` carries ``title`` and ``text`` for the hard cases: reviews of a third
    draw whose wording is easy to misread.
    """
    trial = cut(sampling.stratified_sample(reviews, trial_size, seeds[0], products=products))
    evaluation = cut(sampling.stratified_sample(
        reviews, evaluation_size, seeds[1], exclude=trial, products=products
    ))
    used = trial.select("review_id").union(evaluation.select("review_id"))
    third = sampling.stratified_sample(
        reviews, trial_size, seeds[2], exclude=used, products=products
    )
    worded = reviews.select("review_id", "title", "text")
    hard = third.join(worded, "review_id").filter(is_hard_case(F.col("title"), F.col("text")))
    return EvaluationSamples(trial, evaluation, hard, sampling.overlap(trial, evaluation))
