"""Anomaly radar over every product and consecutive month pair."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import defaults as D
from tidemark.functions.rates import rounded
from tidemark.operators import compare
from tidemark.operators.facts import ISSUE
from tidemark.operators.lineage import cut
from tidemark.operators.statistics import anomaly_level, with_bh_q, with_fisher_p


@dataclass(frozen=True)
class Radar:
    """Lazily built parts of the radar."""

    pairs: DataFrame
    tests: DataFrame
    levels: DataFrame


def radar(
    months: DataFrame, rollup: DataFrame, min_analyzed: int = D.RADAR_MIN_ANALYZED
) -> Radar:
    """Test every negative issue of every pair with enough analysed reviews.

    One family of tests: the correction runs over all of them, also those that end
    without a level. Works on the two rollups only.
    """
    covered = compare.coverage(compare.consecutive_pairs(months), months).withColumn(
        "sufficient", F.least("baseline_succeeded", "target_succeeded") >= min_analyzed
    )
    evaluable = covered.filter("sufficient")
    negatives = compare.issues(
        evaluable, rollup.filter(F.col("negative") > 0)
    ).filter(F.col("polarity") == "negative")
    # the correction reads the tests several times
    tests = with_bh_q(cut(with_fisher_p(negatives))).withColumn("is_provisional", ~F.col("complete"))
    level = anomaly_level(
        F.col("p_value"), F.col("q_value"), F.col("change_pp"), F.col("target_count")
    )
    levels = tests.withColumn("level", level).filter(F.col("level").isNotNull())
    return Radar(covered, tests, levels)


def radar_summary(parts: Radar, products: DataFrame) -> DataFrame:
    """Products, pairs and tests counted, in one row."""
    pairs = parts.pairs.agg(
        F.count_if("sufficient").alias("pairs_evaluated"),
        F.count_if(~F.col("sufficient")).alias("pairs_insufficient"),
        F.count_distinct(F.when(F.col("sufficient"), F.col("product_id"))).alias(
            "products_evaluable"
        ),
    )
    return pairs.select(
        products.agg(F.count(F.lit(1))).scalar().alias("products_total"),
        "products_evaluable", "pairs_evaluated", "pairs_insufficient",
        parts.tests.agg(F.count(F.lit(1))).scalar().alias("tests"),
    )


def radar_items(
    parts: Radar, products: DataFrame | None = None, evidence: DataFrame | None = None,
    evidence_ids: int = D.RADAR_EVIDENCE,
) -> DataFrame:
    """Radar rows as shown: rounded p and q, first evidence ids, product fields."""
    # few rows are left; stored, their true size decides how they meet the evidence
    levels = parts.levels if evidence is None else cut(parts.levels)
    rows = levels.drop("meets_threshold", "complete", "polarity")
    if evidence is not None:
        found = compare.first_evidence(
            levels, evidence.filter(F.col("polarity") == "negative"), evidence_ids
        ).drop("polarity")
        rows = rows.join(found, [*compare.PAIR, *ISSUE], "left")
    if products is not None:
        rows = rows.join(products, "product_id")
    return rows.withColumns({
        "p_value": rounded(F.col("p_value"), 5), "q_value": rounded(F.col("q_value"), 5)
    })


def radar_order() -> list[F.Column]:
    """Anomalies first, then by q and by size of the increase."""
    return [F.col("level"), F.col("q_value"), F.desc("change_pp")]
