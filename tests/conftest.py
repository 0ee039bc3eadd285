"""Shared session and the small review catalog the golden tests use."""

from __future__ import annotations

import os
import sys
from datetime import datetime, timedelta

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


# Distinct-review counts of the catalog, month by month. Each entry is one review:
# its rating and its labels (aspect, detail, polarity).
LEAK = ("reliability", "carafe leak", "negative")
ODOR = ("material", "plastic odor", "negative")
HEAT = ("temperature", "heat retention", "positive")
CONTROLS = ("usability", "controls", "positive")
SPEED = ("performance", "brewing speed", "positive")
NOISE = ("noise", "fan noise", "negative")
CRISP = ("cooking", "crispness", "positive")
EVEN = ("cooking", "evenness", "positive")
CLEAN = ("usability", "cleaning", "positive")

CATALOG = {
    ("coffee", "2025-01"): [
        (5, [SPEED, HEAT]), (4, [("usability", "pouring", "positive"), CONTROLS]), (2, [LEAK]),
        (5, [("usability", "timer", "positive")]), (4, [("quality", "taste", "positive"), CLEAN]),
        (4, [HEAT]),
    ],
    ("coffee", "2025-02"): [
        # two quotes of one issue in the first review
        (1, [LEAK, LEAK]), (2, [LEAK]), (2, [LEAK, HEAT]), (3, [ODOR]), (5, [CONTROLS]),
        (4, [SPEED]),
    ],
    ("airfryer", "2025-01"): [
        (2, [NOISE]), (2, [NOISE]), (3, [NOISE, CRISP]), (5, [EVEN]), (4, [CLEAN]),
        (3, [("capacity", "basket size", "negative")]),
    ],
    ("airfryer", "2025-02"): [
        (2, [NOISE]), (5, [CRISP]), (5, [EVEN]), (4, [CRISP, ("usability", "presets", "positive")]),
        (4, [CLEAN]), (5, [EVEN]),
    ],
}
RUN = "fixture-run"


def catalog_rows():
    reviews, results, labels = [], [], []
    for (product, month), entries in CATALOG.items():
        start = datetime.fromisoformat(f"{month}-02T10:00:00")
        for n, (rating, marks) in enumerate(entries, start=1):
            rid = f"{product}-{month}-{n:02d}"
            reviews.append((product, rid, "fixture", rating, start + timedelta(days=4 * n), True))
            results.append((RUN, rid, "succeeded"))
            for k, (aspect, detail, polarity) in enumerate(marks, start=1):
                labels.append((RUN, rid, f"{rid}:{k}", aspect, detail, polarity, f"quote {k}"))
    # another run's labels and results must never be mixed in
    results.append(("old-run", "coffee-2025-01-01", "succeeded"))
    labels.append(("old-run", "coffee-2025-01-01", "old", *LEAK, "old quote"))
    # an ineligible review counts nowhere
    reviews.append(("coffee", "bad", "fixture", 1, datetime(2025, 1, 5), False))
    return reviews, results, labels


@pytest.fixture(scope="session")
def catalog(spark):
    """Tables and rollups of the catalog."""
    from types import SimpleNamespace

    from tidemark.operators import facts

    r, s, l = catalog_rows()
    reviews = spark.createDataFrame(
        r, "product_id string, review_id string, source_mode string, rating int, "
           "reviewed_at timestamp, eligible boolean")
    results = spark.createDataFrame(s, "run_id string, review_id string, status string")
    labels = spark.createDataFrame(
        l, "run_id string, review_id string, label_id string, aspect string, detail string, "
           "polarity string, evidence string")
    runs = spark.createDataFrame(
        [(RUN, "fixture", True, datetime(2025, 3, 1)), ("old-run", "fixture", False, datetime(2025, 4, 1))],
        "run_id string, source_mode string, is_active boolean, created_at timestamp")
    products = spark.createDataFrame(
        [("coffee", "fixture", "Kitchen"), ("airfryer", "fixture", "Kitchen")],
        "product_id string, source_mode string, category string")
    products = facts.attach_active_run(products, runs)
    scoped = facts.scoped_reviews(reviews, products)
    months = facts.month_rollup(facts.review_facts(scoped, results, labels)).cache()
    label_rows = facts.analysed_labels(scoped, results, labels)
    issues = facts.issue_facts(label_rows)
    return SimpleNamespace(
        reviews=reviews, results=results, labels=labels, runs=runs, products=products,
        scoped=scoped, months=months, label_rows=label_rows, issue_facts=issues,
        rollup=facts.issue_rollup(issues).cache(),
    )
