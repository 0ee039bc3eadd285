from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import hashing, products, rates, text, vectors
from tidemark.functions.evidence import find_evidence, highlight_spans
from tidemark.functions.months import (
    in_months,
    index_of_key,
    key_of_index,
    parse_month,
    shift_month,
    timestamp_from_millis,
)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("month, delta, expected", [
    ("2023-01", -2, "2022-11"), ("2023-12", 1, "2024-01"), ("2023-06", 0, "2023-06"),
])
def test_month_shift(spark, month, delta, expected):
    assert one(spark, shift_month(F.lit(month), delta))[0] == expected


@pytest.mark.parametrize("bad", ["2025-00", "2025-13", "25-01", "2025/01"])
def test_invalid_months(spark, bad):
    with pytest.raises(ValueError):
        parse_month(bad)
    assert one(spark, index_of_key(F.lit(bad)))[0] is None


def test_month_boundaries_are_utc(spark):
    rows = spark.createDataFrame([(1612137599999,), (1612137600000,), (10**15,)], "ms bigint")
    ts = timestamp_from_millis(F.col("ms"))
    got = [r[0] for r in rows.select(key_of_index(F.year(ts) * 12 + F.month(ts) - 1)).collect()]
    assert got[:2] == ["2021-01", "2021-02"] and not got[2]


def test_adjacent_months_become_one_range(spark):
    rows = spark.createDataFrame(
        [("2024-12-31 23:59:59",), ("2025-01-01 00:00:00",), ("2025-02-28 10:00:00",),
         ("2025-03-01 00:00:00",)], "t string").withColumn("t", F.to_timestamp("t"))
    test = in_months(F.col("t"), ["2025-02", "2025-01"])
    assert [r[0] for r in rows.select(test).collect()] == [False, True, True, False]


@pytest.mark.parametrize("counts, expected", [
    ((0, 0, 0, 0), "not_started"), ((10, 2, 0, 0), "in_progress"), ((100, 50, 1, 0), "in_progress"),
    ((100, 98, 1, 1), "in_progress"), ((10, 10, 0, 0), "complete"), ((125, 124, 1, 0), "complete"),
    ((100, 95, 5, 0), "complete"), ((100, 94, 6, 0), "partial_failure"),
    ((10, 8, 2, 0), "partial_failure"),
])
def test_period_status(spark, counts, expected):
    assert one(spark, rates.period_status(*[F.lit(c) for c in counts]))[0] == expected


def test_combined_status(spark):
    def combined(a, b, any_ok):
        return one(spark, rates.combined_status(F.lit(a), F.lit(b), F.lit(any_ok)))[0]

    assert combined("complete", "partial_failure", True) == "partial_failure"
    assert combined("complete", "complete", True) == "complete"
    assert combined("complete", "not_started", True) == "in_progress"
    assert combined("not_started", "in_progress", False) == "in_progress"
    assert combined("not_started", "not_started", False) == "not_started"


def test_rates_are_null_without_a_denominator(spark):
    row = one(spark, rates.rate(F.lit(1), F.lit(0)), rates.rate(F.lit(0), F.lit(4)),
              rates.percent(F.lit(1), F.lit(8)), rates.percent(F.lit(1), F.lit(3)))
    assert tuple(row) == (None, 0.0, 12.5, 33.3)


EVIDENCE = [
    ("it doesn't work", "", "Well it doesn’t  work", "it doesn’t  work", None),
    ("IT DOESN'T WORK", "", "😀 it doesn’t work", "it doesn’t work", None),
    ("azon. The", "", "Amazon. The rest of it", None, "evidence_not_in_source"),
    ("it work", "", "it doesn’t work", None, "evidence_not_in_source"),
    ("powerful", "", "Very powerful!", "powerful", None),
    ("powerful", "", "It is a very powerful one", None, "evidence_too_short"),
    ("powerful", "So powerful", "It is a very powerful one", "powerful", None),
    ("a\\E.b c", "", "say a\\E.b   c now", "a\\E.b   c", None),
    ("  ", "", "anything", None, "empty_evidence"),
    ("été là", "", "l’ÉTÉ LÀ-bas", "ÉTÉ LÀ", None),
]


@pytest.mark.parametrize("quote, title, body, span, problem", EVIDENCE)
def test_evidence(spark, quote, title, body, span, problem):
    row = one(spark, find_evidence(F.lit(quote), F.lit(title), F.lit(body)))[0]
    assert (row["span"], row["problem"]) == (span, problem)


def test_one_word_evidence_by_choice(spark):
    found = find_evidence(F.lit("powerful"), F.lit(None).cast("string"),
                          F.lit("It is a very powerful one"), min_words=1)
    assert one(spark, found)[0]["span"] == "powerful"


def test_highlights_do_not_overlap(spark):
    quotes = F.array(*[F.lit(q) for q in ("leaks", "carafe leaks", "badly", "absent")])
    marks = one(spark, highlight_spans(F.lit("the carafe leaks badly"), quotes))[0]
    assert [(m["start"], m["end"], m["pos"]) for m in marks] == [(4, 16, 1), (17, 22, 2)]


def test_text_extraction(spark):
    row = one(
        spark, text.numbers(F.lit("1,200 rolls, 3.5W and 20")),
        text.percent_mentions(F.lit("33.3% 5 %p 7퍼센트 8 points")),
        text.citation_markers(F.lit("x[2] y[1][2] z[123]")),
        text.question_key(F.lit("  Is It\n GOOD ?!。 ")),
        text.break_tags_to_newlines(F.lit("a<br />b<BR>c")),
        text.is_hard_case(F.lit(None).cast("string"), F.lit("It STOPPED")),
        text.is_hard_case(F.lit("a"), F.lit("knothing notable")),
    )
    assert tuple(row) == (
        ["1200", "3.5", "20"], [33.3, 5.0, 7.0], [2, 1], "is it good", "a\nb\nc", True, False)


def test_unicode_white_space_is_blank(spark):
    row = one(spark, text.is_filled(F.lit("　  \x1c")), text.strip(F.lit(" a b ")),
              text.words(F.lit(" a  b ")), text.strip_to_null(F.lit(" 　")))
    assert tuple(row) == (False, "a b", ["a", "b"], None)


def test_identity_keeps_nulls_apart(spark):
    rows = spark.createDataFrame(
        [("a", "p", 5.0, "t", 1, None, "u"), ("a", "p", 5.0, "t", 1, "", "u"),
         ("a", "p", 5.0, "t", 1, None, "u"), ("a", "p", 5.0, "t", 1, None, "v")],
        "asin string, parent_asin string, rating double, text string, timestamp bigint, "
        "title string, user_id string")
    ids = [r[0] for r in rows.select(hashing.record_identity()).collect()]
    assert ids[0] == ids[2] and len(set(ids)) == 3
    key = rows.select(hashing.source_record_key(hashing.record_identity())).first()[0]
    assert key.startswith("amazon-reviews-2023:")


def test_identity_is_the_hash_of_compact_json(spark):
    texts = ["plain", "".join(map(chr, range(0x20))), "\x7f\x85\u2028\u2029\ufeff\uffff", 'quote " slash / \\',
             "\\\x0b \\\\\x1f \\u000B \\\\u001F", "é 한국어 😀", "", None]
    names = ("asin", "parent_asin", "rating", "text", "timestamp", "title", "user_id")
    rows = [(a, "p", float(1 + k % 5), b, 1_700_000_000_000 + k, b, a)
            for k, (a, b) in enumerate((a, b) for a in texts for b in texts)]
    df = spark.createDataFrame(rows, "asin string, parent_asin string, rating double, text string, timestamp bigint, "
                                     "title string, user_id string")
    for r in df.withColumn("identity", hashing.record_identity()).collect():
        document = json.dumps({n: r[n] for n in names}, ensure_ascii=False, separators=(",", ":"))
        assert r.identity == hashlib.sha256(document.encode()).hexdigest()


def test_content_hash_ignores_outer_space_and_input_hash_does_not(spark):
    none, body = F.lit(None).cast("string"), F.lit("x ")
    row = one(spark, hashing.content_hash(none, body) == hashing.content_hash(none, F.lit("x")),
              hashing.input_hash(none, body) == hashing.input_hash(none, F.lit("x")))
    assert tuple(row) == (True, False)


def test_metadata_expressions(spark):
    rows = spark.createDataFrame(
        [(([None, ""], ["big.jpg"], ["small.jpg"]), [" a ", "", "b"], ["1", "2", "3", "4"]),
         ((None, None, None), [" "], None), (None, None, [])],
        "images struct<hi_res: array<string>, large: array<string>, thumb: array<string>>, "
        "description array<string>, features array<string>")
    got = rows.select(
        products.first_image(F.col("images")), products.description_text(F.col("description")),
        products.has_items(F.col("features"))).collect()
    assert [tuple(r) for r in got] == [("big.jpg", "a\nb", True), (None, None, False), (None, None, False)]


def test_cosine(spark):
    def vec(*xs):
        return F.array(*[F.lit(float(x)) for x in xs])

    row = one(spark, vectors.cosine_similarity(vec(1, 0), vec(1, 1)),
              vectors.cosine_similarity(vec(0, 0), vec(1, 1)))
    assert row[0] == pytest.approx(2 ** -0.5) and row[1] == 0.0


def test_rounding_is_by_the_binary_value(spark):
    rng = random.Random(7)
    values = [k / 1000 * 5 for k in range(-300, 1500)] + [k + 0.05 * j for k in range(60) for j in range(20)]
    values += [rng.uniform(-100, 100) for _ in range(2000)] + [0.0, 1e-300, 1e15, -1e300, 2.0**52, 0.25, 0.35, 2.675, 1.005]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2, 3, 5):
        for row in df.select("v", rates.rounded(F.col("v"), digits).alias("r")).collect():
            assert row.r == round(row.v, digits), (row.v, digits)
    assert df.limit(1).select(rates.rounded(F.lit(None).cast("double"), 1)).first()[0] is None
