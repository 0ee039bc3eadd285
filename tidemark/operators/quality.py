"""Audits of label documents, translations and processing histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark import defaults as D
from tidemark.functions.evidence import (
    bind,
    evidence_tokens,
    folded,
    is_short_part,
    judge_match,
    plain_punctuation,
    search_parts,
)
from tidemark.functions.text import is_filled, numbers, strip
from tidemark.operators.lineage import bounded
from tidemark.operators.search import MOST_TOPICS

_LABEL = (
    "struct<code: string, sentiment: string, evidence: string, aspect_code: string, "
    "detail_code: string, polarity: string, evidence_span: string>"
)


def taxonomy_codes(taxonomy: DataFrame) -> DataFrame:
    """Allowed ``aspect.detail`` codes per category, a short fixed list."""
    code = F.concat_ws(".", "aspect", "detail")
    return bounded(taxonomy, MOST_TOPICS, "taxonomy").groupBy("category").agg(F.sort_array(F.collect_set(code)).alias("_codes"))


def validate_label_documents(
    documents: DataFrame,
    codes: DataFrame,
    min_words: int = D.MIN_EVIDENCE_WORDS,
    polarities: tuple[str, ...] = D.POLARITIES,
) -> DataFrame:
    """Parse label documents and check codes, polarity and evidence.

    ``documents`` has ``doc_id, category, title, text, content``. A document is
    rejected as a whole with the first problem found (format, then per label code,
    polarity, evidence); an accepted one gets its distinct labels in order, with
    the source's own wording as evidence. Everything happens inside the row, so
    texts are never shuffled.
    """
    field = "struct<labels: array<string>>"
    raw = F.from_json("content", field)["labels"]
    empty = F.array().cast("array<string>")
    title = F.coalesce("title", F.lit(""))

    def clean(value: Column) -> Column:
        return strip(F.coalesce(value, F.lit("")))

    def unpack(item: Column) -> Column:
        return bind(F.from_json(item, _LABEL), lambda label: bind(
            clean(label["code"]), lambda compact: read(item, label, compact)
        ))

    def read(item: Column, label: Column, compact: Column) -> Column:
        """Either shape of a label: one ``aspect.detail`` code, or two fields."""
        dot = F.instr(compact, ".")
        is_compact = compact != ""

        def pick(short: Column, long: Column) -> Column:
            return F.when(is_compact, short).otherwise(long)

        return F.struct(
            (F.substring(F.ltrim(item), 1, 1) == "{").alias("is_object"),
            pick(F.when(dot > 0, F.substring_index(compact, ".", 1)), clean(label["aspect_code"]))
            .alias("aspect"),
            pick(F.when(dot > 0, F.substr(compact, dot + 1)), clean(label["detail_code"]))
            .alias("detail"),
            pick(clean(label["sentiment"]), clean(label["polarity"])).alias("polarity"),
            evidence_tokens(pick(clean(label["evidence"]), clean(label["evidence_span"])))
            .alias("tokens"),
        )

    def judge(label: Column) -> Column:
        """Code and polarity first; the text is searched only when they hold."""
        known = F.array_contains(
            F.col("_codes"), F.concat_ws(".", label["aspect"], label["detail"])
        ) & label["aspect"].isNotNull()
        coded = (
            F.when(~label["is_object"], "response_format_error")
            .when(~F.coalesce(known, F.lit(False)), "taxonomy_validation_error")
            .when(~label["polarity"].isin(*polarities), "taxonomy_validation_error")
        )

        def located(problem: Column) -> Column:
            return F.when(problem.isNull(), bind(
                search_parts(label["tokens"], F.col("_plain_title"), F.col("_plain_text"),
                             F.col("_folded_title"), F.col("_folded_text")),
                lambda found: judge_match(
                    found, F.col("_title"), F.col("text"), F.col("_plain_title"),
                    F.col("_plain_text"), F.col("_short_title"), F.col("_short_text"), min_words,
                ),
            ))

        def settle(problem: Column, place: Column) -> Column:
            missing = F.when(place["problem"].isNotNull(), "evidence_validation_error")
            return F.struct(
                F.coalesce(problem, missing).alias("problem"), label["aspect"].alias("aspect"),
                label["detail"].alias("detail"), label["polarity"].alias("polarity"),
                place["span"].alias("evidence"),
            )

        return bind(coded, lambda problem: bind(
            located(problem), lambda place: settle(problem, place)
        ))

    judged = (
        documents.join(codes, "category", "left")
        .withColumns({
            "_title": title, "_raw": raw,
            "_plain_title": plain_punctuation(title),
            "_plain_text": plain_punctuation(F.col("text")),
            "_codes": F.coalesce("_codes", empty),
            "_short_title": is_short_part(title), "_short_text": is_short_part(F.col("text")),
        })
        .withColumns({
            "_folded_title": folded(F.col("_plain_title")), "_folded_text": folded(F.col("_plain_text")),
            "_labels": F.transform("_raw", unpack),
        })
        .withColumn("_judged", F.transform("_labels", judge))
    )
    problems = F.filter("_judged", lambda j: j["problem"].isNotNull())
    first = F.get(problems, F.lit(0))["problem"]
    problem = F.when(F.col("_raw").isNull(), "response_format_error").otherwise(first)
    labels = F.array_distinct(F.transform("_judged", lambda j: F.struct(
        j["aspect"].alias("aspect"), j["detail"].alias("detail"),
        j["polarity"].alias("polarity"), j["evidence"].alias("evidence"),
    )))
    return judged.withColumn("problem", problem).select(
        "doc_id", "problem", F.when(F.col("problem").isNull(), labels).alias("labels")
    )


def translation_problems(rows: DataFrame) -> DataFrame:
    """Translations with blank fields or numbers that the source has and they lack.

    ``rows`` has ``review_id, title, text, title_ko, text_ko``. Adds ``problem`` and
    ``missing``, the lost numbers in source order.
    """
    blank = ~is_filled(F.col("title_ko")) | ~is_filled(F.col("text_ko"))
    source = numbers(F.concat_ws(" ", F.coalesce("title", F.lit("")), "text"))
    target = numbers(F.concat_ws(" ", strip(F.col("title_ko")), strip(F.col("text_ko"))))
    missing = F.filter(source, lambda n: ~F.array_contains(F.col("_target"), n))
    return (
        rows.withColumn("_target", target)
        .withColumn("missing", missing)
        .withColumn(
            "problem",
            F.when(blank, "blank_translation").when(F.size("missing") > 0, "missing_numbers"),
        )
        .drop("_target")
    )


def pending_translations(
    reviews: DataFrame,
    products: DataFrame,
    category: str | None = None,
    product_id: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Eligible reviews without a translation, newest first within a product."""
    open_rows = reviews.filter(F.col("eligible") & F.col("text_ko").isNull())
    scope = products.select("product_id", "category")
    if category:
        scope = scope.filter(F.col("category") == category)
    if product_id:
        scope = scope.filter(F.col("product_id") == product_id)
    ordered = open_rows.join(scope, "product_id").orderBy(
        "category", "product_id", F.desc("reviewed_at"), "review_id"
    )
    return ordered.limit(limit) if limit is not None else ordered


def fold_attempts(attempts: DataFrame, max_attempts: int) -> DataFrame:
    """Current state of each (run, review) from its attempt log.

    ``attempts`` has ``run_id, review_id, input_hash, invocation, at, outcome``
    (``succeeded`` or ``failed``), ``error_type, duration_ms``. A changed input
    starts over: only attempts after the last one with another input count. A review
    has failed when its newest invocation used up ``max_attempts``. The log of one
    review is a few attempts per invocation, so its history fits one row.
    """
    key = ["run_id", "review_id"]
    whole = Window.partitionBy(*key)
    failed = F.col("outcome") == "failed"
    current = (
        attempts.withColumn("_newest", F.max_by("input_hash", "at").over(whole))
        .withColumn(
            "_reset",
            F.max(F.when(~F.col("input_hash").eqNullSafe(F.col("_newest")), F.col("at"))).over(whole),
        )
        .filter(F.col("_reset").isNull() | (F.col("at") > F.col("_reset")))
        .withColumn("_last", F.max("invocation").over(whole))
    )
    entry = F.struct("at", F.col("error_type").alias("type"), "duration_ms")
    folded = current.groupBy(*key, "input_hash").agg(
        F.count(F.lit(1)).alias("attempt_count"),
        F.bool_or(F.col("outcome") == "succeeded").alias("_done"),
        F.sum("duration_ms").alias("duration_ms"),
        F.max_by("error_type", "at").alias("_last_error"),
        F.count_if(failed & (F.col("invocation") == F.col("_last"))).alias("_spent"),
        F.array_sort(F.collect_list(F.when(failed, entry))).alias("error_history"),
    )
    return folded.withColumns({
        "status": F.when(F.col("_done"), "succeeded")
        .when(F.col("_spent") >= max_attempts, "failed").otherwise("pending"),
        "last_error_type": F.when(~F.col("_done"), F.col("_last_error")),
    }).drop("_done", "_last_error", "_spent")


def work_list(reviews: DataFrame, results: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Reviews a run still has to process; failed ones only when retrying."""
    skip = ["succeeded"] if retry_failed else ["succeeded", "failed"]
    done = results.filter(F.col("status").isin(*skip)).select("review_id")
    return reviews.join(done, "review_id", "left_anti")
