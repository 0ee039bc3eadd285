"""Evidence, label documents, translations, answers, stored FAQ, runs, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.defaults import INTERNAL_TERMS, PERCENT_TOLERANCE
from tidemark.functions.evidence import find_evidence, highlight_spans
from tidemark.functions.hashing import content_hash
from tidemark.functions.text import (
    break_tags_to_newlines,
    citation_markers,
    collapse,
    numbers,
    percent_mentions,
    question_key,
    words,
)
from tidemark.operators import answers, evaluation, merge, quality, runs, search, statistics
from tidemark.operators.keyed import KeyedTable
from tidemark.operators.lineage import new_path
from workload.binding import table
from workload.registry import query

# --- text ------------------------------------------------------------------------


@query("""SELECT doc_id,
  trim(regexp_replace(text, '\\s+', ' ', 'g')) AS collapsed,
  substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 300) AS excerpt,
  substr(regexp_replace(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '[\\s?!.~。？！]+$', ''),
         1, 600) AS question_key,
  CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 0
    ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END AS n_words
FROM (SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN chr(9) || '  ' ELSE text END AS text FROM documents)""")
def text_normalise(spark: SparkSession, sf: str) -> DataFrame:
    """Every fiftieth text is blanks alone."""
    text = F.col("text")
    blank = F.when(F.col("doc_id") % 50 == 7, "\t  ").otherwise(text).alias("text")
    return table(spark, sf, "documents").select("doc_id", blank).select(
        "doc_id", collapse(text).alias("collapsed"),
        F.substring(collapse(text), 1, 300).alias("excerpt"),
        question_key(text).alias("question_key"),
        F.size(words(text)).cast("bigint").alias("n_words"),
    )


TOKENS_SQL = """SELECT event_id, event_type || ' ' || replace(props, ' ', ',0') || ' ' || value || '% ['
  || (event_id % 40) || '] <br /> ' || (user_id / 4) || ' 포인트' AS t FROM events"""


@query(f"""WITH d AS ({TOKENS_SQL})
SELECT event_id,
  array_to_string(regexp_extract_all(replace(t, ',', ''), '\\d+(?:\\.\\d+)?'), ' ') AS numbers,
  array_to_string(regexp_extract_all(t, '\\[(\\d{{1,2}})\\]', 1), ' ') AS citations,
  len(regexp_extract_all(t, '(\\d+(?:\\.\\d+)?)\\s*(?:%p|%|퍼센트|포인트)', 1)) AS percents,
  regexp_replace(t, '(?i)<br\\s*/?>', chr(10), 'g') AS display FROM d""")
def token_extraction(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(
        F.col("event_type"), F.lit(" "), F.replace("props", F.lit(" "), F.lit(",0")), F.lit(" "),
        F.col("value").cast("string"), F.lit("% ["), (F.col("event_id") % 40).cast("string"),
        F.lit("] <br /> "), (F.col("user_id") / 4).cast("string"), F.lit(" 포인트"),
    )
    t = F.col("t")
    return table(spark, sf, "events").select("event_id", text.alias("t")).select(
        "event_id", F.array_join(numbers(t), " ").alias("numbers"),
        F.array_join(citation_markers(t).cast("array<string>"), " ").alias("citations"),
        F.size(percent_mentions(t)).cast("bigint").alias("percents"),
        break_tags_to_newlines(t).alias("display"),
    )


# --- evidence --------------------------------------------------------------------

# A quote is three words from the middle of the document, in lower case with doubled
# spaces; in Spanish documents its last word is changed. Very short texts have none.
QUOTES_SQL = """
q0 AS (SELECT doc_id, lang, source, text, regexp_extract(
         substr(text, length(text) // 2 + 1), '\\s(\\S+\\s+\\S+\\s+\\S+)', 1) AS w FROM documents),
q AS (SELECT doc_id, lang, source, text, regexp_replace(lower(CASE WHEN lang = 'es' AND w <> ''
        THEN w || 'x' ELSE w END), '\\s+', '  ', 'g') AS quote FROM q0)
"""


# Where a quote lies in its document, with the document's own letters and spacing.
SPANS_SQL = """
p AS (SELECT doc_id, lang, source, quote, nullif(regexp_extract(text, '(?i)(^|[^\\p{L}\\p{N}_])('
        || array_to_string([regexp_escape(x) for x in string_split(quote, '  ')], '\\s+')
        || ')($|[^\\p{L}\\p{N}_])', 2), '') AS span FROM q)
"""


def _quotes(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    half = F.substr(text, F.floor(F.char_length(text) / 2).cast("int") + 1)
    three = F.regexp_extract(half, r"\s(\S+\s+\S+\s+\S+)", 1)
    changed = F.when((F.col("lang") == "es") & (F.col("w") != ""), F.concat("w", F.lit("x")))
    quote = F.regexp_replace(F.lower(F.coalesce(changed, F.col("w"))), r"\s+", "  ")
    return table(spark, sf, "documents").withColumn("w", three).select(
        "doc_id", "lang", "source", "text", quote.alias("quote")
    )


@query(f"""WITH {QUOTES_SQL}, {SPANS_SQL}
SELECT doc_id, quote, span, CASE WHEN quote = '' THEN 'empty_evidence'
  WHEN span IS NULL THEN 'evidence_not_in_source' END AS problem FROM p""")
def evidence_check(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes looked for in whole documents."""
    found = find_evidence(F.col("quote"), F.col("source"), F.col("text"))
    return _quotes(spark, sf).select("doc_id", "quote", found.alias("e")).select(
        "doc_id", "quote", "e.span", "e.problem"
    )


@query("""
WITH d AS (SELECT doc_id, text, string_split(text, ' ') AS w FROM documents),
q AS (SELECT doc_id, text, 1 AS pos, w[1] AS e FROM d UNION ALL
      SELECT doc_id, text, 2, w[len(w) // 2 + 1] FROM d UNION ALL
      SELECT doc_id, text, 3, w[len(w)] FROM d),
p AS (SELECT doc_id, pos, instr(text, e) - 1 AS s, instr(text, e) - 1 + length(e) AS t
      FROM q WHERE e <> '' AND instr(text, e) > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, pos) AS k FROM p),
w AS (SELECT a.doc_id, a.k, a.s, a.t, a.pos,
        coalesce(b.s, 0) AS s1, coalesce(b.t, 0) AS t1, coalesce(c.s, 0) AS s0,
        coalesce(c.t, 0) AS t0 FROM o a
      LEFT JOIN o b ON b.doc_id = a.doc_id AND b.k = a.k - 1
      LEFT JOIN o c ON c.doc_id = a.doc_id AND c.k = a.k - 2)
SELECT doc_id, CAST(s AS INTEGER) AS span_start, CAST(t AS INTEGER) AS span_end,
       CAST(pos AS INTEGER) AS pos FROM w
WHERE k = 1 OR (k = 2 AND s >= t1)
   OR (k = 3 AND s >= CASE WHEN s1 >= t0 THEN t1 ELSE t0 END)""")
def evidence_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Marks of three quotes per document, overlapping ones left out."""
    w = F.split("text", " ")
    quotes = F.array(
        F.get(w, F.lit(0)), F.get(w, (F.size(w) / 2).cast("int")), F.get(w, F.size(w) - 1)
    )
    docs = table(spark, sf, "documents").select("doc_id", "text", quotes.alias("quotes"))
    kept = F.transform("quotes", lambda q: F.when(q != "", q).otherwise("\u0000"))
    return docs.select(
        "doc_id", F.inline(highlight_spans(F.col("text"), kept))
    ).select(
        "doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"),
        (F.col("pos") + 1).alias("pos"),
    )


def _label_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a JSON label list: source is the aspect, language the detail."""
    quoted = _quotes(spark, sf)
    label = F.struct(
        F.concat_ws(".", "source", "lang").alias("code"),
        F.when(F.col("source") == "src7", "bad").otherwise("negative").alias("sentiment"),
        F.col("quote").alias("evidence"),
    )
    content = F.to_json(F.struct(F.array(label, label).alias("labels")))
    return quoted.select(
        "doc_id", F.lit("all").alias("category"), F.lit("").alias("title"), "text",
        F.when(F.col("source") == "src3", F.substr(content, F.lit(2))).otherwise(content)
        .alias("content"),
    )


def _codes(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of every source and language seen, German left out."""
    seen = table(spark, sf, "documents").filter(F.col("lang") != "de").select(
        F.lit("all").alias("category"), F.col("source").alias("aspect"),
        F.col("lang").alias("detail"),
    ).distinct()
    return quality.taxonomy_codes(seen)


@query(f"""WITH {QUOTES_SQL}, {SPANS_SQL}
SELECT doc_id, CASE WHEN source = 'src3' THEN 'response_format_error'
  WHEN lang = 'de' OR source = 'src7' THEN 'taxonomy_validation_error'
  WHEN span IS NULL THEN 'evidence_validation_error' END AS problem,
  CASE WHEN source NOT IN ('src3', 'src7') AND lang <> 'de' AND span IS NOT NULL
    THEN source || '|' || lang || '|negative|' || span END AS labels FROM p""")
def label_document_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Every accepted label with its code, polarity and the source's own wording."""
    judged = quality.validate_label_documents(_label_documents(spark, sf), _codes(spark, sf))
    told = F.transform("labels", lambda x: F.concat_ws("|", x.aspect, x.detail, x.polarity, x.evidence))
    return judged.select("doc_id", "problem", F.array_join(told, ";").alias("labels"))


TRANSLATION_SQL = """
t AS (SELECT event_id, event_type || ' ' || value AS src,
  CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS title_ko,
  CASE WHEN event_type = 'error' THEN 'none' ELSE props || ' ' || value END AS text_ko, props
  FROM events)
"""


@query(f"""WITH {TRANSLATION_SQL},
n AS (SELECT *, regexp_extract_all(replace(props || ' ' || src, ',', ''), '\\d+(?:\\.\\d+)?') AS a,
        regexp_extract_all(replace(title_ko || ' ' || text_ko, ',', ''), '\\d+(?:\\.\\d+)?') AS b
      FROM t)
SELECT event_id AS review_id,
  CASE WHEN title_ko = '' THEN 'blank_translation'
       WHEN len([x for x in a if NOT list_contains(b, x)]) > 0 THEN 'missing_numbers' END AS problem,
  array_to_string([x for x in a if NOT list_contains(b, x)], ',') AS missing FROM n""")
def translation_number_audit(spark: SparkSession, sf: str) -> DataFrame:
    value = F.col("value").cast("string")
    rows = table(spark, sf, "events").select(
        F.col("event_id").alias("review_id"), F.col("props").alias("title"),
        F.concat_ws(" ", "event_type", value).alias("text"),
        F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("title_ko"),
        F.when(F.col("event_type") == "error", "none").otherwise(F.concat_ws(" ", "props", value))
        .alias("text_ko"),
    )
    return quality.translation_problems(rows).select(
        "review_id", "problem", F.array_join("missing", ",").alias("missing")
    )


# --- answers ---------------------------------------------------------------------


@query()
def answer_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns audited against the turn before; brute force in the tests.

    Each answer gets a citation of its own turn number and a percentage.
    """
    window = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    turn = F.col("turn").cast("string")
    rows = turns.select(
        "conv_id", "turn",
        F.concat(F.col("text"), F.lit(" ["), turn, F.lit("] "), turn, F.lit("0%")).alias("answer"),
        F.lag("text").over(window).alias("previous"),
        F.lit(4).alias("source_count"), F.lit(1).alias("topic_sources"),
        F.array(F.lit(10.3), F.lit(29.6)).alias("allowed"),
    )
    return answers.audit_answers(rows).select(
        "conv_id", "turn", F.array_join("problems", ",").alias("problems"),
        F.array_join(F.col("citations").cast("array<string>"), ",").alias("citations"),
    )


@query(f"""SELECT conv_id, turn, concat_ws(',',
  CASE WHEN turn % 3 <> 0 AND turn > 4 THEN 'unknown_citation' END,
  CASE WHEN turn % 3 = 0 AND conv_id % 2 = 1 THEN 'no_citation' END,
  CASE WHEN abs(turn * 10 - 10.3) > {PERCENT_TOLERANCE} AND abs(turn * 10 - 29.6) > {PERCENT_TOLERANCE}
    THEN 'unknown_percent' END,
  CASE WHEN conv_id % 5 = 0 THEN 'internal_term' END) AS problems,
  CASE WHEN turn % 3 <> 0 AND turn BETWEEN 1 AND 4 THEN CAST(turn AS VARCHAR) ELSE '' END AS citations
FROM conversations WHERE role = 'assistant'""")
def answer_audit_rules(spark: SparkSession, sf: str) -> DataFrame:
    """All rules but the repeat check, on answers that break each of them."""
    turn, conv = F.col("turn").cast("string"), F.col("conv_id")
    cited = F.when(F.col("turn") % 3 != 0, F.concat(F.lit(" ["), turn, F.lit("]"))).otherwise("")
    term = F.when(conv % 5 == 0, f" {INTERNAL_TERMS[0].upper()}").otherwise("")
    rows = table(spark, sf, "conversations").filter(F.col("role") == "assistant").select(
        "conv_id", "turn", F.concat("text", cited, F.lit(" "), turn, F.lit("0%"), term).alias("answer"),
        F.lit(4).alias("source_count"), (conv % 2).alias("topic_sources"),
        F.array(F.lit(10.3), F.lit(29.6)).alias("allowed"),
    )
    return answers.audit_answers(rows, check_repeats=False).select(
        "conv_id", "turn", F.array_join("problems", ",").alias("problems"),
        F.array_join(F.col("citations").cast("array<string>"), ",").alias("citations"),
    )


@query("""SELECT conv_id, turn,
  CASE WHEN turn > 4 THEN 'unknown_citation' ELSE '' END
  || CASE WHEN abs(turn * 10 - 10.3) > 0.51 AND abs(turn * 10 - 29.6) > 0.51
          THEN ',unknown_percent' ELSE '' END AS problems
FROM conversations WHERE role = 'assistant'""")
def answer_audit_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """The citation and percentage rules alone."""
    turn = F.col("turn").cast("string")
    rows = table(spark, sf, "conversations").filter(F.col("role") == "assistant").select(
        "conv_id", "turn",
        F.concat(F.col("text"), F.lit(" ["), turn, F.lit("] "), turn, F.lit("0%")).alias("answer"),
        F.lit(4).alias("source_count"), F.lit(1).alias("topic_sources"),
        F.array(F.lit(10.3), F.lit(29.6)).alias("allowed"),
    )
    joined = F.concat_ws(
        "",
        F.when(F.array_contains("problems", "unknown_citation"), "unknown_citation"),
        F.when(F.array_contains("problems", "unknown_percent"), ",unknown_percent"),
    )
    return answers.audit_answers(rows, check_repeats=False).select(
        "conv_id", "turn", joined.alias("problems")
    )


VERSIONS = ("p1", "p2")


def stored_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Events as stored answers: the user is the product, the type the question."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    value = F.col("value")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("product_id"), F.col("event_type").alias("question_key"),
        F.when(value < 20, "p1").when(value < 80, "p2").otherwise("p0").alias("prompt_version"),
        F.when(value < 100, "run-1").otherwise("run-0").alias("analysis_version"),
        k.alias("analyzed_count"), F.col("ts").alias("created_at"),
        F.concat_ws(":", "event_type", "event_id").alias("answer"),
    )


ANSWERS_SQL = """
ans AS (SELECT user_id AS product_id, event_type AS question_key,
  CASE WHEN value < 20 THEN 'p1' WHEN value < 80 THEN 'p2' ELSE 'p0' END AS prompt_version,
  CASE WHEN value < 100 THEN 'run-1' ELSE 'run-0' END AS analysis_version,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS analyzed_count, ts AS created_at,
  event_type || ':' || event_id AS answer FROM events),
la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id, question_key
         ORDER BY created_at DESC, prompt_version DESC) AS k
       FROM ans WHERE prompt_version IN ('p1', 'p2')) WHERE k = 1),
-- the current state of a product: its run and how many events it has
snap AS (SELECT user_id AS product_id, 'run-1' AS current_version, count(*) AS current_count
         FROM events GROUP BY ALL)
"""
STALE_SQL = """(analysis_version <> current_version OR abs(current_count - analyzed_count) >
  greatest(2, ceil(analyzed_count * 0.05)))"""


def _snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("product_id")).agg(
        F.lit("run-1").alias("current_version"), F.count(F.lit(1)).alias("current_count")
    )


@query(f"""WITH {ANSWERS_SQL}
SELECT product_id, question_key, prompt_version, analysis_version, analyzed_count, answer FROM la""")
def latest_answer(spark: SparkSession, sf: str) -> DataFrame:
    return answers.latest_answers(stored_answers(spark, sf), VERSIONS).drop("created_at")


@query(f"""WITH {ANSWERS_SQL}
SELECT product_id, question_key, answer, {STALE_SQL} AS is_stale FROM ans JOIN snap USING (product_id)""")
def answer_staleness(spark: SparkSession, sf: str) -> DataFrame:
    joined = stored_answers(spark, sf).join(_snapshot(spark, sf), "product_id")
    c = F.col
    return joined.select("product_id", "question_key", "answer", answers.is_stale(
        c("analysis_version"), c("analyzed_count"), c("current_version"), c("current_count")
    ).alias("is_stale"))


QUESTIONS = (("look", "View?!"), ("buy", " purchase . "), ("fail", "ERROR"), ("none", "Refund?"))


@query(f"""WITH {ANSWERS_SQL},
q(faq_key, question_key) AS (VALUES ('look', 'view'), ('buy', 'purchase'), ('fail', 'error'),
                             ('none', 'refund'))
SELECT s.product_id, q.faq_key, la.answer, CASE WHEN la.answer IS NOT NULL THEN {STALE_SQL} END AS is_stale
FROM snap s CROSS JOIN q LEFT JOIN la ON la.product_id = s.product_id
  AND la.question_key = q.question_key""")
def faq_freshness(spark: SparkSession, sf: str) -> DataFrame:
    latest = answers.latest_answers(stored_answers(spark, sf), VERSIONS)
    listed = answers.faq_list(_snapshot(spark, sf), latest, QUESTIONS)
    return listed.select("product_id", "faq_key", "answer", "is_stale")


@query(f"""WITH {ANSWERS_SQL},
q(faq_key, question_key) AS (VALUES ('look', 'view'), ('buy', 'purchase'), ('fail', 'error'),
                             ('none', 'refund'))
SELECT s.product_id, q.faq_key FROM snap s CROSS JOIN q LEFT JOIN la
  ON la.product_id = s.product_id AND la.question_key = q.question_key
WHERE la.answer IS NULL OR {STALE_SQL}""")
def faq_worklist(spark: SparkSession, sf: str) -> DataFrame:
    latest = answers.latest_answers(stored_answers(spark, sf), VERSIONS)
    listed = answers.faq_list(_snapshot(spark, sf), latest, QUESTIONS)
    return answers.faq_work(listed).select("product_id", "faq_key")


ANSWER_STORE_SQL = f"""WITH {ANSWERS_SQL},
keyed AS (SELECT *, row_number() OVER (PARTITION BY product_id, question_key, prompt_version
            ORDER BY created_at, answer) AS f, row_number() OVER (PARTITION BY product_id,
            question_key, prompt_version ORDER BY created_at DESC, answer DESC) AS l FROM ans),
s AS (SELECT *, CASE WHEN question_key = 'view' THEN 'faq' ELSE 'cache' END AS kind,
        CASE WHEN question_key = 'view' THEN 'look' END AS faq_key FROM keyed
      WHERE f = 1 AND prompt_version <> 'p0'),
u AS (SELECT * FROM keyed WHERE l = 1 AND analyzed_count >= 10)
SELECT coalesce(u.product_id, s.product_id) AS product_id,
  coalesce(u.question_key, s.question_key) AS question_key,
  coalesce(u.prompt_version, s.prompt_version) AS prompt_version,
  coalesce(u.answer, s.answer) AS answer, coalesce(s.kind, 'cache') AS kind, s.faq_key
FROM s FULL OUTER JOIN u ON s.product_id = u.product_id AND s.question_key = u.question_key
  AND s.prompt_version = u.prompt_version"""


@query(ANSWER_STORE_SQL)
def merge_answer_store(spark: SparkSession, sf: str) -> DataFrame:
    """Cache saves over a store whose ``view`` answers are FAQ answers."""
    return merge.merge_answers(*_store_and_saves(spark, sf))


def _store_and_saves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = stored_answers(spark, sf)
    keys = list(merge.ANSWER_KEY)
    when = F.struct("created_at", "answer")
    first = rows.groupBy(*keys).agg(F.min_by("answer", when).alias("answer"))
    is_faq = F.col("question_key") == "view"
    stored = first.filter(F.col("prompt_version") != "p0").select(
        *keys, "answer", F.when(is_faq, "faq").otherwise("cache").alias("kind"),
        F.when(is_faq, "look").alias("faq_key"),
    )
    saved = merge.latest_per_key(rows, keys, when).select(
        *keys, "answer", F.lit("cache").alias("kind"), F.lit(None).cast("string").alias("faq_key"),
        F.when(F.col("analyzed_count") >= 10, "answered").otherwise("invalid").alias("status"),
    )
    return stored, saved


@query(ANSWER_STORE_SQL)
def keyed_answer_merge(spark: SparkSession, sf: str) -> DataFrame:
    """The same through a keyed table whose files with a saved answer are rewritten."""
    first, saved = _store_and_saves(spark, sf)
    stored = KeyedTable(
        spark, new_path(spark), "product_id bigint, question_key string, prompt_version string, answer string, kind string, faq_key string", merge.ANSWER_KEY, buckets=16)
    stored.insert_once(first)
    stored.upsert(saved, merge.merge_answers)
    return stored.read()


# --- runs ------------------------------------------------------------------------


def run_results(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as results: the order priority is the run, cents are milliseconds."""
    price = F.col("o_totalprice")
    entry = F.struct(
        F.when(price % 2 < 1, "model_request_error").otherwise("evidence_validation_error")
        .alias("type")
    )
    none = F.array().cast("array<struct<type: string>>")
    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("run_id"), F.col("o_orderkey").alias("review_id"),
        F.when(F.col("o_orderstatus") == "P", "failed").otherwise("succeeded").alias("status"),
        F.when(price >= 3000, F.floor(price)).alias("duration_ms"),
        F.length("o_orderpriority").alias("input_chars"),
        F.when(F.col("o_orderstatus") != "F", F.array(entry)).otherwise(none)
        .alias("error_history"),
    )


RUNS_SQL = """
res AS (SELECT o_orderpriority AS run_id, o_orderkey AS review_id,
  CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'succeeded' END AS status,
  CASE WHEN o_totalprice >= 3000 THEN CAST(floor(o_totalprice) AS BIGINT) END AS duration_ms,
  length(o_orderpriority) AS input_chars, o_orderstatus <> 'F' AS has_error,
  CASE WHEN o_totalprice % 2 < 1 THEN 'model_request_error' ELSE 'evidence_validation_error' END
    AS error_type FROM orders),
ok AS (SELECT run_id, duration_ms, row_number() OVER (PARTITION BY run_id ORDER BY duration_ms) - 1
         AS i, count(*) OVER (PARTITION BY run_id) AS n
       FROM res WHERE status = 'succeeded' AND duration_ms IS NOT NULL),
pct AS (SELECT run_id,
  max(duration_ms) FILTER (WHERE i = CAST(round_even((n - 1) * 0.25, 0) AS BIGINT)) AS p25,
  max(duration_ms) FILTER (WHERE i = CAST(round_even((n - 1) * 0.95, 0) AS BIGINT)) AS p95,
  (max(duration_ms) FILTER (WHERE i = (n - 1) // 2) + max(duration_ms) FILTER (WHERE i = n // 2))
    / 2.0::DOUBLE AS median, avg(duration_ms) AS mean FROM ok GROUP BY ALL)
"""


@query(f"""WITH {RUNS_SQL}
SELECT run_id, median, p25, p95 FROM pct""")
def nearest_rank_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    done = run_results(spark, sf).filter(F.col("status") == "succeeded")
    return statistics.nearest_rank_percentiles(
        done, ["run_id"], "duration_ms", {"p25": 0.25, "p95": 0.95}
    )


@query(f"""WITH {RUNS_SQL},
b AS (SELECT run_id, count(*) AS result_records, min(duration_ms) AS duration_min,
        max(duration_ms) AS duration_max, min(input_chars) AS input_chars_min,
        max(input_chars) AS input_chars_max, avg(input_chars) AS input_chars_mean FROM res GROUP BY ALL)
SELECT run_id, result_records, CAST(format('{{:.1f}}', mean) AS DOUBLE) AS duration_mean,
  CAST(format('{{:.1f}}', median) AS DOUBLE) AS duration_median,
  duration_min, duration_max, p25::DOUBLE AS duration_p25, p95::DOUBLE AS duration_p95,
  CAST(format('{{:.1f}}', input_chars_mean) AS DOUBLE) AS input_chars_mean,
  CAST(input_chars_min AS INTEGER) AS input_chars_min, CAST(input_chars_max AS INTEGER) AS input_chars_max,
  CAST(format('{{:.2f}}', mean * total / 3600000) AS DOUBLE) AS estimate_hours_mean,
  CAST(format('{{:.2f}}', p25 * total / 3600000::DOUBLE) AS DOUBLE) AS estimate_hours_p25,
  CAST(format('{{:.2f}}', p95 * total / 3600000::DOUBLE) AS DOUBLE) AS estimate_hours_p95
FROM b JOIN pct USING (run_id), (SELECT count(*) AS total FROM orders)""")
def run_report(spark: SparkSession, sf: str) -> DataFrame:
    total = table(spark, sf, "orders").agg(F.count(F.lit(1))).scalar()
    return runs.run_report(run_results(spark, sf), total)


@query(f"""WITH {RUNS_SQL}
SELECT run_id, error_type, count(*) AS n FROM res WHERE has_error GROUP BY ALL""")
def run_error_counts(spark: SparkSession, sf: str) -> DataFrame:
    return runs.error_counts(run_results(spark, sf))


@query(f"""WITH {RUNS_SQL},
c AS (SELECT run_id, count(*) AS n, count(*) FILTER (WHERE status = 'succeeded') AS good FROM res
      GROUP BY ALL),
t AS (SELECT *, n + CASE WHEN run_id = '2-HIGH' THEN 1 ELSE 0 END AS target FROM c)
SELECT run_id, CASE WHEN good = target THEN 'completed' WHEN n = target THEN 'partial_failure'
  ELSE 'in_progress' END AS status FROM t""")
def run_status(spark: SparkSession, sf: str) -> DataFrame:
    targets = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("run_id")).agg(
        F.count(F.lit(1)).alias("n")
    ).select("run_id", (
        F.col("n") + F.when(F.col("run_id") == "2-HIGH", 1).otherwise(0)
    ).alias("target_review_count"))
    return runs.run_status(targets, run_results(spark, sf)).select("run_id", "status")


RUN_A, RUN_B = "A", "N"


@query("""
WITH l AS (SELECT DISTINCT l_returnflag AS run_id, l_orderkey AS review_id,
             l_linestatus || '/' || l_linenumber AS label FROM lineitem),
s AS (SELECT review_id, run_id, string_agg(label, ',' ORDER BY label) AS labels FROM l GROUP BY ALL)
SELECT o_orderkey AS review_id,
  CASE WHEN a.review_id IS NULL THEN 'not_run' ELSE 'succeeded' END AS baseline_status,
  CASE WHEN b.review_id IS NULL THEN 'not_run' ELSE 'succeeded' END AS improved_status,
  coalesce(a.labels, '') <> coalesce(b.labels, '') AS labels_changed
FROM orders LEFT JOIN s a ON a.review_id = o_orderkey AND a.run_id = 'A'
LEFT JOIN s b ON b.review_id = o_orderkey AND b.run_id = 'N'""")
def run_pair_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Return flags as runs: the lines of an order as its labels in each run."""
    labels = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("run_id"), F.col("l_orderkey").alias("review_id"),
        F.col("l_linestatus").alias("aspect"), F.col("l_linenumber").cast("string").alias("detail"),
        F.lit("neutral").alias("polarity"), F.lit("").alias("evidence"),
    ).distinct()
    results = labels.select(
        "run_id", "review_id", F.lit("succeeded").alias("status"),
        F.lit(1).cast("bigint").alias("duration_ms"),
    ).distinct()
    sample = table(spark, sf, "orders").select(F.col("o_orderkey").alias("review_id"))
    return runs.compare_runs(sample, results, labels, RUN_A, RUN_B).select(
        "review_id", "baseline_status", "improved_status", "labels_changed"
    )


@query("""
WITH e AS (SELECT user_id AS review_id, event_type AS input_hash, event_id AS seq,
             value < 20 AS ok, CAST(floor(value) AS BIGINT) AS duration_ms FROM events),
n AS (SELECT review_id, arg_max(input_hash, seq) AS newest FROM e GROUP BY ALL),
r AS (SELECT e.review_id, coalesce(max(seq) FILTER (WHERE input_hash <> newest), -1) AS reset
      FROM e JOIN n USING (review_id) GROUP BY ALL)
SELECT review_id, count(*) AS attempt_count, CAST(sum(duration_ms) AS BIGINT) AS duration_ms,
  CASE WHEN bool_or(ok) THEN 'succeeded' WHEN count(*) >= 2 THEN 'failed' ELSE 'pending' END AS status,
  count(*) FILTER (WHERE NOT ok) AS failures
FROM e JOIN r USING (review_id) WHERE seq > reset GROUP BY ALL""")
def attempt_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Events as attempts: a change of event type is a change of input."""
    attempts = table(spark, sf, "events").select(
        F.lit("run-1").alias("run_id"), F.col("user_id").alias("review_id"),
        F.col("event_type").alias("input_hash"), F.lit(1).alias("invocation"),
        F.col("event_id").alias("at"),
        F.when(F.col("value") < 20, "succeeded").otherwise("failed").alias("outcome"),
        F.lit("model_request_error").alias("error_type"),
        F.floor("value").alias("duration_ms"),
    )
    return quality.fold_attempts(attempts, 2).select(
        "review_id", "attempt_count", "duration_ms", "status",
        F.size("error_history").cast("bigint").alias("failures"),
    )


@query("""SELECT o_orderkey AS review_id FROM orders WHERE o_orderkey NOT IN
  (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O')""")
def work_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Orders without an open returned line: the others have succeeded."""
    reviews = table(spark, sf, "orders").select(F.col("o_orderkey").alias("review_id"))
    results = table(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("review_id"),
        F.when(F.col("l_linestatus") == "O", "succeeded").otherwise("failed").alias("status"),
    )
    return quality.work_list(reviews, results, retry_failed=True)


@query("""SELECT doc_id AS review_id FROM documents WHERE lang <> 'en'
  OR doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def pending_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose vector is missing or belongs to another text."""
    hashed = table(spark, sf, "documents").select(
        F.col("doc_id").alias("review_id"), "lang", F.lit(True).alias("eligible"),
        content_hash(F.col("source"), F.col("text")).alias("content_hash"),
    )
    known = table(spark, sf, "embeddings").select(F.col("vec_id").alias("review_id"))
    stored = hashed.join(known, "review_id").select("review_id", F.when(
        F.col("lang") == "en", F.col("content_hash")
    ).otherwise("").alias("content_hash"))
    return search.pending_embeddings(hashed, stored).select("review_id")


# --- evaluation ------------------------------------------------------------------


def evaluations(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents as evaluation rows, one dataset per language."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    c = F.col
    return table(spark, sf, "labels").join(docs, "doc_id").select(
        c("lang").alias("dataset_id"), c("doc_id").cast("int").alias("position"),
        c("doc_id").alias("review_id"),
        F.when((c("lang") == "fr") & (c("source") == "src1"), "development")
        .otherwise("independent_evaluation").alias("split"),
        F.lit(False).alias("prompt_tuning_used"),
        F.when(c("quality") == 1, "completed").otherwise("pending").alias("status"),
        F.when(c("source") != "src2", c("source")).alias("reviewer"),
        (c("toxic") == 1).alias("is_normal_empty"),
        F.when(c("source") != "src4", F.array("source")).otherwise(
            F.array().cast("array<string>")).alias("gold_labels"),
    )


EVALUATION_SQL = """
ev AS (SELECT lang AS dataset_id, CAST(doc_id AS INTEGER) AS position, doc_id AS review_id,
  lang = 'fr' AND source = 'src1' AS dependent,
  CASE WHEN quality = 1 THEN 'completed' ELSE 'pending' END AS status,
  toxic = 1 AS is_normal_empty, source FROM labels JOIN documents USING (doc_id))
"""


@query(f"""WITH {EVALUATION_SQL}
SELECT dataset_id, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed,
  count(*) FILTER (WHERE status = 'pending') AS pending,
  min(position) FILTER (WHERE status = 'pending') AS next_pending_position,
  NOT bool_or(dependent) AS independent_evaluation FROM ev GROUP BY ALL""")
def evaluation_progress(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.progress(evaluations(spark, sf))


@query(f"""WITH {EVALUATION_SQL}
SELECT dataset_id, review_id, problem FROM (SELECT *, CASE
  WHEN is_normal_empty AND source <> 'src4' THEN 'empty_and_labelled'
  WHEN status = 'completed' AND source = 'src2' THEN 'no_reviewer'
  WHEN status = 'completed' AND NOT is_normal_empty AND source = 'src4' THEN 'no_labels' END
  AS problem FROM ev) WHERE problem IS NOT NULL""")
def evaluation_completeness(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.completeness_problems(evaluations(spark, sf)).select(
        "dataset_id", "review_id", "problem"
    )


@query(f"""WITH {EVALUATION_SQL},
listed AS (SELECT doc_id AS review_id, CAST(n_chars AS INTEGER) AS position FROM documents
           WHERE lang = 'en' AND source <> 'src0')
SELECT coalesce(l.review_id, e.review_id) AS review_id,
  coalesce(l.position, e.position) AS position, coalesce(e.status, 'pending') AS status,
  coalesce(e.is_normal_empty, FALSE) AS is_normal_empty, 'independent_evaluation' AS split,
  FALSE AS prompt_tuning_used,
  CASE WHEN e.review_id IS NULL OR e.source = 'src4' THEN '' ELSE e.source END AS gold_labels
FROM (SELECT * FROM ev WHERE dataset_id = 'en') e FULL OUTER JOIN listed l
  ON e.review_id = l.review_id""")
def evaluation_seed(spark: SparkSession, sf: str) -> DataFrame:
    """Seeding the English set from a list: new rows start pending, old ones move."""
    stored = evaluations(spark, sf).select(
        "dataset_id", "position", "review_id", "split", "prompt_tuning_used", "status",
        "is_normal_empty", "gold_labels",
    )
    listed = table(spark, sf, "documents").filter(
        (F.col("lang") == "en") & (F.col("source") != "src0")
    ).select(F.col("doc_id").alias("review_id"), F.col("n_chars").cast("int").alias("position"))
    merged = merge.seed_evaluations(stored, listed, "en")
    return merged.filter(F.col("dataset_id") == "en").select(
        "review_id", "position", "status", "is_normal_empty", "split", "prompt_tuning_used",
        F.array_join("gold_labels", ",").alias("gold_labels"),
    )


@query(f"""WITH {EVALUATION_SQL},
p AS (SELECT l_orderkey AS review_id, arg_max(l_returnflag, l_shipdate || l_returnflag) AS run_id
      FROM lineitem GROUP BY ALL)
SELECT ev.review_id, status, CASE WHEN status = 'completed' THEN coalesce(p.run_id, 'none') END
  AS prediction_run FROM ev LEFT JOIN p USING (review_id)""")
def evaluation_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Latest prediction of each evaluation row, hidden until it is completed."""
    lines = table(spark, sf, "lineitem")
    results = lines.select(
        F.col("l_orderkey").alias("review_id"), F.col("l_returnflag").alias("run_id"),
        F.lit("succeeded").alias("status"), F.lit(None).cast("string").alias("last_error"),
        F.col("l_shipdate").alias("updated_at"),
    )
    labels = lines.select(
        F.col("l_orderkey").alias("review_id"), F.col("l_returnflag").alias("run_id"),
        F.col("l_linestatus").alias("aspect"), F.col("l_linestatus").alias("detail"),
        F.lit("neutral").alias("polarity"), F.lit("").alias("evidence"),
    )
    predicted = evaluation.latest_predictions(results, labels)
    shown = evaluation.revealed_predictions(evaluations(spark, sf), predicted)
    run = F.when(F.col("prediction_revealed"), F.coalesce("prediction.run_id", F.lit("none")))
    return shown.select("review_id", "status", run.alias("prediction_run"))

