"""The corpus operators bound to the given tables, with SQL where it can express them."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    decontaminate,
    editprint,
    langid,
    licences,
    periodic,
    pieces,
    pii,
    repair,
    repeats,
    sharding,
    simhash,
    topk,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
BENCHMARK = "item_id bigint, text string"
EMBEDDINGS = "vec_id bigint, embedding array<float>, label int"
CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"
PAGES = "page_id bigint, url string, html string"


def table(spark: SparkSession, sf: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{sf}/{name}.parquet")


def op1_pii(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data of every document."""
    found = pii.personal_spans(table(spark, sf, "documents", DOCUMENTS))

    def count(kind: int) -> F.Column:
        return F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{pii.BASE[kind]}")

    return found.select(
        "doc_id", *map(count, range(4)), F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"),
        pii.spans_text(F.col("spans")).alias("spans"))


def op2_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Every document encoded to pieces and decoded again."""
    model = pieces.read_model(spark, PIECE_MODEL)
    docs = table(spark, sf, "documents", DOCUMENTS).select("doc_id", "text")
    done = pieces.encode(docs, model, restored=True)
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), pieces.digest_of(F.col("ids")).alias("ids_sha256"),
        "parity", "restored")


def op3_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate groups by fingerprints of three-word shingles."""
    found = simhash.near_duplicates(table(spark, sf, "documents", DOCUMENTS), shingle=3, budget=3)
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id", "copies")


def op4_langid(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document, learned from four folds of five."""
    docs = table(spark, sf, "documents", DOCUMENTS)
    fold = langid.in_fold(F.col("doc_id"))
    found = langid.identify(docs, ~fold & F.col("doc_id").isNotNull())
    return found.select("doc_id", fold.alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op5_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark windows in every document."""
    report, _ = decontaminate.contamination(
        table(spark, sf, "documents", DOCUMENTS), table(spark, sf, "benchmark", BENCHMARK))
    return report.select("doc_id", "n_words", "n_hit", "n_items",
                         F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_licences(spark: SparkSession, sf: str) -> DataFrame:
    """Known licences and notices in every document."""
    return licences.scan(table(spark, sf, "documents", DOCUMENTS), licences.known_digests(spark))


def op7_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """Every document without the passages that stand in an earlier one."""
    found = repeats.remove_passages(table(spark, sf, "documents", DOCUMENTS))
    spans = F.transform("removed", lambda s: F.concat_ws(":", s.start, s.end))
    return found.select(
        "doc_id", "n_units", F.size("removed").alias("n_removed"), F.array_join(spans, ",").alias("removed_spans"),
        "kept_text")


def op8_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The five best other vectors for every fiftieth vector."""
    vectors = table(spark, sf, "embeddings", EMBEDDINGS)
    return topk.top_products(vectors, F.col("vec_id") % 50 == 0)


def op9_shards(spark: SparkSession, sf: str) -> DataFrame:
    """24 shards along the Hilbert curve, counts at most one apart."""
    placed = sharding.hilbert_shards(table(spark, sf, "documents", DOCUMENTS), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op10_warc(spark: SparkSession, sf: str) -> DataFrame:
    """Every page written to archives and read back."""
    back = warc.round_trip(table(spark, sf, "pages", PAGES))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_editprint(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of every document and of it spliced with the next."""
    found = editprint.spliced_prints(table(spark, sf, "documents", DOCUMENTS))
    return found.select("doc_id", "n_chars", *(
        F.lower(F.hex(c)).alias(c) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")),
        "near_edited", "near_next")


def _damaged(turns: DataFrame) -> DataFrame:
    """The contract's damage: rows lost, emptied, cut off, repeated or given to the user, by a checksum of their key."""
    of = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = (F.crc32(of) % 20).alias("kind")
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind).where("kind <> 0")
    rows = rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(
            F.col("text")).alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))
    return rows.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("copy", "copies")


def op12_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation damaged and its role order repaired."""
    turns = table(spark, sf, "conversations", CONVERSATIONS)
    report = repair.repair_report(_damaged(turns))
    every = turns.select(F.col("conv_id").alias("_conv")).distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(report, F.col("_conv").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("_conv").alias("conv_id"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _looped(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with the contract's damage: the tail of a tenth of the texts repeats some of its words."""
    code = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    split = docs.select("doc_id", "text", code.alias("h"), F.when(code % 10 == 0, words).alias("w"))
    split = split.withColumn("n", F.size("w")).withColumn("g", F.floor(F.col("h") / 10))
    split = split.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    left = F.col("n") - F.col("a")
    split = split.withColumn("p", (F.floor(left / (3 + F.col("g") % 8)) + 1).cast("int"))
    turns = F.ceil(left / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), turns)), F.lit(1), left)
    looped = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")
    return split.select("doc_id", F.when(F.col("n") > 0, looped).otherwise(F.col("text")).alias("text"))


def op13_periodic(spark: SparkSession, sf: str) -> DataFrame:
    """Periodic runs of words in every document, a tenth of them given a repeating tail."""
    found = periodic.periodic_runs(_looped(table(spark, sf, "documents", DOCUMENTS)))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r.length.alias("length"), (-r.start).alias("before"), (-r.period).alias("short"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    return found.select("doc_id", "n_words", "runs", "collapsed", best.alias("best")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.before")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.short")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.short")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words")


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus pipeline at the repository's top."""
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if top not in sys.path:
        sys.path.insert(0, top)
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_pii, op2_pieces, op3_simhash, op4_langid, op5_decontamination, op6_licences, op7_repeats, op8_topk,
    op9_shards, op10_warc, op11_editprint, op12_repair, op13_periodic, pipeline)}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES: dict[str, str] = {
    "op5_decontamination": f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sized AS (SELECT item_id, w, least(13, len(w)) AS n FROM items WHERE len(w) > 0),
wins AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM sized, unnest(range(1, len(w) - n + 2)) AS t(i)),
sizes AS (SELECT DISTINCT n FROM wins),
spans AS (
  SELECT doc_id, s.n, i, array_to_string(w[i:i + s.n - 1], ' ') AS win
  FROM docs, sizes s, unnest(range(1, len(w) - s.n + 2)) AS t(i)),
found AS (SELECT s.doc_id, s.i, s.n, w.item_id FROM spans s JOIN wins w ON s.win = w.win AND s.n = w.n),
hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT doc_id, i, n FROM found), unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
per AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids
  FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit,
       coalesce(p.n_items, 0) AS n_items, sha256(coalesce(p.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN hits h USING (doc_id) LEFT JOIN per p USING (doc_id)""",
    "op6_licences": licences.scan_sql(),
    "op8_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT * FROM (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score FROM s) WHERE rank <= 5""",
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT page_id, h, sha1(h) AS d, octet_length(encode(h)) AS n, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM g""",
}
