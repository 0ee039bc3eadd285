"""From raw documents to piece numbers: language, near copies, benchmark passages, personal data, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet to the
folder in spark.checkpoint.dir and read again for the next one. All but the last return the columns of documents.
Documents are read where they lie: the stages that filter know a row by its file and number, and copy no text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, langid, pieces, pii, simhash
from tidemark.llm.queries import BENCHMARK, DOCUMENTS, PIECE_MODEL, table
from tidemark.llm.rows import bound_batches
from tidemark.operators.lineage import scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; the rejected ones go."""
    bound_batches(spark)
    return langid.keep_known(docs, stored=True)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    bound_batches(spark)
    return simhash.keep_one(docs, stored=True)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    bound_batches(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark", BENCHMARK), stored=True)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal spans masked."""
    bound_batches(spark)
    return pii.mask_personal(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece numbers of every document."""
    bound_batches(spark)
    done = pieces.encode(docs, pieces.read_model(spark, PIECE_MODEL))
    return done.select("doc_id", "lang", "source", "ids", "parity")


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark_passages),
    ("PII", personal_data),
    ("SentencePiece encoding and decoding", encoding),
]

# a language model, a classifier and a tokeniser are beyond SQL; the tests compare with plain loops
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage stored goes when its output is written, the outputs when the last one is."""
    docs = table(spark, sf_dir, "documents", DOCUMENTS)
    with scratch(spark) as keep_last:
        for k, (_, stage) in enumerate(STAGES, 1):
            with scratch(spark) as keep:
                done = stage(spark, docs, sf_dir)
                docs = keep_last(done) if k == len(STAGES) else keep(done)
    return docs
