"""The pipeline's stages on a small table, and the registered queries on the smallest data."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import AWKWARD, DOC, frame, language_rows
from tidemark.llm import pieces, queries

SMALL = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    passage = " ".join(f"aeiou{k % 7}lmn" for k in range(30))
    rows = language_rows()
    texts = [*AWKWARD, rows[0][1] + " mail bob@mail.example.com", rows[2][1] + " " + passage]
    docs = frame(spark, texts, clash=False).withColumn("doc_id", F.col("doc_id") + 5000).unionByName(
        spark.createDataFrame(rows, DOC))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage)], queries.BENCHMARK).write.parquet(f"{folder}/benchmark.parquet")
    return folder


@here
def test_stages(spark, tables):
    docs = queries.table(spark, tables, "documents", queries.DOCUMENTS)
    names, before = docs.columns, docs.count()
    clean = {r[0] for r in language_rows()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        done = stage(spark, docs, tables)
        assert stage(spark, docs.limit(0), tables).count() == 0, name
        if k < len(corpus_pipeline.STAGES) - 1:
            assert done.columns == names, name
        path = f"{tables}/stage-{k}"
        done.write.parquet(path)
        docs = spark.read.parquet(path)
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert clean - {0, 2} <= ids, name
        assert docs.count() <= before
        before = docs.count()
    assert docs.where("size(ids) = 0 or not parity").count() == 0
    assert 5000 + len(AWKWARD) + 1 not in ids  # the benchmark passage
    model = pieces.read_model(spark, queries.PIECE_MODEL)
    text = pieces.decode(docs, model).where("decoded like '%[EMAIL]%'").count()
    assert text == 1 or not ids & {5000 + len(AWKWARD)}


@here
@pytest.mark.parametrize("name", [n for n in queries.ORACLES])
def test_queries_agree_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(SMALL):
        con.execute(f"create view {file.split('.')[0]} as select * from '{SMALL}/{file}'")
    df = queries.QUERIES[name](spark, SMALL)
    cur = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in cur.description]
    got = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    assert sorted(df.columns) == sorted(columns) and got == sorted(str(tuple(r)) for r in cur.fetchall())


@here
def test_every_query_covers_its_table(spark):
    tables = {"op8_topk": None, "op10_warc": "pages", "pipeline": None}
    for name, query in queries.QUERIES.items():
        of = tables.get(name, "documents")
        rows = query(spark, SMALL).count()
        assert rows == (spark.read.parquet(f"{SMALL}/{of}.parquet").count() if of else rows) and rows > 0, name
