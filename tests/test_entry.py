"""The driver contract, on the smallest data."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tidemark import session

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")

duckdb = pytest.importorskip("duckdb")


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_runs(spark):
    rows = entry.entry(spark).collect()
    assert {r["level"] for r in rows} == {"anomaly", "watch"}
    assert sorted(r["rank"] for r in rows) == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("name", ["monthly_stats", "coverage_by_month", "comparison_signal", "import_waterfall", "cosine_topk"])
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SMALL):
        con.execute(f"create view {file.split('.')[0]} as select * from '{SMALL}/{file}'")
    df = entry.queries()[name](spark, SMALL)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)

    def canonical(columns, data):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        return sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in (r[i] for i in order)) for r in data)

    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(names, cur.fetchall())


def test_tasks_after_a_shuffle_grow_in_number(spark):
    """A report's shuffles start with 200 partitions in a session of 4, and with the session's where it has more."""
    initial, size = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    own = {k: spark.conf.get(k, None) for k in (initial, size, "spark.sql.shuffle.partitions")}
    try:
        for wished, got in (("4", 200), ("300", 300)):
            spark.conf.set("spark.sql.shuffle.partitions", wished)
            df = entry.queries()["mention_counts"](spark, SMALL)
            assert f", {got}), ENSURE_REQUIREMENTS" in df._jdf.queryExecution().executedPlan().toString()
            assert spark.conf.get(size) == "8m"
    finally:
        for k, v in own.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_tasks_after_a_shuffle_grow_with_the_tables(spark, tmp_path, monkeypatch):
    """Shuffles start with a partition for every so many bytes of the largest table, once that is over 200."""
    initial, size = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    own = {k: spark.conf.get(k, None) for k in (initial, size)}
    (tmp_path / "a.parquet").write_bytes(b"x" * 1000)
    (tmp_path / "b.parquet").mkdir()
    for name in ("part-0", "part-1"):
        (tmp_path / "b.parquet" / name).write_bytes(b"x" * 1500)
    monkeypatch.setattr("tidemark.session.PARTITION_INPUT", 7)
    try:
        session.bound_tasks(spark, str(tmp_path))
        assert spark.conf.get(initial) == "429"
    finally:
        for k, v in own.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_tasks_before_a_shuffle_grow_in_number(spark, tmp_path, monkeypatch):
    """A task reads a bounded part of a file; a session with smaller tasks keeps them."""
    names = ("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes",
             "spark.sql.files.maxPartitionBytes")
    own = {k: spark.conf.get(k, None) for k in names}
    spark.range(4000).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    stored = session.largest_table(spark, str(tmp_path))
    monkeypatch.setattr("tidemark.session.TASK_INPUT", 1000, raising=False)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
        session.bound_tasks(spark, str(tmp_path))
        assert spark.read.parquet(f"{tmp_path}/t.parquet").rdd.getNumPartitions() >= stored // 1000 - 1 > 5
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
        session.bound_tasks(spark, str(tmp_path))
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "500"
    finally:
        for k, v in own.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
