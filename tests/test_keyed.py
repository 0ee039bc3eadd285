"""Keyed tables: files read and left alone, crashes before the publishing, two writers, nulls in keys."""

from __future__ import annotations

import random

import pytest

from tidemark.operators import keyed
from tidemark.operators.keyed import KeyedTable, VersionConflict

SCHEMA = "k1 string, k2 bigint, v string"


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "table"), SCHEMA, ["k1", "k2"], buckets=16)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def content(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def bucket_of(spark, table, key):
    return table._hashed(frame(spark, [(*key, "")]), 16).first()[keyed.BUCKET]


def test_insert_once_reads_only_files_that_may_hold_a_key(spark, table):
    first = [("a", i, "old") for i in range(2000)]
    assert table.insert_once(frame(spark, first + first[:50])).version == 1
    assert content(table.read()) == sorted(first, key=str)
    # three known keys and one new one
    batch = [("a", i, "again") for i in (5, 6, 7)] + [("b", 1, "new")]
    change = table.insert_once(frame(spark, batch))
    known = {bucket_of(spark, table, ("a", i)) for i in (5, 6, 7)}
    read = {int(f.rsplit("=", 1)[1]) for f in change.files_read}
    assert known <= read <= known | {bucket_of(spark, table, ("b", 1))}
    assert len(change.files_read) <= 4 < len(table.manifest().batches[0].words)
    assert content(change.rows) == [("b", 1, "new")] and change.version == 2
    # nothing known: of 300 new keys some one in a hundred opens a file for nothing
    change = table.insert_once(frame(spark, [("c", i, "x") for i in range(20)]))
    assert len(change.files_read) <= 4
    # nothing new: no version
    assert table.insert_once(frame(spark, batch)).version == 3 == table.versions()[-1]
    assert table.read().count() == 2021
    assert table.read(1).count() == 2000


def test_a_filter_denies_no_key(spark, table):
    rows = [(random.Random(i).choice(["", "x", None]), i if i % 7 else None, str(i)) for i in range(3000)]
    unique = {r[:2]: r for r in rows}
    table.insert_once(frame(spark, list(unique.values())))
    again = table.insert_once(frame(spark, rows))
    assert again.version == 1 and again.rows.count() == 0
    assert table.read().count() == len(unique)


def test_upsert_leaves_other_files(spark, table):
    table.insert_once(frame(spark, [("a", i, "old") for i in range(500)]))
    before = table.manifest()
    change = table.upsert(frame(spark, [("a", 3, "new"), (None, None, "null"), ("z", 9, "added")]))
    want = [("a", i, "new" if i == 3 else "old") for i in range(500)] + [(None, None, "null"), ("z", 9, "added")]
    assert content(table.read()) == sorted(want, key=str)
    kept = set(before.batches[0].words) & set(table.manifest().batches[0].words)
    assert len(change.files_read) <= 3 and len(kept) >= len(before.batches[0].words) - 3
    assert content(table.read(before.number)) == sorted((("a", i, "old") for i in range(500)), key=str)
    # the same updates again: the same rows
    table.upsert(frame(spark, [("a", 3, "new"), (None, None, "null"), ("z", 9, "added")]))
    assert content(table.read()) == sorted(want, key=str)
    table.upsert(frame(spark, [("a", 4, "mine")]), lambda stored, new: stored.unionByName(new).where("k2 <> 4 OR v = 'mine'"))
    assert table.read().where("k2 = 4").collect()[0].v == "mine"


def test_a_crash_before_publishing_leaves_the_version_before(spark, table, monkeypatch):
    table.insert_once(frame(spark, [("a", i, "old") for i in range(100)]))
    with monkeypatch.context() as crash:
        crash.setattr(KeyedTable, "_publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.upsert(frame(spark, [("a", i, "new") for i in range(50)]))
        with pytest.raises(OSError):
            table.insert_once(frame(spark, [("b", 1, "new")]))
    assert content(table.read()) == sorted((("a", i, "old") for i in range(100)), key=str)
    table.upsert(frame(spark, [("a", i, "new") for i in range(50)]))
    assert table.read().where("v = 'new'").count() == 50 and table.read().count() == 100
    table.vacuum()
    assert table.versions() == [2] and table.read().count() == 100


def test_the_second_of_two_writers_fails(spark, table, monkeypatch):
    table.insert_once(frame(spark, [("a", 1, "x")]))
    other = KeyedTable(spark, table.path, SCHEMA, ["k1", "k2"], buckets=16)
    at = other.manifest()
    table.upsert(frame(spark, [("a", 1, "mine")]))
    monkeypatch.setattr(other, "manifest", lambda version=None: at)
    with pytest.raises(VersionConflict):
        other.upsert(frame(spark, [("a", 1, "theirs")]))
    monkeypatch.undo()
    assert content(table.read()) == [("a", 1, "mine")]
    other.upsert(frame(spark, [("a", 1, "theirs")]))
    assert content(table.read()) == [("a", 1, "theirs")]


def test_compaction_and_empty_tables(spark, table):
    assert table.read().count() == 0 and table.manifest().number == 0
    assert table.insert_once(frame(spark, [])).version == 0
    for n in range(4):
        table.insert_once(frame(spark, [("a", i, str(n)) for i in range(20 * n, 20 * n + 20)]))
    rows = content(table.read())
    assert table.compact(most=2).version == 5
    assert content(table.read()) == rows and len(rows) == 80
    live = [k for b in table.manifest().batches for k in b.words]
    assert all(live.count(k) <= 2 for k in live)
    assert table.insert_once(frame(spark, [("a", 7, "again")])).rows.count() == 0
    assert keyed.is_keyed(spark, table.path) and not keyed.is_keyed(spark, table.path + "-none")
