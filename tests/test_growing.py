"""A profile that grows: only new or changed files are scanned, and the counts equal a full scan's."""

from __future__ import annotations

import os
import shutil
import time

from pyspark.sql import functions as F

from tidemark.operators import growing, profile
from tidemark.sources import shards

MONTH = 30 * 86_400_000


def rows(seed, n):
    return [(float(1 + (k + seed) % 5) if k % 11 else 4.5, "t", "text" if k % 7 else " ", "V", f"P{(k * seed) % 4}" if k % 13 else None,
             f"U{k}", 1_600_000_000_000 + (k % 5) * MONTH) for k in range(n)]


def write(spark, folder, name, data):
    """One file at ``folder/name``."""
    part = f"{folder}-{name}-{time.time_ns()}"
    spark.createDataFrame(data, shards.REVIEW_SCHEMA).coalesce(1).write.parquet(part)
    (file,) = [f for f in os.listdir(part) if f.endswith(".parquet")]
    os.makedirs(folder, exist_ok=True)
    shutil.copy(f"{part}/{file}", f"{folder}/{name}.parquet")


def same_as_full_scan(spark, folder, volumes):
    full = profile.shard_volumes(shards.read_reviews(spark, folder))
    names = full.columns
    assert sorted(map(str, volumes.select(names).collect())) == sorted(map(str, full.collect()))
    assert profile.audit(volumes).first() == profile.audit(full).first()


def test_new_shards_alone_are_scanned(spark, tmp_path):
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    write(spark, folder, "a", rows(1, 300))
    write(spark, folder, "b", rows(2, 200))
    first = growing.grow_profile(spark, state, folder)
    assert sorted(os.path.basename(f) for f in first.scanned) == ["a.parquet", "b.parquet"]
    same_as_full_scan(spark, folder, first.volumes)
    write(spark, folder, "c", rows(3, 250))
    second = growing.grow_profile(spark, state, folder)
    assert [os.path.basename(f) for f in second.scanned] == ["c.parquet"]
    same_as_full_scan(spark, folder, second.volumes)
    assert growing.grow_profile(spark, state, folder).scanned == []
    # a changed file counts anew, one that is gone no longer
    time.sleep(1.1)
    write(spark, folder, "b", rows(5, 120))
    os.remove(f"{folder}/a.parquet")
    third = growing.grow_profile(spark, state, folder)
    assert [os.path.basename(f) for f in third.scanned] == ["b.parquet"]
    same_as_full_scan(spark, folder, third.volumes)
    assert third.volumes.agg(F.sum("total_rows")).first()[0] == 370
