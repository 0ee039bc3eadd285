"""Stored tables: kept, removed with their block, refused on a local disk of a cluster."""

from __future__ import annotations

import os
from types import SimpleNamespace

import pytest

from tidemark.operators import lineage


def local(df):
    return [f.removeprefix("file://") for f in df.inputFiles()]


def test_scratch_tables_go_and_kept_ones_stay(spark):
    with lineage.scratch(spark) as keep:
        inside = lineage.cut(spark.range(5))
        with lineage.scratch(spark) as keep_inner:
            deep = lineage.cut(spark.range(3))
            middle = keep_inner(deep)
        assert not any(map(os.path.exists, local(deep))) and middle.count() == 3
        kept = keep(inside.unionByName(middle))
    assert not any(map(os.path.exists, local(inside) + local(middle)))
    assert kept.count() == 8
    with pytest.raises(KeyError), lineage.scratch(spark):
        inside = lineage.cut(spark.range(2))
        raise KeyError
    assert not any(map(os.path.exists, local(inside)))
    after = lineage.cut(spark.range(1))
    assert os.path.dirname(after.inputFiles()[0]).rsplit("/", 1)[0].endswith(lineage.session_folder(spark).rsplit("/", 1)[1])


def test_a_local_warehouse_is_refused_on_a_cluster():
    settings = {"spark.sql.warehouse.dir": "file:/home/work/warehouse"}
    conf = SimpleNamespace(get=lambda k, d=None: settings.get(k, d), set=settings.__setitem__)
    far = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://head:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.shared_folder(far)
    near = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[4]"))
    assert lineage.shared_folder(near) == "file:/home/work/warehouse/_stored"
    settings["spark.checkpoint.dir"] = "hdfs://cluster/shared/"
    assert lineage.shared_folder(far) == "hdfs://cluster/shared"


def test_short_lists_are_checked(spark):
    assert lineage.bounded(spark.range(5), 5, "things").count() == 5
    with pytest.raises(Exception, match="things: more than 4 rows"):
        lineage.bounded(spark.range(5), 4, "things").collect()
