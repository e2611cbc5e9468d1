"""Staging: where tables go, that a cluster needs a shared folder, and that they are deleted."""

import os
from types import SimpleNamespace

import pytest

from tidemark.plans import tables


def test_staged_tables_are_deleted(spark):
    with tables.staging(spark):
        path = tables.scratch(spark, "one").removeprefix("file://")
        staged = tables.stage(spark.range(5), "two")
        spark.range(3).write.parquet("file://" + path)
        assert staged.count() == 5 and os.path.isdir(path)
        there = len(tables._STAGED)
    assert not os.path.exists(path) and len(tables._STAGED) == there - 2


@pytest.mark.parametrize(("master", "ok"), [("local", True), ("local[8]", True), ("local-cluster[3,2,3000]", False), ("yarn", False), ("spark://host:7077", False)])
def test_a_cluster_needs_a_shared_folder(master, ok):
    conf = SimpleNamespace(get=lambda key, default=None: default)
    session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))
    if ok:
        assert tables.shared_dir(session).startswith("file://")
    else:
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            tables.shared_dir(session)
    conf.get = lambda key, default=None: "hdfs://shared/folder/"
    assert tables.shared_dir(session) == "hdfs://shared/folder"
