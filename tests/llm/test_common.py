"""Scratch tables: where they go, and how they go away."""

import os

import pytest

from skeinery.llm import common


def test_scratch_tables_are_cleared(spark, tmp_path):
    df = common.scratch(spark.range(10), "test")
    assert df.count() == 10
    (path,) = {f.rsplit("/", 2)[0].removeprefix("file://").removeprefix("file:") for f in df.inputFiles()}
    assert os.path.isdir(path)
    common.clear(spark)
    assert not os.path.isdir(path)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        common.shared_dir(Session())
