"""The shared folder and the files in it."""

import os

import pytest

from riskloom import session


class _Cluster:
    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        master = "local-cluster[3,2,3000]"

        getConf = staticmethod(lambda: {})


def test_a_cluster_without_a_shared_folder_is_an_error(monkeypatch):
    for master in ("local-cluster[3,2,3000]", "spark://host:7077", "yarn", "k8s://x"):
        monkeypatch.setattr(_Cluster.sparkContext, "master", master)
        with pytest.raises(ValueError):
            session.shared_dir(_Cluster)
    assert session._one_process("local[4]") and session._one_process("local") and not session._one_process("local-cluster[1,1,1]")


def test_scratch_deletes_its_own_files(spark):
    keep = session.materialise(spark.range(3), "keep")
    with session.scratch(spark):
        inner = session.materialise(spark.range(5), "inner")
        files = [f.removeprefix("file:").replace("//", "/") for f in inner.inputFiles()]
        assert inner.count() == 5 and all(os.path.exists(f) for f in files)
    assert not any(os.path.exists(f) for f in files) and keep.count() == 3
