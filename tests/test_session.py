"""Checkpoint folder rules: the session's setting wins; a cluster without one is refused."""

import pytest

from marketlens.session import checkpoint_root


class _Conf:
    def __init__(self, values):
        self.values = dict(values)

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


class _Context:
    def __init__(self, master, ckpt=None):
        self.master, self._ckpt = master, ckpt

    def getCheckpointDir(self):
        return self._ckpt

    def setCheckpointDir(self, path):
        self._ckpt = path


class _Session:
    def __init__(self, master, conf=None, ckpt=None):
        self.conf, self.sparkContext = _Conf(conf or {}), _Context(master, ckpt)


def test_session_setting_wins():
    assert checkpoint_root(_Session("yarn", {"spark.checkpoint.dir": "hdfs://nn/ckpt/"})) == "hdfs://nn/ckpt"
    assert checkpoint_root(_Session("k8s://x", ckpt="s3a://bucket/ckpt")) == "s3a://bucket/ckpt"


def test_cluster_without_shared_folder_is_refused():
    with pytest.raises(RuntimeError):
        checkpoint_root(_Session("spark://master:7077"))


def test_local_master_gets_a_private_folder():
    s = _Session("local[4]")
    root = checkpoint_root(s)
    assert root and s.conf.get("spark.checkpoint.dir") == root and s.sparkContext.getCheckpointDir() == root


def test_scratch_deletes_stream_and_written_report_folders(spark):
    import os
    from marketlens.plans.registry import QUERIES
    from marketlens.session import scratch
    from tests.conftest import SMALL
    with scratch(spark) as written:
        assert QUERIES["tb_price_stream"](spark, SMALL).count() > 0
        assert QUERIES["competitor_report_written"](spark, SMALL).count() == 500
        names = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in written}
    assert {"price-stream", "written-report"} <= names
    assert not any(os.path.exists(p.removeprefix("file:")) for p in written)
