"""Checkpoint folder lookup: session setting first, private folder only locally."""

from __future__ import annotations

import pytest

from wardline.session import checkpoint_dir


class _Conf:
    def __init__(self, value=None, read_only=False):
        self.value, self.read_only = value, read_only

    def get(self, key, default=None):
        return self.value if self.value is not None else default

    def set(self, key, value):
        if self.read_only:
            raise RuntimeError("read-only")
        self.value = value


class _Context:
    def __init__(self, master):
        self.master, self.dir = master, None

    def setCheckpointDir(self, path):
        self.dir = path


class _Session:
    def __init__(self, master, value=None, read_only=False):
        self.conf, self.sparkContext = _Conf(value, read_only), _Context(master)


def test_uses_the_session_setting():
    s = _Session("spark://cluster:7077", "hdfs://shared/ckpt")
    assert checkpoint_dir(s) == "hdfs://shared/ckpt" and s.sparkContext.dir == "hdfs://shared/ckpt"


def test_private_folder_only_for_local_sessions():
    s = _Session("local[4]", read_only=True)
    path = checkpoint_dir(s)
    assert path and s.sparkContext.dir == path
    with pytest.raises(RuntimeError):
        checkpoint_dir(_Session("spark://cluster:7077"))


def test_size_shuffles(spark):
    from wardline.session import size_shuffles

    keys = ["spark.sql.shuffle.partitions"]
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        assert size_shuffles(spark, 1024**3) == 8  # small input: the session's own count stays
        assert size_shuffles(spark, 100 * 1024**4) == 409_600  # 100 TB at 256 MB per partition
        assert spark.conf.get("spark.sql.shuffle.partitions") == "409600"
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
