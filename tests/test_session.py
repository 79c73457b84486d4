from __future__ import annotations

import pytest

from stayflow import session


class _Context:
    def __init__(self, master):
        self.master, self.dir = master, None

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, path):
        self.dir = path


class _Session:
    def __init__(self, master, root=None):
        self.sparkContext, self.root = _Context(master), root
        self.conf = self

    def get(self, name, default):
        return self.root if name == "spark.checkpoint.dir" and self.root else default


def test_the_named_folder_is_used():
    assert session.shared_root(_Session("yarn", "hdfs://x/cp/")) == "hdfs://x/cp"


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError):
        session.shared_root(_Session("spark://host:7077"))


def test_local_mode_makes_its_own_once():
    local = _Session("local[2]")
    assert session.shared_root(local) == session.shared_root(local)


def test_work_dirs_differ(spark):
    assert session.work_dir(spark, "a") != session.work_dir(spark, "a")


def test_state_partitions_are_fixed_and_restored(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.stayflow.state.partitions", "3")
    try:
        with session.stream_conf(spark):
            assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    finally:
        spark.conf.unset("spark.stayflow.state.partitions")
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
