"""Folders in the shared place."""

import os
from types import SimpleNamespace

import pytest

from tidemark.sources import shared


def test_folders_go_with_the_session_or_their_context(spark, monkeypatch):
    local = lambda path: path.removeprefix("file://")
    with shared.intermediates(spark):
        inner = shared.new_folder(spark)
        spark.range(3).write.parquet(f"{inner}/x")
        assert os.path.isdir(local(inner))
    assert not os.path.exists(local(inner))
    stopped = []
    session = SimpleNamespace(conf=spark.conf, sparkContext=spark.sparkContext, stop=lambda: stopped.append(1))
    monkeypatch.setattr(shared, "_paths", [])
    outer = shared.new_folder(session)
    spark.range(3).write.parquet(outer)
    session.stop()
    assert stopped == [1] and not os.path.exists(local(outer))


def test_a_cluster_must_name_its_folder():
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(cluster)
