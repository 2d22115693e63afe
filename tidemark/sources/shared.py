"""Folders for data that the driver and all executors see, and that go when the session ends."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import warnings
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_own: dict[str, str] = {}
_paths: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where that is unset, a folder of this process is used if all tasks run on this machine, as in tests;
    on a cluster that is an error.
    """
    if at := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return at.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(f"file://{_own[app]}")
    return f"file://{_own[app]}"


def new_folder(spark: SparkSession) -> str:
    """The path of a new folder there; see release() for when it is removed."""
    _on_stop(spark)
    _paths.append(f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}")
    return _paths[-1]


def release(spark: SparkSession, keep: int = 0) -> None:
    """Remove the folders of new_folder() but for the keep first; results that were not yet written or collected go with them.

    All are removed when the session is stopped, or else when the driver's process ends. What can't be
    removed is named in a warning.
    """
    while len(_paths) > keep:
        path = _paths.pop()
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception as e:  # noqa: BLE001  no kind of failure may keep the others from being removed
            warnings.warn(f"{path} was not removed: {e!r}", stacklevel=2)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Folders made within are removed on leaving: write or collect results before."""
    keep = len(_paths)
    try:
        yield
    finally:
        release(spark, keep)


def _on_stop(spark: SparkSession) -> None:
    """Have release() run while the session can still remove."""
    if getattr(spark.stop, "releases", False):
        return
    stop = spark.stop

    def released() -> None:
        release(spark)
        atexit.unregister(released_at_exit)
        stop()

    def released_at_exit() -> None:
        release(spark)

    released.releases = True
    spark.stop = released
    atexit.register(released_at_exit)
