"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job relies on: UTC calendar math, AQE for runtime re-planning
# (partition coalescing, skew-join splitting, broadcast conversion).
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(
    master: str | None = None,
    app_name: str = "cabline",
    shuffle_partitions: int | None = None,
    extra: dict | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(SESSION_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    for k, v in conf.items():
        if spark.conf.isModifiable(k):  # a static setting of a running session stays
            spark.conf.set(k, v)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Read from the session. Only a local master may leave it unset (tests,
    local runs): then a default below the system temp folder is set. On a
    cluster such a folder would be another one on every machine, so an unset
    setting fails.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext._conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = os.path.join(os.environ.get("TMPDIR", "/tmp"), "cabline-checkpoints")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


_SCRATCH: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below this application's folder in the shared folder. The
    file system removes the folder when the driver's JVM ends; until then
    what queries return can be read."""
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        base = f"{shared_dir(spark).rstrip('/')}/cabline-{app}"
        p, fs = _hadoop_path(spark, base)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _SCRATCH[app] = base
    return f"{_SCRATCH[app]}/{name}-{uuid.uuid4().hex}"


def _hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists, asked of its own file system. An unreadable
    store fails here: it is never taken for an absent table."""
    p, fs = _hadoop_path(spark, path)
    return bool(fs.exists(p))


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of folder ``path``; none if it does not exist."""
    p, fs = _hadoop_path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below ``path``."""
    p, fs = _hadoop_path(spark, path)
    return int(fs.getContentSummary(p).getLength())


@contextmanager
def shuffles_removed(spark: SparkSession):
    """The shuffle files of what is written inside go when it is written, not
    when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def remove_path(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop_path(spark, path)
    fs.delete(p, True)


def remove_scratch(spark: SparkSession) -> None:
    """Remove this application's scratch folder now. What queries returned
    from it cannot be read afterwards."""
    base = _SCRATCH.pop(spark.sparkContext.applicationId, None)
    if base:
        remove_path(spark, base)
