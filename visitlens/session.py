"""Spark session construction and the shared checkpoint location."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator, Mapping
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import SparkSession

# Settings every job relies on: adaptive execution (partition coalescing and
# skew-join splitting at runtime), a fixed session time zone so DATE values
# never shift, Arrow for the pandas UDF path, and no web UI.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, app_name: str = "visitlens",
                shuffle_partitions: int | None = None,
                extra_conf: dict[str, str] | None = None) -> SparkSession:
    """Return (or create) a session with the defaults above.

    ``master`` is only set when given, so on a cluster the launcher decides.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir`` (the cluster names a shared, durable
    folder there).  Only on a ``local`` master — tests — may it be unset: then
    a fresh scratch folder is created and registered.
    """
    sc = spark.sparkContext
    path = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="visitlens-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique sub-path of the shared checkpoint folder for a written table."""
    import uuid
    return os.path.join(checkpoint_dir(spark), "tables", f"{name}-{uuid.uuid4().hex[:12]}")


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def settings(spark: SparkSession, conf: Mapping[str, object]) -> Iterator[None]:
    """Jobs run in this block have these settings of the session."""
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def freed_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """Jobs run in this block delete their shuffle files when they end; else these stay
    until the driver happens to collect its garbage."""
    return settings(spark, {FREE_SHUFFLES: "true"})


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    at, fs = _path(spark, path)
    return bool(fs.exists(at))


def replace_path(spark: SparkSession, new: str, path: str) -> None:
    """Put the finished folder ``new`` in the place of ``path``.  What was there is
    moved aside first and deleted last; if the new folder cannot be moved it comes back."""
    import uuid
    at, fs = _path(spark, path)
    fresh, _ = _path(spark, new)
    aside, _ = _path(spark, f"{path.rstrip('/')}.old-{uuid.uuid4().hex[:12]}")
    had = fs.exists(at)
    if had and not fs.rename(at, aside):
        raise OSError(f"cannot move {path}")
    if not fs.rename(fresh, at):
        if had:
            fs.rename(aside, at)
        raise OSError(f"cannot move {new} to {path}")
    if had:
        fs.delete(aside, True)
    spark.catalog.refreshByPath(path)


def delete_path(spark: SparkSession, path: str) -> None:
    at, fs = _path(spark, path)
    fs.delete(at, True)


def list_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern, in order."""
    at, fs = _path(spark, pattern)
    return sorted(str(f.getPath()) for f in fs.globStatus(at) or [])
