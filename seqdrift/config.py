"""Session construction and shared-storage helpers.

Everything that must outlive a task (stream checkpoints, staged files, lineage
cuts) goes under ``spark.checkpoint.dir``, which on a cluster names a shared
folder. A local default is set only when the session has none (tests).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import weakref

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, app: str = "seqdrift",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local one only in local mode, if unset.

    On a cluster a local folder would be another one on each executor, so its absence is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
        d = tempfile.mkdtemp(prefix="seqdrift-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder path under the shared checkpoint root."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/seqdrift/{name}-{uuid.uuid4().hex[:12]}"


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme so local tools can see a path (tests only)."""
    return path[5:] if path.startswith("file:") else path


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


#: Removes an execution's shuffle files when it ends, instead of when the driver's garbage collection finds them.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_WRITTEN: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def materialize(df, name: str):
    """Write ``df`` as parquet under the shared checkpoint root and read it back.

    Used for intermediate tables that several branches of a protocol reuse: the
    lineage is cut (a lost executor re-reads files instead of recomputing the
    protocol), and the read-back scan carries real file sizes, so the planner's
    broadcast decisions rest on a measured size, not a guess. What the write shuffled
    is removed with it: nothing reads it again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.parquet(path)
    _WRITTEN[out] = path
    return out


def discard(*tables) -> None:
    """Delete the files of materialized tables whose last reader is done."""
    for t in tables:
        path = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop(t))
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
