"""Commit records of jobs that write per micro-batch: what counts is what a record names.

A batch writes its tables under its own id, overwriting an earlier attempt, and puts its record in
place by one rename as the last step. Readers and later batches see committed batches only, so a
batch that failed half-way or is delivered again leaves one result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .staging import has_files


def _fs(spark, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def commit(spark, root: str, batch_id: int) -> None:
    """Record batch ``batch_id`` of ``root`` as complete (again: no change)."""
    folder, fs = _fs(spark, f"{root}/commits")
    fs.mkdirs(folder)
    done, _ = _fs(spark, f"{root}/commits/{batch_id}")
    if fs.exists(done):
        return
    begun, _ = _fs(spark, f"{root}/commits/.{batch_id}")
    fs.create(begun, True).close()
    fs.rename(begun, done)


def committed(spark, root: str, before: int | None = None) -> list[int]:
    """Ids of the committed batches in order, only those before ``before`` if given (one per batch)."""
    folder, fs = _fs(spark, f"{root}/commits")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n) for n in names if n.lstrip("-").isdigit() and (before is None or int(n) < before))


def read_committed(spark, root: str, name: str, schema=None) -> DataFrame | None:
    """The rows of all committed batches in ``root``/``name``/batch_id=…; None if there are none."""
    ids = committed(spark, root)
    if not ids or not has_files(spark, f"{root}/{name}"):
        return None
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{root}/{name}").where(F.col("batch_id").isin(ids))


class MetricsStream:
    """A5/L11 in a stream: metric rows and alerts, one set per (run, batch) however often it is delivered.

    measure(batch) -> metric rows. ``result()`` gives the rows of committed batches with ``run`` and
    ``batch_id``; ``alerts`` judges them with the batch rule, previous batch against this one.
    """

    def __init__(self, spark, measure, run: str, root: str):
        self.spark, self.measure, self.run = spark, measure, run
        self.root = f"{root}/run={run}"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.measure(batch).write.mode("overwrite").parquet(f"{self.root}/metrics/batch_id={batch_id}")
        commit(self.spark, self.root, batch_id)

    def result(self) -> DataFrame | None:
        rows = read_committed(self.spark, self.root, "metrics")
        return None if rows is None else rows.withColumn("run", F.lit(self.run)).withColumn("batch_id", F.col("batch_id").cast("bigint"))

    def alerts(self) -> DataFrame | None:
        from ..plans.alerts import degradation_alerts
        rows = self.result()
        return None if rows is None else degradation_alerts(rows.withColumn("variant", F.col("run")), order="batch_id")


__all__ = ["commit", "committed", "read_committed", "MetricsStream"]
