"""File-batch staging for streams (sources for M1–M8 in tests and registered queries).

A log is written as ``n_batches`` successive appends (time-ordered slices) into one
folder under the shared checkpoint root; a file stream with
``maxFilesPerTrigger = files per batch`` then replays them as successive
micro-batches. Optional: an overlap (events repeated in the next batch, for
dedupe) and a far-future sentinel event that pushes the watermark past every
window so append-mode state is flushed.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, functions as F

from ..config import materialize, scratch_path
from ..functions.time import MICROS_PER_SECOND, epoch_micros
from ..schema import EVENT_COLUMNS, EVENT_ID, EVENT_SCHEMA, EVENT_TIME

SENTINEL_TIME = "2100-01-01 00:00:00"


def stream_time(df: DataFrame) -> DataFrame:
    """Watermarks need an instant type: event_time → TIMESTAMP (session zone UTC)."""
    return df.withColumn(EVENT_TIME, F.col(EVENT_TIME).cast("timestamp"))


def batch_time(df: DataFrame, col: str = EVENT_TIME) -> DataFrame:
    return df.withColumn(col, F.col(col).cast("timestamp_ntz"))


def stage_batches(events: DataFrame, n_batches: int = 3, files_per_batch: int = 4, overlap_seconds: int = 0,
                  sentinel: bool = False, shuffled: str | None = None) -> tuple[str, int]:
    """Write ``events`` as time-ordered batches; returns (folder, maxFilesPerTrigger).

    shuffled: a seed; events then arrive in the order of a hash of their id instead.
    """
    spark = events.sparkSession
    ev = events.select(*EVENT_COLUMNS)
    span = ev.agg(F.min(EVENT_TIME).alias("_lo"), F.max(EVENT_TIME).alias("_hi"))
    rel = (epoch_micros(EVENT_TIME) - epoch_micros("_lo")).cast("double") / \
        (epoch_micros("_hi") - epoch_micros("_lo") + F.lit(1)).cast("double")
    of = F.floor(rel * n_batches) if shuffled is None else F.pmod(F.xxhash64(EVENT_ID, F.lit(shuffled)), F.lit(n_batches))
    if shuffled is None or overlap_seconds:  # only times need the span
        ev = ev.crossJoin(F.broadcast(span))
    tagged = ev.withColumn("_b", of.cast("int"))
    if overlap_seconds:
        # events in the last ``overlap_seconds`` of batch b are sent again with batch b+1
        edge = (epoch_micros("_hi") - epoch_micros("_lo") + F.lit(1)) * (F.col("_b") + 1) / n_batches + \
            epoch_micros("_lo")
        tagged = tagged.withColumn(
            "_dup", (edge - epoch_micros(EVENT_TIME) <= F.lit(overlap_seconds * MICROS_PER_SECOND)) &
            (F.col("_b") < n_batches - 1))
    else:
        tagged = tagged.withColumn("_dup", F.lit(False))
    tagged = materialize(tagged.drop("_lo", "_hi"), "stage-tagged")
    folder = scratch_path(spark, "stream-in")
    for b in range(n_batches):
        part = tagged.filter((F.col("_b") == b) | (F.col("_dup") & (F.col("_b") == b - 1)))
        part.select(*EVENT_COLUMNS).repartition(files_per_batch).write.mode("append").parquet(folder)
        time.sleep(1.1)  # distinct modification times keep the batches in order
    if sentinel:
        s = spark.createDataFrame([(-1, None, -1, -1, "-1")], EVENT_SCHEMA).withColumn(
            EVENT_TIME, F.lit(SENTINEL_TIME).cast("timestamp_ntz"))
        s.select(*EVENT_COLUMNS).repartition(files_per_batch).write.mode("append").parquet(folder)
    return folder, files_per_batch


def read_stream(spark, folder: str, files_per_trigger: int) -> DataFrame:
    # Event-time windows and watermarks need instants: wall-clock times are read as UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def run_to_parquet(sdf: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a streaming DataFrame over all available input into a parquet sink; return the sink."""
    spark = sdf.sparkSession
    out = scratch_path(spark, f"{name}-out")
    ckpt = scratch_path(spark, f"{name}-ckpt")
    q = sdf.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt) \
        .outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(sdf.schema).parquet(out) if has_files(spark, out) else \
        spark.createDataFrame([], sdf.schema)


def run_foreach_batch(sdf: DataFrame, name: str, fn) -> None:
    spark = sdf.sparkSession
    ckpt = scratch_path(spark, f"{name}-ckpt")
    q = sdf.writeStream.foreachBatch(fn).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()


def has_files(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


__all__ = ["stage_batches", "read_stream", "run_to_parquet", "run_foreach_batch", "stream_time", "batch_time",
           "SENTINEL_TIME"]
