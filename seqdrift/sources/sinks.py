"""Metrics sink and ingest statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..schema import EVENT_TIME, ITEM, SESSION, USER


def append_metrics(metrics: DataFrame, path: str, partition_by=("run",)) -> None:
    """Append a metrics table (accuracy rows, alerts, training stats) as parquet.

    Append-only and partitioned by run id, so a rerun after a lost executor rewrites
    only its own partition files and readers never see partial rows (job commit).
    """
    cols = [c for c in partition_by if c in metrics.columns]
    w = metrics.write.mode("append")
    if cols:
        w = w.partitionBy(*cols)
    w.parquet(path)


def ingest_stats(events: DataFrame, rsd: float | None = None) -> DataFrame:
    """One row: rows, null ids, distinct sessions/items/users, time range.

    ``rsd``: count distinct ids by sketches of that relative error (one aggregate, no expansion).
    """
    def distinct(c):
        return F.countDistinct(c) if rsd is None else F.approx_count_distinct(c, rsd)

    return events.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(ITEM).isNull()).alias("null_items"),
        F.count_if(F.col(USER).isNull()).alias("null_users"),
        F.count_if(F.col(SESSION).isNull()).alias("null_sessions"),
        distinct(SESSION).alias("n_sessions"),
        distinct(ITEM).alias("n_items"),
        distinct(USER).alias("n_users"),
        F.min(EVENT_TIME).alias("first_time"),
        F.max(EVENT_TIME).alias("last_time"),
    )


def ingest_drops(parsed: DataFrame) -> DataFrame:
    """One row over the unfiltered log: rows, nulls per needed column, rows dropped and kept."""
    bad = F.col(EVENT_TIME).isNull() | F.col(USER).isNull() | F.col(ITEM).isNull()
    return parsed.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(EVENT_TIME).isNull()).alias("null_times"),
        F.count_if(F.col(USER).isNull()).alias("null_users"),
        F.count_if(F.col(ITEM).isNull()).alias("null_items"),
        F.count_if(bad).alias("n_dropped"),
        F.count_if(~bad).alias("n_kept"),
    )


def write_event_log(events: DataFrame, path: str, files: int | None = None, mode: str = "overwrite") -> None:
    """Store a canonical event log as parquet partitioned by ``event_date``.

    Rows are range-partitioned on event_time (a hot day is split across tasks by
    sampled bounds, never one writer per day) and sorted within files, so row-group
    min/max statistics on event_time let time filters skip data inside a day too.
    """
    n = files or events.sparkSession.sparkContext.defaultParallelism
    out = events.withColumn("event_date", F.to_date(EVENT_TIME))
    out = out.repartitionByRange(n, EVENT_TIME).sortWithinPartitions(EVENT_TIME)
    out.write.mode(mode).partitionBy("event_date").parquet(path)


def read_event_log(spark, path: str, since=None, until=None) -> DataFrame:
    """Read a stored log; ``since``/``until`` (inclusive datetimes) prune date partitions
    and are pushed to the parquet scan as event_time filters."""
    df = spark.read.parquet(path)
    if since is not None:
        df = df.filter((F.col("event_date") >= F.lit(since).cast("date")) &
                       (F.col(EVENT_TIME) >= F.lit(since).cast("timestamp_ntz")))
    if until is not None:
        df = df.filter((F.col("event_date") <= F.lit(until).cast("date")) &
                       (F.col(EVENT_TIME) <= F.lit(until).cast("timestamp_ntz")))
    return df.drop("event_date")
