"""Event-log readers and the empty-log constructor (A1, A2, A4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..config import table_path
from ..schema import EVENT_COLUMNS, EVENT_ID, EVENT_SCHEMA, EVENT_TIME, ITEM, SESSION, USER


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def parse_event_time(col: Column | str) -> Column:
    """Text → ``timestamp_ntz``; a trailing `` UTC`` is accepted, bad text → NULL."""
    c = F.col(col) if isinstance(col, str) else col
    text = F.regexp_replace(F.trim(c.cast("string")), " UTC$", "")
    return text.try_cast("timestamp_ntz")


def normalize_events(df: DataFrame) -> DataFrame:
    """Cast a raw log to the canonical schema; other columns are pruned here.

    When the log has no ``event_id`` a stable one is derived from the row content
    (xxhash64 of time, user, item and session) — it only breaks time ties.
    """
    cols = set(df.columns)
    out = df.select(
        (F.col(EVENT_ID).cast("bigint") if EVENT_ID in cols else
         F.xxhash64(EVENT_TIME, USER, ITEM, SESSION)).alias(EVENT_ID),
        parse_event_time(EVENT_TIME).alias(EVENT_TIME) if dict(df.dtypes)[EVENT_TIME] == "string"
        else F.col(EVENT_TIME).cast("timestamp_ntz").alias(EVENT_TIME),
        F.expr(f"try_cast({USER} as bigint)").alias(USER),
        F.expr(f"try_cast({ITEM} as bigint)").alias(ITEM),
        F.col(SESSION).cast("string").alias(SESSION),
    )
    return out.select(*EVENT_COLUMNS)


def read_events_csv(spark: SparkSession, path: str, infer: bool = False, schema: StructType | None = None) -> DataFrame:
    """Header CSV click log, columns matched by header name (extra columns are pruned).

    Without inference every column is read as text and cast once in
    ``normalize_events``; ``infer=True`` mirrors type inference (one extra scan). With ``schema`` (e.g.
    ``RAW_CSV_SCHEMA``) the file is not looked at before it is scanned; a header of other names or
    another order is then an error, not a shifted column.
    """
    r = spark.read.option("header", True)
    if schema is not None:
        return normalize_events(r.schema(schema).option("enforceSchema", False).csv(path))
    raw = r.option("inferSchema", True).csv(path) if infer else r.csv(path)
    return normalize_events(raw)


def read_events_parquet(spark: SparkSession, path: str) -> DataFrame:
    return normalize_events(spark.read.parquet(path))


def empty_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EVENT_SCHEMA)
