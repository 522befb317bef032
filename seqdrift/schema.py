"""The event-log data model (one row per user–item interaction)."""

from pyspark.sql import types as T

EVENT_TIME = "event_time"
ITEM = "product_id"
USER = "user_id"
SESSION = "user_session"
EVENT_ID = "event_id"

# Canonical column order of an event log.
EVENT_COLUMNS = [EVENT_ID, EVENT_TIME, USER, ITEM, SESSION]

EVENT_SCHEMA = T.StructType([
    T.StructField(EVENT_ID, T.LongType(), True),
    T.StructField(EVENT_TIME, T.TimestampNTZType(), True),
    T.StructField(USER, T.LongType(), True),
    T.StructField(ITEM, T.LongType(), True),
    T.StructField(SESSION, T.StringType(), True),
])

# Raw click-log layout: ids arrive as text, time as text.
RAW_CSV_SCHEMA = T.StructType([
    T.StructField(EVENT_TIME, T.StringType(), True),
    T.StructField(ITEM, T.StringType(), True),
    T.StructField(USER, T.StringType(), True),
    T.StructField(SESSION, T.StringType(), True),
    T.StructField(EVENT_ID, T.StringType(), True),
])
