"""Adapters from the driver's tables to the event-log shape.

* ``clicks``  — ``events``: item = ``props.$.k``, sessions by a 1-day inactivity gap.
* ``baskets`` — ``lineitem ⋈ orders``: one session per order, items = parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.sessions import gap_session_rows, gap_sessions
from ..schema import EVENT_COLUMNS, EVENT_ID, EVENT_TIME, ITEM, SESSION, USER
from .files import read_table


def parsed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as (event_id, event_time, user_id, product_id), nothing dropped: unreadable ids are
    null here. Only four columns are read (pruned at the scan)."""
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias(EVENT_ID),
        F.col("ts").cast("timestamp_ntz").alias(EVENT_TIME),
        F.col("user_id").alias(USER),
        F.get_json_object("props", "$.k").try_cast("bigint").alias(ITEM),
    )


def click_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``parsed_events`` that can be used; what is dropped here, ``ingest_drops`` counts."""
    return parsed_events(spark, sf_dir).filter(
        F.col(EVENT_TIME).isNotNull() & F.col(USER).isNotNull() & F.col(ITEM).isNotNull())


def clicks(spark: SparkSession, sf_dir: str, gap_seconds: int = 86_400) -> DataFrame:
    return gap_sessions(click_events(spark, sf_dir), gap_seconds).select(*EVENT_COLUMNS)


def click_rows(spark: SparkSession, sf_dir: str, gap_seconds: int = 86_400, next_of=(ITEM,),
               with_size: bool = False) -> DataFrame:
    """``clicks`` already ordered: + row_num, next_<c> (and session_len), one full shuffle."""
    return gap_session_rows(click_events(spark, sf_dir), gap_seconds, next_of=list(next_of), with_size=with_size)


def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``baskets`` with the long ``l_orderkey`` in place of the session's text.

    Lines are numbered before they meet their order, so the sort for the numbers is the sort for the join and
    a task holds its lines sorted once. Where a key has several orders, each line has a place for every one of them.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice").filter(F.col("l_orderkey").isNotNull())
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").filter(F.col("o_orderkey").isNotNull())
    line = F.row_number().over(
        Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    li = li.select("l_orderkey", "l_partkey", line.cast("bigint").alias("_line"))
    w = Window.partitionBy("o_orderkey").orderBy("o_orderdate", "o_custkey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    o = o.select("*", F.row_number().over(w).alias("_copy"), F.count(F.lit(1)).over(whole).alias("_copies"))
    return li.join(o, li.l_orderkey == o.o_orderkey, "inner").select(
        "l_orderkey",
        ((F.col("_line") - 1) * F.col("_copies") + F.col("_copy")).alias(EVENT_ID),
        F.col("o_orderdate").cast("timestamp_ntz").alias(EVENT_TIME),
        F.col("o_custkey").alias(USER),
        F.col("l_partkey").alias(ITEM),
    )


def _with_session(lines: DataFrame, *added: str) -> DataFrame:
    return lines.withColumn(SESSION, F.col("l_orderkey").cast("string")).select(*EVENT_COLUMNS, *added)


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sessions. ``event_id`` numbers the lines of an order (unique only with
    the session) by (l_linenumber, l_partkey, l_suppkey, l_extendedprice).

    The join and the numbering windows share the key ``l_orderkey``, so the plan
    shuffles once; an order is bounded by the number of its lines.
    """
    return _with_session(_order_lines(spark, sf_dir))


def basket_rows(spark: SparkSession, sf_dir: str, next_of=(ITEM,)) -> DataFrame:
    """``baskets`` already ordered: + row_num, next_<c>. A session is an order, whose lines the adapter has
    beside each other, so nothing is shuffled again. Equals ``session_rows(baskets(…))``."""
    w = Window.partitionBy("l_orderkey").orderBy(EVENT_TIME, EVENT_ID)
    rows = _order_lines(spark, sf_dir).select(
        "*", F.row_number().over(w).cast("bigint").alias("row_num"),
        *[F.lead(c, 1).over(w).alias(f"next_{c}") for c in next_of])
    return _with_session(rows, "row_num", *[f"next_{c}" for c in next_of])


ADAPTERS = {"clicks": clicks, "baskets": baskets}


def load_events(spark: SparkSession, sf_dir: str, adapter: str = "clicks") -> DataFrame:
    return ADAPTERS[adapter](spark, sf_dir)
