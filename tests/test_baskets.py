"""The baskets adapter: its numbers on odd orders, and how often its rows are shuffled."""

import datetime as dt

from pyspark.sql import Window, functions as F

from conftest import SF001
from seqdrift.operators import sessions as S
from seqdrift.sources import adapters as A

LINES = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_extendedprice double"
ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp"


def _tables(spark, folder, third=None):
    """Orders 2 and 3 stand twice or three times (the last at ``third``), line 1 of order 1 twice; null keys, lone rows."""
    lines = [(1, 7, 1, 1, 5.0), (1, 7, 1, 1, 5.0), (1, 8, 1, 2, None), (1, 6, 2, 2, 1.0), (2, 5, 1, None, 1.0), (2, 4, 1, 1, 1.0),
             (3, 9, 1, 1, 2.0), (3, 9, 2, 2, 2.0), (3, 3, 2, 2, 2.0), (4, 1, 1, 1, 1.0), (None, 1, 1, 1, 1.0), (5, None, 1, 1, 1.0), (5, 2, 1, 2, 1.0)]
    day = [dt.datetime(2024, 1, d) for d in (1, 2)]
    orders = [(1, 1, day[0]), (2, 2, day[1]), (2, 3, day[0]), (3, 4, day[0]), (3, 5, day[0]), (3, 6, third), (None, 9, day[0]), (5, 1, day[0]), (6, 1, day[0])]
    spark.createDataFrame(lines, LINES).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(orders, ORDERS).write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def _sorted(df):
    return sorted(map(repr, df.collect()))


def test_numbers_of_odd_orders(spark, tmp_path):
    d = _tables(spark, tmp_path)
    li, o = spark.read.parquet(f"{d}/lineitem.parquet"), spark.read.parquet(f"{d}/orders.parquet")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "o_orderdate", "o_custkey")
    plain = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.row_number().over(w).cast("bigint").alias("event_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("event_time"),
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("product_id"), F.col("l_orderkey").cast("string").alias("user_session"))
    got = A.baskets(spark, d)
    assert got.columns == plain.columns and _sorted(got) == _sorted(plain) and got.count() == 19


def test_rows_and_pairs_equal_the_general_ones(spark, tmp_path):
    for d in (_tables(spark, tmp_path, dt.datetime(2024, 1, 3)), SF001):
        rows = A.basket_rows(spark, d)
        want = S.session_rows(A.baskets(spark, d), next_of=["product_id"])
        assert _sorted(rows.select(*want.columns)) == _sorted(want)


def test_an_order_without_a_date_keeps_its_rows(spark, tmp_path):
    got = A.basket_rows(spark, _tables(spark, tmp_path)).filter(F.col("user_id") == 6).orderBy("row_num").collect()
    assert [(r["row_num"], r["product_id"], r["next_product_id"]) for r in got] == [(1, 9, 3), (2, 3, 9), (3, 9, 9)]


def test_pairs_shuffle_lines_and_orders_once(spark):
    from __spark_entry__ import queries
    plan = queries()["basket_pairs"](spark, SF001)._jdf.queryExecution().sparkPlan().toString()
    executed = queries()["basket_pairs"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange hashpartitioning") == 2 and "Aggregate" not in plan


def test_the_split_log_is_joined_once(spark):
    from seqdrift.catalog import QUERIES
    for name in ("encode_unknown", "decode_items"):
        plan = QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
        assert "lineitem" not in plan and "split-log" in plan
