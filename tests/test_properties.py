"""Properties: the skew-safe operators equal their plain-window definitions."""

import datetime as dt
import random

from pyspark.sql import Window, functions as F

from seqdrift.functions.time import time_bucket
from seqdrift.operators.ordered import ordered_index
from seqdrift.operators import sampling as C
from seqdrift.operators import sessions as S
from seqdrift.schema import EVENT_SCHEMA


def random_log(spark, n=400, users=5, seed=7, hot=True):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        u = 0 if hot and rnd.random() < 0.5 else rnd.randrange(users)  # one hot user: half the rows
        t = base + dt.timedelta(seconds=rnd.randrange(0, 6 * 86400) // 600 * 600)  # many exact time ties
        rows.append((i, t, u, rnd.randrange(12), f"u{u}-{rnd.randrange(3)}"))
    return spark.createDataFrame(rows, EVENT_SCHEMA)


def test_ordered_index_equals_window(spark):
    ev = random_log(spark)
    for width in (600, 3600, 86400 * 10):
        got = ordered_index(ev, ["user_session"], ["event_time", "event_id"],
                            [("_b", time_bucket("event_time", width))], name="pos",
                            next_of=["product_id"], prev_of=["product_id"], key_size="sz")
        w = Window.partitionBy("user_session").orderBy("event_time", "event_id")
        ref = ev.select("event_id", F.row_number().over(w).alias("pos"),
                        F.lead("product_id").over(w).alias("nx"), F.lag("product_id").over(w).alias("pv"),
                        F.count(F.lit(1)).over(Window.partitionBy("user_session")).alias("sz"))
        a = sorted((r.event_id, r.pos, r.next_product_id, r.prev_product_id, r.sz) for r in got.collect())
        b = sorted((r.event_id, r.pos, r.nx, r.pv, r.sz) for r in ref.collect())
        assert a == b, width


def test_global_positions_no_key(spark):
    ev = random_log(spark, seed=3)
    got = ordered_index(ev, [], ["event_time", "event_id"], [("_b", time_bucket("event_time", 3600))],
                        name="pos", start=0)
    ref = ev.select("event_id", (F.row_number().over(Window.orderBy("event_time", "event_id")) - 1).alias("pos"))
    assert sorted((r.event_id, r.pos) for r in got.collect()) == sorted((r.event_id, r.pos) for r in ref.collect())


def test_gap_sessions_equal_plain_window(spark):
    ev = random_log(spark, seed=11).drop("user_session")
    for gap in (3600, 86400):
        got = S.gap_sessions(ev, gap)
        w = Window.partitionBy("user_id").orderBy("event_time", "event_id")
        prev = F.lag("event_time").over(w)
        gapd = F.col("event_time").cast("long") - prev.cast("long")
        ref = ev.withColumn("_s", F.when(prev.isNull() | (F.unix_seconds(F.col("event_time").cast("timestamp"))
                                                          - F.unix_seconds(prev.cast("timestamp")) > gap), 1)
                            .otherwise(0))
        ref = ref.withColumn("sess", F.concat(F.col("user_id").cast("string"), F.lit("-"),
                                              F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))
                                              .cast("string")))
        del gapd
        a = sorted((r.event_id, r.user_session) for r in got.collect())
        b = sorted((r.event_id, r.sess) for r in ref.collect())
        assert a == b, gap


def test_history_chunks_equal_frame(spark):
    ev = random_log(spark, seed=5)
    L = 4
    rows = S.session_rows(ev, next_of=["product_id"])
    got = S.history_windows(rows, L)
    w = Window.partitionBy("user_session").orderBy("event_time", "event_id")
    ref = ev.select("user_session", F.row_number().over(w).alias("row_num"),
                    F.collect_list("product_id").over(w.rowsBetween(-(L - 1), 0)).alias("h"))
    a = sorted((r.user_session, r.row_num, tuple(r.history)) for r in got.collect())
    b = sorted((r.user_session, r.row_num, tuple(r.h)) for r in ref.collect())
    assert a == b


def test_pair_count_identity(spark):
    ev = random_log(spark, seed=9)
    n_pairs = S.session_pairs(ev).count()
    expect = sum(max(r["count"] - 1, 0) for r in ev.groupBy("user_session").count().collect())
    assert n_pairs == expect


def test_exact_sample_is_bottom_n(spark):
    ev = random_log(spark, n=300, seed=2)
    got = {r.event_id for r in C.exact_sample(ev, 37, seed="s").collect()}
    ref = ev.withColumn("h", F.md5(F.concat(F.lit("s"), F.col("event_id").cast("string")))) \
        .orderBy("h").limit(37)
    assert got == {r.event_id for r in ref.collect()}


def test_vocab_prefix_blocks_equal_global_sort(spark):
    ev = random_log(spark, n=500, seed=4).withColumn("product_id", (F.col("event_id") * 7919) % 211)
    from seqdrift.operators.vocab import fit_vocab
    got = fit_vocab(ev, "product_id", prefix_len=1)
    c = ev.groupBy(F.col("product_id").alias("item")).count()
    ref = c.select("item", (F.row_number().over(Window.orderBy(F.col("count").desc(),
                                                               F.col("item").cast("string"))) - 1).alias("idx"))
    assert sorted((r.item, r.idx) for r in got.collect()) == sorted((r.item, r.idx) for r in ref.collect())


def test_results_independent_of_partitioning(spark):
    ev = random_log(spark, seed=21)
    a = sorted(map(tuple, S.session_pairs(ev.repartition(1)).select("event_id", "next_item").collect()))
    b = sorted(map(tuple, S.session_pairs(ev.repartition(7)).select("event_id", "next_item").collect()))
    assert a == b


def test_fused_gap_rows_equal_two_step(spark):
    ev = random_log(spark, seed=13).drop("user_session")
    for gap in (3600, 86400):
        fused = S.gap_session_rows(ev, gap, next_of=["product_id", "event_time"], with_size=True)
        two = S.session_rows(S.gap_sessions(ev, gap), next_of=["product_id", "event_time"], with_size=True)
        cols = ["event_id", "user_session", "row_num", "next_product_id", "next_event_time", "session_len"]
        assert sorted(map(tuple, fused.select(*cols).collect())) == sorted(map(tuple, two.select(*cols).collect()))
