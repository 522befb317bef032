"""The name-compatible facade on the hand log."""

import datetime as dt

from pyspark.sql import functions as F

from seqdrift.api import ContinualNextItemPredictor, NextItemPredictor


def test_predictor_roundtrip(spark, log):
    p = NextItemPredictor()
    assert p.train(log) == 5
    acc = {r.k: r.hits for r in p.evaluate_top_k(log, (1, 2)).collect()}
    assert acc == {1: 5, 2: 6}
    hist = spark.createDataFrame([("a", [10, 30]), ("b", [77])], "user_session string, history array<bigint>")
    got = {}
    for r in p.predict_next_items(hist, k=2).collect():
        got.setdefault(r.user_session, []).append((r.rank, r.item))
    assert [i for _, i in sorted(got["a"])] == [20, 10] and [i for _, i in sorted(got["b"])] == [20, 10]
    enc = p.preprocess_data(log, fit_encoders=False)
    assert {r.product_index for r in enc.filter(F.col("product_id") == 20).collect()} == {0}


def test_continual_clock_and_buffer(spark, log):
    c = ContinualNextItemPredictor(update_frequency_days=3)
    assert c.needs_update(dt.datetime(2024, 1, 1))
    c.initial_train_model(log)
    assert c.last_update == dt.datetime(2024, 1, 1, 10, 9)
    assert not c.needs_update(dt.datetime(2024, 1, 3, 10, 9))
    assert c.needs_update(dt.datetime(2024, 1, 4, 10, 9))
    buf = c.update_buffer(3, log.limit(0), log)
    assert buf.count() == 3
    out = c.evaluate_and_log_performance(log, dt.datetime(2024, 1, 2))
    assert out.filter("alert").count() == 0


def test_predict_with_exclusions(spark, log):
    p = NextItemPredictor()
    p.train(log)
    hist = spark.createDataFrame([("a", [20, 10])], "user_session string, history array<bigint>")
    ex = spark.createDataFrame([(20,)], "item bigint")
    got = sorted((r.rank, r.item) for r in p.predict_next_items(hist, k=2, exclude_items=ex).collect())
    assert [i for _, i in got] == [10, 30]


def test_empty_history_and_session_scoped_ids(spark, log):
    p = NextItemPredictor()
    p.train(log)
    hist = spark.createDataFrame([("e", [])], "user_session string, history array<bigint>")
    assert [r.item for r in p.predict_next_items(hist, k=2).orderBy("rank").collect()] == [20, 10]
    c = ContinualNextItemPredictor(window_size_days=1000)
    same = log.withColumn("event_id", F.lit(7))  # ids that are unique in no way
    assert c.update_buffer(10, log.limit(0), same).count() == 10
    c.update_model(log, log)
    assert c.model.agg(F.sum("cnt")).first()[0] == 6


def test_needs_a_shared_folder_on_a_cluster():
    import pytest
    from types import SimpleNamespace
    from seqdrift.config import checkpoint_root
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None),
                           sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(ValueError):
        checkpoint_root(fake)


def test_whole_history_scores(spark, log):
    p = NextItemPredictor(history_len=2)
    p.train(log)
    hist = spark.createDataFrame([("a", [9, 20, 10]), ("u", [77]), ("e", []), ("n", None)],
                                 "user_session string, history array<bigint>")
    ex = spark.createDataFrame([(20,)], "item bigint")
    got = {}
    for r in p.predict_next_items(hist, k=2, whole_history=True).orderBy("rank").collect():
        got.setdefault(r.user_session, []).append((r.item, r.score))
    # 10 -> 20 once at weight 2, 20 -> 30 twice at weight 1; the 9 is out of the last two
    assert got["a"] == [(20, 2), (30, 2)]
    assert got["u"] == got["e"] == got["n"] == [(20, 0), (10, 0)]
    less = p.predict_next_items(hist, k=2, exclude_items=ex, whole_history=True).orderBy("rank").collect()
    assert [r.item for r in less if r.user_session == "a"] == [30, 10]


def test_refit_with_a_buffer_takes_the_whole_slice(spark, log):
    """Without a buffer the trailing window cuts; with one the given slice is used whole, and its rows count once."""
    old = log.withColumn("event_time", F.col("event_time") - F.expr("INTERVAL 90 DAYS")) \
        .withColumn("user_session", F.concat(F.lit("old-"), "user_session"))
    both = log.unionByName(old)
    c = ContinualNextItemPredictor(window_size_days=30)
    c.update_model(both)
    assert c.model.agg(F.sum("cnt")).first()[0] == 6
    c.update_model(both, log)
    assert c.model.agg(F.sum("cnt")).first()[0] == 12
    c.update_model(log, old)
    assert c.model.agg(F.sum("cnt")).first()[0] == 12
