"""Protocols: phase plan arithmetic (§3.2), dates (§3.3), alerts (§3.4), sf0.01 anchors (§4)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from seqdrift.plans.alerts import degradation_alerts
from seqdrift.plans.phases import phase_plan, sizes


def plan_rows(spark, n):
    p = phase_plan(sizes(spark.range(n)))
    return [(r.phase, r.train_start, r.train_end, r.test_start, r.test_end) for r in p.orderBy("phase").collect()]


def test_phase_plan_100(spark):
    assert plan_rows(spark, 100) == [
        (0, 0, 45, 45, 50), (1, 15, 55, 55, 60), (2, 25, 65, 65, 70), (3, 35, 75, 75, 80),
        (4, 45, 85, 85, 90), (5, 55, 95, 95, 100)]


def test_phase_plan_105_drops_sixth_pass(spark):
    r = plan_rows(spark, 105)
    assert r[0] == (0, 0, 47, 47, 52) and r[1] == (1, 16, 58, 58, 63) and r[-1] == (5, 56, 98, 98, 103)
    assert len(r) == 6


def test_whole_days_not_midnights(spark):
    from seqdrift.functions.time import whole_days_between
    df = spark.createDataFrame([(dt.datetime(2024, 1, 15, 23, 59), dt.datetime(2024, 1, 17))],
                               "a timestamp_ntz, b timestamp_ntz")
    assert df.select(whole_days_between(F.col("a"), F.col("b")).alias("d")).first().d == 1


def test_alerts(spark):
    h = spark.createDataFrame([(1, 0.20), (2, 0.19), (3, 0.17), (4, 0.18)], "phase int, accuracy double")
    h = h.withColumn("variant", F.lit("v")).withColumn("k", F.lit(1))
    got = [r.alert for r in degradation_alerts(h, "phase").orderBy("phase").collect()]
    assert got == [False, False, True, False]


@pytest.fixture(scope="module")
def clicks01(spark):
    from seqdrift.sources.adapters import clicks
    return clicks(spark, SF01)


def test_clicks_anchors(clicks01):
    from seqdrift.operators.sessions import session_pairs
    assert clicks01.count() == 10_000
    assert clicks01.select("user_session").distinct().count() == 1_214
    p = session_pairs(clicks01)
    agg = p.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("prev_item") * 1000 + F.col("next_item")).alias("s")).first()
    assert (agg.n, agg.s) == (8_786, 436_653_690)
    c = session_pairs(clicks01, compat=True)
    agg = c.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("prev_item") * 1000 + F.col("next_item")).alias("s")).first()
    assert (agg.n, agg.s) == (7_731, 383_814_806)


def test_vocab_and_split_anchors(clicks01):
    from seqdrift.operators.sampling import split_sessions
    from seqdrift.operators.vocab import fit_vocab
    v = fit_vocab(clicks01, "product_id")
    a = v.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("idx") * F.col("idx") * F.col("item")).alias("s")).first()
    assert (a.n, a.s) == (100, 15_614_529)
    s = split_sessions(clicks01).select("user_session", "is_train").distinct()
    assert s.filter("is_train").count() == 984


def test_phase_accuracy_anchors(clicks01):
    from seqdrift.plans.phases import PhaseProtocol
    acc = PhaseProtocol(clicks01).accuracy(variants=("window",), ks=(1, 10, 50))
    got = {}
    for r in acc.collect():
        got.setdefault(r.phase, {"n": r.n})[r.k] = r.hits
    want = {0: (345, 2, 31, 126), 1: (354, 2, 40, 96), 2: (346, 7, 37, 100), 3: (351, 5, 39, 117),
            4: (341, 5, 45, 107), 5: (345, 1, 34, 98)}
    assert {p: (g["n"], g[1], g[10], g[50]) for p, g in got.items()} == want


def test_daily_schedule_anchors(clicks01):
    from seqdrift.plans.daily import DailyProtocol
    d = DailyProtocol(clicks01)
    dates = [r.test_date for r in d.test_dates().orderBy("test_date").collect()]
    assert dates[0] == dt.datetime(2024, 1, 17) and dates[-1] == dt.datetime(2024, 1, 30) and len(dates) == 14
    ups = [r.test_date.day for r in d.schedule().filter("is_update").orderBy("test_date").collect()]
    assert ups == [19, 22, 25, 28]
    fits = [r.fit_time.strftime("%m-%d %H:%M:%S") for r in d.versions().orderBy("version").collect()]
    assert fits == ["01-15 23:45:22", "01-18 23:55:34", "01-21 23:56:43", "01-24 23:59:12", "01-27 23:51:25"]
    from seqdrift.plans.daily import initial_events
    assert initial_events(clicks01).count() == 4_985


def test_transfer_recurrence(clicks01):
    """C_v = C_{v-1} div 2 + W_v, checked against a driver-side fold on the (small) result."""
    from seqdrift.plans.daily import DailyProtocol
    d = DailyProtocol(clicks01)
    w = {(r.version, r.prev_item, r.next_item): r.cnt for r in d.window_counts().collect()}
    t = {(r.version, r.prev_item, r.next_item): r.cnt for r in d.transfer_counts().collect()}
    versions = sorted({k[0] for k in w} | {k[0] for k in t})
    for key in {k[1:] for k in w}:
        c = 0
        for v in versions:
            c = c // 2 + w.get((v,) + key, 0)
            assert t.get((v,) + key, 0) == c


def test_session_shape_anchors(spark, clicks01):
    """FIXTURES §2: clicks @0.01 — longest 52, 943 sessions with ≥3 events;
    baskets @0.01 — 14,743 sessions, longest 13, 11,494 with ≥3."""
    from seqdrift.sources.adapters import baskets
    c = clicks01.groupBy("user_session").count()
    a = c.agg(F.max("count").alias("mx"), F.count_if(F.col("count") >= 3).alias("n3")).first()
    assert (a.mx, a.n3) == (52, 943)
    b = baskets(spark, SF01).groupBy("user_session").count()
    a = b.agg(F.count(F.lit(1)).alias("n"), F.max("count").alias("mx"),
              F.count_if(F.col("count") >= 3).alias("n3")).first()
    assert (a.n, a.mx, a.n3) == (14_743, 13, 11_494)


def test_exact_sample_is_the_bottom_by_hash(spark):
    from seqdrift.operators.sampling import exact_sample
    import hashlib
    rows = list(range(500))
    df = spark.createDataFrame([(i,) for i in rows], "event_id bigint")
    order = sorted(rows, key=lambda i: hashlib.md5(f"s{i}".encode()).hexdigest())
    for n, hexes in ((0, 4), (7, 1), (123, 1), (123, 4), (500, 2), (900, 2)):
        got = {r.event_id for r in exact_sample(df, n, "s", block_hex=hexes).collect()}
        assert got == set(order[:n])
    assert exact_sample(df.limit(0), 5, "s").count() == 0


def test_phases_without_test_pairs_keep_their_rows(spark):
    from pyspark.sql import functions as F
    from seqdrift.plans.phases import PhaseProtocol
    log = spark.range(100).select(
        F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, id)").alias("event_time"),
        F.col("id").alias("user_id"), (F.col("id") % 5).alias("product_id"), F.col("id").cast("string").alias("user_session"))
    got = PhaseProtocol(log).accuracy(variants=("window", "static"), ks=(1,)).collect()
    assert len(got) == 12 and all(r.n == 0 and r.hits == 0 and r.accuracy is None for r in got)
