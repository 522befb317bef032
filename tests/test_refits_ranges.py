"""Range positions, streamed refits, state-store histories, exactly-once metrics, reservoir rows, sketches."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import Window, functions as F

from seqdrift.config import local_path, scratch_path
from seqdrift.operators.ranges import BLOCK, range_blocks, range_index
from seqdrift.schema import EVENT_SCHEMA

from conftest import LOG, SF001


# -- positions with bounds from the data --------------------------------------------------------------

def test_range_index_equals_window(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, *range(9)]), i, "x") for i in range(700)]
    df = spark.createDataFrame(rows, "k int, t int, id int, pos string").drop("pos").repartition(5)
    got = range_index(df, ["k", "t", "id"], ["k"], "pos", "start", "size")
    w = Window.partitionBy("k").orderBy("t", "id")
    want = df.withColumn("want", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("k")))
    j = got.join(want, "id").where("pos != want or size != n")
    assert j.isEmpty() and got.count() == 700
    starts = {r["k"]: r["start"] for r in got.collect()}
    assert [starts[k] for k in (None, 1, 2, 3)] == sorted(starts.values()) and starts[None] == 0
    flat = range_index(df, [F.col("t").desc(), "id"])
    assert flat.withColumn("w", F.row_number().over(Window.orderBy(F.col("t").desc(), "id")) - 1).where("pos != w").isEmpty()
    assert range_index(df.limit(0), ["t"], ["k"]).count() == 0


@pytest.mark.parametrize("kind", ["date_only", "one_hour", "one_prefix"])
def test_range_blocks_follow_the_data(spark, kind):
    """Date-only times, one long hour and ids with one prefix: no block is over twice the mean."""
    n = spark.range(40_000).withColumn("h", F.xxhash64("id"))
    key = {"date_only": [F.expr("make_date(2024, 1, 1 + cast(pmod(h, 3) as int))").alias("a"), "id"],
           "one_hour": [F.lit(0).alias("a"), "id"],
           "one_prefix": [F.lit(-1).alias("a"), F.concat(F.lit("item-0000"), F.hex("h")).alias("id")]}[kind]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks = [r["count"] for r in range_blocks(n.select(*key), ["a", "id"]).groupBy(BLOCK).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(blocks) == 4 and max(blocks) <= 2 * sum(blocks) / len(blocks)


# -- M7: versions ---------------------------------------------------------------------------------------

CUTOFF = dt.datetime(2024, 1, 5)


def _log(spark, rows):
    return spark.createDataFrame(rows, EVENT_SCHEMA)


def _events(seed=5, days=16):
    rng = random.Random(seed)
    out = []
    for i in range(900):
        t = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(days * 86_400))
        out.append((i, t, 1, rng.randrange(6), f"s{t.day // 2}-{rng.randrange(9)}"))
    # a quiet day, on which no version may be due, and one event in it that comes last
    return [r for r in out if r[1].day != 8] + [(5000, dt.datetime(2024, 1, 8, 13), 1, 3, "s4-1")]


def _want(spark, rows):
    from seqdrift.streaming.refits import StreamCalendar
    from seqdrift.plans.daily import day_key
    log = _log(spark, rows)
    days = log.groupBy(day_key("event_time").alias("_key")).agg(F.max("event_time").alias("_mt"))
    p = StreamCalendar(days, CUTOFF, 3, 2)
    p.__dict__["events"] = log
    return _rows(p.versions()), _rows(p.window_counts())


def _rows(df):
    cols = [c for c in ("version", "fit_date", "fit_time", "lo", "hi", "prev_item", "next_item", "cnt") if c in df.columns]
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_refits_equal_batch_after_every_commit(spark, monkeypatch):
    """Time order, then late rows that move a fit, a batch that fails half-way, redelivery, a new driver."""
    from seqdrift.streaming import refits
    from seqdrift.streaming.refits import RefitStream
    rows = sorted(_events(), key=lambda r: r[1])
    late = [r for i, r in enumerate(rows) if r[0] == 5000 or i % 11 == 0]
    early = [r for r in rows if r not in late]
    parts = [early[:300], early[300:700], early[700:], late]
    m = RefitStream(spark, CUTOFF, window_days=3, every_days=2)
    with pytest.raises(ValueError):
        m.versions()
    for b, part in enumerate(parts):
        if b == 2:  # fails before its commit: readers still see batch 1
            with monkeypatch.context() as patch:
                patch.setattr(refits, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
                with pytest.raises(RuntimeError):
                    m(_log(spark, part), b)
            assert (_rows(m.versions()), _rows(m.counts())) == seen
            m = RefitStream(spark, CUTOFF, window_days=3, every_days=2, root=m.root)
        m(_log(spark, part), b)
        seen = _want(spark, sum(parts[:b + 1], []))
        assert (_rows(m.versions()), _rows(m.counts())) == seen
    m(_log(spark, parts[3]), 3)
    assert (_rows(m.versions()), _rows(m.counts())) == seen and len(seen[0]) >= 5
    newest = max(v[0] for v in seen[0])
    assert sorted(map(tuple, m.model().select("prev_item", "next_item", "cnt").collect())) == [r[1:] for r in seen[1] if r[0] == newest]


def test_refits_before_the_cutoff_and_pruning(spark):
    from seqdrift.streaming.refits import RefitStream, inside
    rows = sorted(_events(), key=lambda r: r[1])
    m = RefitStream(spark, CUTOFF, window_days=3, every_days=2)
    m(_log(spark, [r for r in rows if r[1] < dt.datetime(2024, 1, 3)]), 0)
    assert m.versions().count() == 0 and m.counts().count() == 0
    m(_log(spark, [r for r in rows if r[1] >= dt.datetime(2024, 1, 3)]), 1)
    assert (_rows(m.versions()), _rows(m.counts())) == _want(spark, rows)
    # a refit reads the folders of the days it adds or drops, not the log
    plan = inside(m._changes([0, 1]), dt.datetime(2024, 1, 9, 5), dt.datetime(2024, 1, 12), after=dt.datetime(2024, 1, 10))
    text = plan._jdf.queryExecution().executedPlan().toString()
    kept = text[text.index("PartitionFilters"):].split("PushedFilters")[0]
    assert "next_day" in kept and "prev_day" in kept
    assert all(f"next_day=2024-01-{d:02d}" in " ".join(m._changes([0, 1]).inputFiles()) for d in (2, 10))


# -- M5: state store -------------------------------------------------------------------------------------

def _stage(spark, batches):
    import time
    folder = scratch_path(spark, "t-in")
    for rows in batches:
        _log(spark, rows).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    return folder


def test_history_state_in_any_order(spark):
    from seqdrift.streaming.histories import history_state_stream, state_store
    from seqdrift.streaming.staging import read_stream, run_to_parquet
    rows = LOG[:]
    random.Random(1).shuffle(rows)
    end = (99, dt.datetime(2030, 1, 1), 9, 9, "end")
    folder = _stage(spark, [rows[:4], rows[4:] + rows[:1], [end]])  # one row is sent twice
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with state_store(spark):
        out = run_to_parquet(history_state_stream(read_stream(spark, folder, 1), length=2, watermark="2 days"), "t-state")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    got = sorted((r.user_session, r.row_num, r.event_id, r.history) for r in out.collect())
    want = []
    for s in {r[4] for r in LOG}:
        own = sorted((r for r in LOG if r[4] == s), key=lambda r: (r[1], r[0]))
        want += [(s, i + 1, r[0], ",".join(str(x[3]) for x in own[max(0, i - 1):i + 1])) for i, r in enumerate(own)]
    assert got == sorted(want)


def test_history_state_writes_follow_the_batch(spark):
    """After a large batch a small one writes its own changes, not the open state."""
    from seqdrift.streaming.histories import history_state_stream, state_store
    from seqdrift.streaming.staging import read_stream
    t = dt.datetime(2024, 1, 1)
    large = [(i, t + dt.timedelta(seconds=i % 3000), 1, i % 50, f"s{i % 400}") for i in range(20_000)]
    small = [(30_000 + i, t + dt.timedelta(seconds=3000), 1, 7, "s1") for i in range(3)]
    folder = _stage(spark, [large, small])
    ckpt, out = scratch_path(spark, "t-ckpt"), scratch_path(spark, "t-out")
    with state_store(spark):
        q = history_state_stream(read_stream(spark, folder, 1), watermark="30 days").writeStream.format("parquet") \
            .option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
        q.awaitTermination()
    size = {}
    for a, _, files in os.walk(local_path(ckpt) + "/state"):
        for f in files:
            if f.endswith(".changelog"):
                size[f.split(".")[0]] = size.get(f.split(".")[0], 0) + os.path.getsize(f"{a}/{f}")
    first, second = (size[v] for v in sorted(size, key=int)[:2])
    assert second * 20 < first


# -- A5, L11, M8, L10 -------------------------------------------------------------------------------------

def test_metrics_stream_alerts_and_half_batches(spark):
    from seqdrift.streaming.commits import MetricsStream, committed
    root = scratch_path(spark, "t-metrics")

    def measure(batch):
        return batch.select(F.lit(5).alias("k"), (F.col("x") / 100).alias("accuracy"))

    m = MetricsStream(spark, measure, "r", root)
    assert m.result() is None and m.alerts() is None
    for b, x in ((0, 50), (1, 49), (1, 49), (2, 30)):
        m(spark.createDataFrame([(x,)], "x int"), b)
    # written but never committed: no reader sees it
    measure(spark.createDataFrame([(1,)], "x int")).write.parquet(f"{m.root}/metrics/batch_id=3")
    m = MetricsStream(spark, measure, "r", root)
    assert committed(spark, m.root) == [0, 1, 2] and committed(spark, m.root, before=2) == [0, 1]
    assert [(r.batch_id, r.alert) for r in m.alerts().orderBy("batch_id").collect()] == [(0, False), (1, False), (2, True)]
    assert m.result().count() == 3


def test_reservoir_keeps_rows_whatever_the_batches(spark):
    from seqdrift.sources.adapters import baskets
    from seqdrift.streaming.jobs import ReplayReservoir
    ev = baskets(spark, SF001)
    got = []
    for n in (2, 5):
        r = ReplayReservoir(spark, n=120, seed="x", key=("user_session", "event_id"))
        part = F.pmod(F.xxhash64("user_session", "event_id", F.lit(n)), F.lit(n))
        for b in range(n):
            r(ev.where(part == b), b)
        got.append(sorted(map(tuple, r.sample().collect())))
    assert got[0] == got[1] and len(got[0]) == 120
    assert set(got[0]) <= set(map(tuple, ev.select("event_id", "event_time", "user_id", "product_id", "user_session").collect()))


def test_sketches_of_many_ids(spark):
    """Beyond the sketch's exact range the estimates stay within three standard errors in every phase."""
    from seqdrift.plans.phases import PhaseProtocol
    n = spark.range(60_000)
    ev = n.select(F.col("id").alias("event_id"), F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id)").alias("event_time"),
                  F.lit(1).cast("bigint").alias("user_id"), F.pmod(F.xxhash64("id"), F.lit(40_000)).alias("product_id"),
                  F.concat(F.lit("s"), F.expr("id div 2")).alias("user_session"))
    p = PhaseProtocol(ev)
    exact = {r["phase"]: r for r in p.train_stats().collect()}
    got = {r["phase"]: r for r in p.train_stats_sketch().collect()}
    assert set(exact) == set(got) and max(r["n_items"] for r in exact.values()) > 8000
    for k, e in exact.items():
        assert got[k]["n_rows"] == e["n_rows"]
        for c in ("n_items", "n_sessions"):
            assert abs(got[k][c] - e[c]) <= 0.024 * e[c]


class _Store:
    """One key's list and value state and timers in memory; counts the calls."""

    def __init__(self):
        self.list, self.value, self.timers, self.calls = [], None, set(), 0

    def getListState(self, name, schema):
        return type("L", (), {"get": lambda s: iter(list(self.list)), "appendValue": lambda s, v: self._do(self.list.append, v),
                              "put": lambda s, v: self._do(self.list.__setitem__, slice(None), v), "clear": lambda s: self._do(self.list.clear)})()

    def getValueState(self, name, schema):
        return type("V", (), {"get": lambda s: self.value, "update": lambda s, v: self._do(setattr, self, "value", v),
                              "clear": lambda s: self._do(setattr, self, "value", None)})()

    def registerTimer(self, at):
        self._do(self.timers.add, at)

    def _do(self, f, *args):
        self.calls += 1
        f(*args)


def test_history_state_calls_do_not_grow_with_events():
    """A session of 10,000 events in three batches: a few packed entries and timers; rows in order, in two releases."""
    from types import SimpleNamespace

    from seqdrift.streaming.histories import PIECE, HistoryProcessor
    store, p = _Store(), HistoryProcessor(length=3, gap_ms=1000)
    p.init(store)
    rows = [{"micros": i * 1000, "event_id": 7 * i, "product_id": i % 10} for i in range(10_000)]
    for b in range(3):
        list(p.handleInputRows(("s",), iter(rows[b::3] + rows[:2]), None))
    assert store.calls <= 6 + 3 * len(rows) / PIECE and len(store.timers) <= 3
    got = []
    for now in (4999, 5000, 100_000):
        while due := sorted(t for t in store.timers if t <= now):
            got += p.handleExpiredTimer(("s",), SimpleNamespace(getCurrentWatermarkInMs=lambda: now), None)
            store.timers.remove(due[0])
        assert len(got) == min(now + 1, len(rows))
    assert [(r.row_num, r.event_id) for r in got] == [(i + 1, 7 * i) for i in range(len(rows))]
    assert got[-1].history == "7,8,9" and not store.list and store.value is None and store.calls < 40


def _counted(df):
    """``df`` and the number of its rows that were computed so far, repeats included."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), seen


def test_update_model_computes_its_slice_once(spark):
    from seqdrift.api import ContinualNextItemPredictor
    from seqdrift.sources.adapters import baskets
    log = baskets(spark, SF001)
    n = log.count()
    ev, seen = _counted(log)
    p = ContinualNextItemPredictor(window_size_days=100_000)
    p.update_model(ev, log.limit(50))
    assert seen.value == n and p.model.count() > 0


@pytest.mark.parametrize("name", ["stream_model_refresh_redelivered", "stream_refit_versions"])
def test_dealt_log_is_computed_once(spark, monkeypatch, name):
    from seqdrift import catalog
    ev, seen = _counted(catalog.clicks(spark, SF001))
    monkeypatch.setattr(catalog, "clicks", lambda s, d: ev)
    assert catalog.QUERIES[name](spark, SF001).count() > 0
    once = seen.value
    assert ev.count() + once == seen.value and once <= 2 * (seen.value - once)  # the cutoff of the refits reads it once more
