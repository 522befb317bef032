"""M5 by buckets: sessions share groups of the state, rows stay those of single sessions."""

import datetime as dt
import random

from pyspark.sql import functions as F

from seqdrift.config import scratch_path
from seqdrift.schema import EVENT_SCHEMA
from seqdrift.streaming.staging import read_stream

DAY = dt.datetime(2024, 1, 1)


def _stage(spark, batches):
    import time
    folder = scratch_path(spark, "t-in")
    for rows in batches:
        spark.createDataFrame(rows, EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    return folder


def _run(spark, sdf):
    """(rows, progress of the batches with their stateful operator)."""
    out = scratch_path(spark, "t-out")
    q = sdf.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "t-ckpt")) \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(sdf.schema).parquet(out).collect(), [p["stateOperators"][0] for p in q.recentProgress]


def test_history_groups_do_not_grow_with_sessions(spark):
    """5,000 sessions in two batches: at most BUCKETS entries of the state, right rows."""
    from seqdrift.streaming.jobs import BUCKETS, history_stream
    n = 5000
    rows = [(i, DAY + dt.timedelta(seconds=i), 1, i % 7, f"s{i % n}") for i in range(2 * n)]
    got, state = _run(spark, history_stream(read_stream(spark, _stage(spark, [rows[:n], rows[n:]]), 1), length=2))
    assert sorted((r.user_session, r.row_num, r.history) for r in got) == sorted(
        (s, i // n + 1, f"{item}" if i < n else f"{(i - n) % 7},{item}") for i, _, _, item, s in rows)
    assert 0 < max(s["numRowsUpdated"] for s in state) <= BUCKETS and max(s["numRowsTotal"] for s in state) <= BUCKETS


def test_history_sessions_of_a_bucket_expire_alone(spark):
    """In one bucket each session keeps its tail while it is open and loses it once the watermark passes last event + gap."""
    from seqdrift.streaming.jobs import history_stream
    rng = random.Random(3)
    names = [None, "", "a", "b", "c", "d"]
    ids, batches = iter(range(10_000)), []
    for b in range(5):  # a batch has two days; sessions rest for whole batches
        batches.append([(next(ids), DAY + dt.timedelta(days=2 * b, seconds=rng.randrange(172_800)), 1, rng.randrange(50), s)
                        for s in names if rng.random() < 0.5 or s == "d" for _ in range(rng.randrange(1, 4))])
    batches.append([(next(ids), DAY + dt.timedelta(days=40), 1, 9, "end")])
    want, tails, watermark, late = [], {}, 0, 0
    for rows in batches:  # the plan of the stream, by hand: rows before the last batch's watermark are late
        for i, t, _, item, s in sorted(rows, key=lambda r: (r[1], r[0])):
            if (t - dt.datetime(1970, 1, 1)).total_seconds() * 1000 > late:
                seen, _, items = tails.get(s, (0, 0, []))
                items = (items + [str(item)])[-3:]
                tails[s] = seen + 1, (t - dt.datetime(1970, 1, 1)).total_seconds() * 1000, items
                want.append((s, seen + 1, ",".join(items)))
        tails = {s: x for s, x in tails.items() if x[1] + 86_400_000 >= watermark}
        late, newest = watermark, max((r[1] for r in rows))
        watermark = max(watermark, (newest - dt.datetime(1970, 1, 1)).total_seconds() * 1000 - 86_400_000)
    key = lambda r: (r[0] is None, r[0] or "", *r[1:])
    for buckets in (1, 3):
        got, state = _run(spark, history_stream(read_stream(spark, _stage(spark, batches), 1), length=3, buckets=buckets))
        assert sorted(((r.user_session, r.row_num, r.history) for r in got), key=key) == sorted(want, key=key)
        assert state[-1]["numRowsTotal"] <= 1  # all but the last event's session are closed


# -- on the state store ------------------------------------------------------------------------------------

class _Store:
    """One key's list and value state and timers in memory; counts the calls."""

    def __init__(self):
        self.list, self.value, self.timers, self.calls = [], None, set(), 0

    def getListState(self, name, schema):
        return type("L", (), {"get": lambda s: iter(list(self.list)), "appendValue": lambda s, v: self._do(self.list.append, v),
                              "appendList": lambda s, v: self._do(self.list.extend, v),
                              "put": lambda s, v: self._do(self.list.__setitem__, slice(None), v), "clear": lambda s: self._do(self.list.clear)})()

    def getValueState(self, name, schema):
        return type("V", (), {"get": lambda s: self.value, "update": lambda s, v: self._do(setattr, self, "value", v),
                              "clear": lambda s: self._do(setattr, self, "value", None)})()

    def registerTimer(self, at):
        self._do(self.timers.add, at)

    def _do(self, f, *args):
        self.calls += 1
        f(*args)


def _batch(processor, store, key, rows, watermark):
    """What one micro-batch gives for a key: its rows first, then the timers that are due."""
    from types import SimpleNamespace
    processor.init(store)  # as for each task
    if rows:
        list(processor.handleInputRows((key,), iter(rows), None))
    out = []
    for at in sorted(t for t in store.timers if t <= watermark):
        out += processor.handleExpiredTimer((key,), SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark), None)
        store.timers.remove(at)
    return out


def test_bucket_processor_gives_the_rows_of_single_sessions():
    """Random arrivals, repeats, rests and watermarks: batch by batch the rows of one processor per session; few calls."""
    import pandas as pd
    from seqdrift.streaming.histories import BucketHistoryProcessor, HistoryProcessor
    for seed in range(40):
        rng = random.Random(seed)
        names = [None, "", *(f"s{i}" for i in range(60))]
        gap = rng.choice([1, 500, 4000])
        bucket, store = BucketHistoryProcessor(3, gap), _Store()
        single, stores = HistoryProcessor(3, gap), {s: _Store() for s in names}
        watermark, sent = 0, []
        for b in range(12):
            calls = store.calls
            rows = [(s, rng.randrange(watermark * 1000 + 1, watermark * 1000 + 3_000_000), rng.randrange(1000), rng.randrange(9))
                    for s in rng.sample(names, rng.randrange(0, 40)) for _ in range(rng.randrange(1, 6))]
            rows += [(*r[:3], rng.randrange(9)) for r in rng.sample(sent, min(len(sent), 5)) if r[1] > watermark * 1000]  # repeats
            sent += rows
            watermark += rng.choice([0, 1, 700, 2000, 9000])
            frames = [pd.DataFrame(rows[i:i + 50], columns=["user_session", "micros", "event_id", "product_id"]) for i in range(0, len(rows), 50)]
            got = [tuple(r) for f in _batch(bucket, store, 7, frames, watermark) for r in f.itertuples(index=False)]
            want = [(r.user_session, r.row_num, r.event_id, r.history) for s in names for r in _batch(
                single, stores[s], s, [dict(zip(("micros", "event_id", "product_id"), r[1:])) for r in rows if r[0] == s], watermark)]
            assert sorted(got, key=str) == sorted(want, key=str)
            assert store.calls - calls <= len(frames) + 4 and (store.value is None) == all(x.value is None for x in stores.values())
        watermark += 100_000
        _batch(bucket, store, 7, [], watermark)
        _batch(bucket, store, 7, [], watermark + gap)
        assert not store.list and store.value is None and not store.timers


def test_history_state_calls_do_not_grow_with_sessions(spark):
    """5,000 sessions in hash order: at most BUCKETS timers a batch; rows as without buckets, in several releases."""
    from seqdrift.streaming.histories import history_state_stream, state_store
    from seqdrift.streaming.jobs import BUCKETS
    n = 5000
    rows = [(i, DAY + dt.timedelta(seconds=60 * (i % 3000)), 1, i % 7, f"s{i % n}") for i in range(2 * n)]
    random.Random(2).shuffle(rows)
    end = [(-1 - i, DAY + dt.timedelta(days=d), 1, 9, f"end{i}") for i, d in enumerate((2, 9))]
    folder = _stage(spark, [rows[:n], rows[n:], end[:1], end[1:]])
    with state_store(spark):
        got, state = _run(spark, history_state_stream(read_stream(spark, folder, 1), length=2, watermark="3 days"))
    own = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        own.setdefault(r[4], []).append(r)
    assert sorted(tuple(r) for r in got if not r.user_session.startswith("end")) == sorted(
        (s, i + 1, r[0], ",".join(str(x[3]) for x in e[max(0, i - 1):i + 1])) for s, e in own.items() for i, r in enumerate(e))
    assert 0 < max(s["customMetrics"]["numRegisteredTimers"] for s in state) <= BUCKETS


def test_history_state_without_buckets_is_the_same(spark):
    from seqdrift.streaming.histories import history_state_stream, state_store
    rng = random.Random(5)
    rows = [(i, DAY + dt.timedelta(hours=rng.randrange(200)), 1, rng.randrange(50), f"s{i % 9}") for i in range(300)]
    rows = [r for b in range(4) for r in sorted(rows[75 * b:75 * b + 75], key=lambda r: r[1])]
    folder = _stage(spark, [rows[:100], rows[100:200] + rows[50:60], rows[200:], [(-1, DAY + dt.timedelta(days=99), 1, 9, "end")]])
    got = []
    for buckets in (None, 1, 4):
        with state_store(spark):
            out, _ = _run(spark, history_state_stream(read_stream(spark, folder, 1), length=3, watermark="4 days", buckets=buckets))
        got.append(sorted(map(tuple, out)))
    assert got[0] == got[1] == got[2] and len(got[0]) > 100
