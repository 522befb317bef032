"""M5 on the state store: histories in event-time order, each row written once, for arrivals in any order.

Per session the store keeps the events that the watermark hasn't passed yet, packed (one entry per batch
that brought some, at most ``PIECE`` events each), and the tail: events seen and the last L items. A timer at the
first of them fires when nothing earlier can come any more; all events that the watermark has passed then extend
the tail in order and give their rows, and a timer at the first one left follows. A last timer, the session gap
after the last event, drops the tail.

A call to the store or a timer costs the same for one event or thousands, so sessions share buckets by hash, each
with one list of waiting events, one table of tails and one next timer (``BucketHistoryProcessor``): calls are per
bucket, batch and timer. Arriving events are appended and write what they are; a bucket whose timer fires writes
what is left in it. With the RocksDB provider and changelog checkpoints a batch so writes its events and the fired
buckets, not the open state. Without buckets (``HistoryProcessor``) calls are per session, batch and timer, and
a batch writes the entries of its own sessions and fired timers only.

An event that repeats (same time and id) is one entry; one later than the watermark is dropped, as in
every event-time operator.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.time import MICROS_PER_SECOND, epoch_micros
from ..schema import EVENT_ID, EVENT_TIME, ITEM, SESSION
from .jobs import BUCKETS, HISTORY_STATE, session_bucket
from .staging import batch_time, stream_time

OUTPUT = "user_session string, row_num bigint, event_id bigint, history string"

#: The store that timers and map state need, writing each batch's changes instead of snapshots.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


#: Events of one packed entry.
PIECE = 4096


class HistoryProcessor(StatefulProcessor):
    """Rows (user_session, row_num, event_id, history): the last ``length`` items up to each event."""

    def __init__(self, length: int, gap_ms: int):
        self.length, self.gap_ms = length, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "events binary")
        self.tail = handle.getValueState("tail", "seen bigint, items string, last_ms bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, piece = None, []
        for row in rows:
            first = row["micros"] if first is None else min(first, row["micros"])
            piece.append((row["micros"], row[EVENT_ID], row[ITEM]))
            if len(piece) == PIECE:
                self.waiting.appendValue(pack(piece))
                piece = []
        if piece:
            self.waiting.appendValue(pack(piece))
        if first is not None:
            self.handle.registerTimer(due_ms(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        # of events that repeat the last one counts
        entries = {(micros, event_id): item for (data,) in self.waiting.get() for micros, event_id, item in unpack(data)}
        held = sorted(k for k in entries if due_ms(k[0]) <= now)
        seen, items, last = self.tail.get() or (0, "", None)
        if not held:
            if last is not None and last + self.gap_ms <= now and not entries:
                self.tail.clear()
            return
        past = items.split(",") if items else []
        for micros, event_id in held:
            seen += 1
            past = (past + [str(entries[micros, event_id])])[-self.length:]
            yield Row(user_session=key[0], row_num=seen, event_id=event_id, history=",".join(past))
        left = sorted((*k, v) for k, v in entries.items() if due_ms(k[0]) > now)
        if left:
            self.waiting.put([pack(left[i:i + PIECE]) for i in range(0, len(left), PIECE)])
            self.handle.registerTimer(due_ms(left[0][0]))
        else:
            self.waiting.clear()
        last = due_ms(held[-1][0])
        if left or last + self.gap_ms > now:
            self.tail.update((seen, ",".join(past), last))
            self.handle.registerTimer(last + self.gap_ms)
        elif items:
            self.tail.clear()

    def close(self) -> None:
        pass


def pack(events: list[tuple[int, int, int]]) -> tuple[bytes]:
    return (np.array(events, "<i8").tobytes(),)


def unpack(data: bytes) -> list[list[int]]:
    return np.frombuffer(data, "<i8").reshape(-1, 3).tolist()


def due_ms(micros: int) -> int:
    """First millisecond that is not before the event."""
    return -(-int(micros) // 1000)


#: A packed entry of several sessions: Arrow's bytes without the schema.
WAITING = pa.schema([(SESSION, pa.string()), ("micros", pa.int64()), (EVENT_ID, pa.int64()), (ITEM, pa.int64())])


class BucketHistoryProcessor(StatefulProcessor):
    """The rows of ``HistoryProcessor`` for the sessions of a bucket."""

    def __init__(self, length: int, gap_ms: int):
        self.length, self.gap_ms = length, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "events binary")
        self.tails = handle.getValueState("tails", HISTORY_STATE)
        self.released = set()  # buckets of this task's batch whose timer has fired

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            # a null is an error here: an event without time or id has no place and no identity
            events = {c: frame[c].astype("int64") for c in ("micros", EVENT_ID, ITEM)}
            least = int(events["micros"].min())
            first = least if first is None else min(first, least)
            events = pa.table([pa.array(frame[SESSION], pa.string()), *map(pa.array, events.values())], schema=WAITING)
            self.waiting.appendList(pack_sessions(events))
        if first is not None:
            self.handle.registerTimer(due_ms(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if key[0] in self.released:
            return
        self.released.add(key[0])
        now = timerValues.getCurrentWatermarkInMs()
        pieces = [pa.ipc.read_record_batch(pa.py_buffer(data), WAITING) for (data,) in self.waiting.get()]
        events = pa.Table.from_batches(pieces, WAITING)
        due = events["micros"].to_numpy() <= now * 1000
        left = events.filter(pa.array(~due))
        # of events that repeat the last one counts
        entries = {(micros, event_id, session): item
                   for session, micros, event_id, item in zip(*[c.to_pylist() for c in events.filter(pa.array(due)).itercolumns()])}
        stored = self.tails.get()
        tails = {session: (seen, last, items.split(",")) for session, seen, last, items in zip(*stored)} if stored else {}
        rows = []
        for micros, event_id, session in sorted(entries, key=itemgetter(0, 1)):
            seen, last, past = tails.get(session) or (0, None, [])
            past = (past + [str(entries[micros, event_id, session])])[-self.length:]
            last = due_ms(micros) if last is None else max(last, due_ms(micros))
            tails[session] = seen + 1, last, past
            rows.append((session, seen + 1, event_id, ",".join(past)))
        waiting = set(left[SESSION].unique().to_pylist())
        tails = {session: tail for session, tail in tails.items() if session in waiting or tail[1] + self.gap_ms > now}
        if rows and left.num_rows:
            self.waiting.put(pack_sessions(left))
        elif rows:
            self.waiting.clear()
        if tails:
            seen, last, past = zip(*tails.values())
            self.tails.update((list(tails), list(seen), list(last), [",".join(p) for p in past]))
        elif stored:
            self.tails.clear()
        after = [at for _, last, _ in tails.values() if (at := last + self.gap_ms) > now]
        if left.num_rows:
            after.append(due_ms(left["micros"].to_numpy().min()))
        if after:
            self.handle.registerTimer(min(after))
        if rows:
            yield pd.DataFrame(rows, columns=["user_session", "row_num", "event_id", "history"])

    def close(self) -> None:
        pass


def pack_sessions(events: pa.Table) -> list[tuple[bytes]]:
    return [(piece.serialize().to_pybytes(),) for piece in events.combine_chunks().to_batches(PIECE)]


def history_state_stream(src: DataFrame, length: int = 10, gap_seconds: int = 86_400, watermark: str = "1 day",
                         buckets: int | None = BUCKETS) -> DataFrame:
    """M5: histories per event as an append stream; ``watermark`` is the lateness to wait for.

    buckets: part of the state's layout; choose some hundred open sessions for each. None keeps every session for
    itself, for streams that release little of a large open state in each batch.
    """
    s = batch_time(src).withColumn("micros", epoch_micros(EVENT_TIME))
    s = stream_time(s).withWatermark(EVENT_TIME, watermark).select(SESSION, EVENT_ID, EVENT_TIME, "micros", ITEM)
    gap_ms, how = gap_seconds * MICROS_PER_SECOND // 1000, {"outputStructType": OUTPUT, "outputMode": "Append", "timeMode": "EventTime"}
    if buckets is None:
        return s.groupBy(SESSION).transformWithState(HistoryProcessor(length, gap_ms), **how)
    return s.withColumn("bucket", session_bucket(buckets)).groupBy("bucket") \
        .transformWithStateInPandas(BucketHistoryProcessor(length, gap_ms), **how)


@contextmanager
def state_store(spark):
    """The session's state store settings while stateful queries start and run."""
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


__all__ = ["HistoryProcessor", "BucketHistoryProcessor", "history_state_stream", "state_store", "STATE_STORE"]
