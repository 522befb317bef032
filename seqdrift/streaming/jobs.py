"""Structured Streaming operators (M1–M8).

The reference simulates continuous operation with a loop over slices; here the
same work runs as streaming queries over file batches. Every operator keeps
bounded state per key (a window's count, a session's summary, the last L items,
a session's last event, a bottom-n reservoir) — never a whole group.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import discard, materialize, scratch_path
from ..operators.sampling import distinct_head, exact_sample
from ..operators.sessions import session_pairs
from ..operators.transitions import transition_model
from ..schema import EVENT_ID, EVENT_TIME, ITEM, SESSION, USER
from .staging import has_files, stream_time

WATERMARK = "1 day"


# -- M1 / M2 ---------------------------------------------------------------------
def events_stream(src: DataFrame) -> DataFrame:
    """M1: the event stream itself (schema given, no inference)."""
    return src


def dedup_stream(src: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """M2: events older than the watermark are dropped; repeats of an event_id within
    it are removed (state per id expires with the watermark)."""
    s = stream_time(src).withWatermark(EVENT_TIME, watermark)
    return s.dropDuplicatesWithinWatermark([EVENT_ID])


# -- M3 ------------------------------------------------------------------------------
def windowed_popularity(events: DataFrame, length: str = "3 days", slide: str = "1 day") -> DataFrame:
    """M3 (batch): item counts per sliding event-time window."""
    w = F.window(F.col(EVENT_TIME).cast("timestamp"), length, slide)
    g = events.groupBy(w.alias("w"), F.col(ITEM).alias("item")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), "item", "n")


def popularity_stream(src: DataFrame, length: str = "3 days", slide: str = "1 day",
                      watermark: str = WATERMARK) -> DataFrame:
    """M3 (stream): the same counts, emitted once per window when the watermark passes it."""
    s = stream_time(src).withWatermark(EVENT_TIME, watermark)
    g = s.groupBy(F.window(EVENT_TIME, length, slide).alias("w"), F.col(ITEM).alias("item")) \
        .agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "item", "n")


# -- M4 ------------------------------------------------------------------------------
def session_stream(src: DataFrame, gap: str = "1 day", watermark: str = WATERMARK) -> DataFrame:
    """M4: inactivity sessions per user as session windows; bounded summary per session."""
    s = stream_time(src).withWatermark(EVENT_TIME, watermark)
    g = s.groupBy(F.col(USER), F.session_window(EVENT_TIME, gap).alias("sw")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_events"),
        F.min_by(ITEM, F.struct(EVENT_TIME, EVENT_ID)).alias("first_item"),
        F.max_by(ITEM, F.struct(EVENT_TIME, EVENT_ID)).alias("last_item"))
    return g.select(USER, F.col("sw.start").alias("session_start"), F.col("sw.end").alias("session_end"),
                    "n_events", "first_item", "last_item")


# -- M5 ------------------------------------------------------------------------------
HISTORY_SCHEMA = "user_session string, row_num bigint, history string"
HISTORY_STATE = "sessions array<string>, seen array<bigint>, last_ms array<bigint>, items array<string>"

#: Groups that the sessions are dealt to by hash. Part of the state's layout: it stays as it is as long as a checkpoint is used.
BUCKETS = 2048


def session_bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(SESSION), F.lit(buckets)).cast("int")


def history_stream(src: DataFrame, length: int = 10, gap_seconds: int = 86_400,
                   watermark: str = WATERMARK, buckets: int = BUCKETS) -> DataFrame:
    """M5: per session, the last ``length`` items after each event (text, oldest first).

    State per session = event count + last ``length`` items: bounded whatever the
    session size. It expires once the watermark passes the last event + gap.

    A group in Python costs Spark milliseconds, whatever its rows, so the sessions share ``buckets`` groups by hash:
    a batch has at most as many, however many sessions it touches. It reads and writes the tails of all open
    sessions in the buckets it touches; choose ``buckets`` for some hundred open sessions in each.
    """
    # nulls would come as floats, which have no order; as elsewhere they are first
    first = F.lit(-1 << 63)
    s = stream_time(src).withWatermark(EVENT_TIME, watermark).select(
        session_bucket(buckets).alias("bucket"), SESSION, EVENT_TIME,
        F.coalesce(F.unix_micros(EVENT_TIME), first).alias("micros"), F.coalesce(EVENT_ID, first).alias(EVENT_ID), ITEM)

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tails = {session: (seen, last_ms, items.split(",")) for session, seen, last_ms, items in zip(*state.get)} \
            if state.exists else {}
        rows = [] if state.hasTimedOut else [
            r for p in pdfs for r in zip(p["micros"].tolist(), p[EVENT_ID].tolist(), p[ITEM].tolist(), p[SESSION].tolist())]
        rows.sort(key=itemgetter(0, 1, 2))
        out = []
        for micros, _, item, session in rows:
            seen, last_ms, items = tails.get(session) or (0, 0, [])
            items = (items + [str(int(item))])[-length:]
            tails[session] = seen + 1, max(last_ms, micros // 1000), items
            out.append((session, seen + 1, ",".join(items)))
        oldest = state.getCurrentWatermarkMs() - gap_seconds * 1000
        tails = {session: tail for session, tail in tails.items() if tail[1] >= oldest}
        if tails:
            seen, last_ms, items = zip(*tails.values())
            state.update((list(tails), list(seen), list(last_ms), [",".join(i) for i in items]))
            state.setTimeoutTimestamp(min(last_ms) + gap_seconds * 1000)
        else:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["user_session", "row_num", "history"])

    return s.groupBy("bucket").applyInPandasWithState(
        step, outputStructType=HISTORY_SCHEMA, stateStructType=HISTORY_STATE, outputMode="append",
        timeoutConf=GroupStateTimeout.EventTimeTimeout)


# -- M6 ------------------------------------------------------------------------------
def recommend_stream(src: DataFrame, recs: DataFrame) -> DataFrame:
    """M6: each incoming event joined to the precomputed top-k list of its item (stream–static
    equi-join; one row of k entries per item). Events of other items get the list of the NULL
    ``prev_item``, if ``recs`` has one."""
    entries = F.array_sort(F.collect_list(F.struct("rank", "item", "score")))
    lists = recs.where(F.col("prev_item").isNotNull()).groupBy(F.col("prev_item").alias(ITEM)).agg(entries.alias("_l"))
    fallback = recs.where(F.col("prev_item").isNull()).agg(entries.alias("_f"))  # one row, empty without a list
    j = src.select(EVENT_ID, ITEM).join(lists, ITEM, "left").crossJoin(F.broadcast(fallback))
    return j.select(EVENT_ID, ITEM, F.explode(F.coalesce("_l", "_f")).alias("_e")).select(EVENT_ID, ITEM, "_e.*")


# -- M4, M5, M7 in any order ----------------------------------------------------------
class OpenSessions:
    """Rows of open sessions, kept between the micro-batches of a ``foreachBatch`` job.

    A batch always starts from the newest state *before its own id* and overwrites its own delta
    and state, so delivering a batch again changes nothing; a driver that starts again with the
    same ``root`` goes on from the stored state.
    """

    #: Columns of ``refresh`` that name folders of its output.
    partition_by: tuple[str, ...] = ()

    def __init__(self, spark, expire_seconds: int | None = None, root: str | None = None):
        """expire_seconds: sessions whose last event is this much older than the newest event seen
        are closed (choose the session gap plus the lateness to allow). None keeps every session."""
        self.spark = spark
        self.expire_seconds = expire_seconds
        self.root = root or scratch_path(spark, "open-sessions")

    def refresh(self, new: DataFrame, stored: DataFrame | None) -> DataFrame:
        """What a batch writes, from its rows and the stored rows of the sessions it touches."""
        raise NotImplementedError

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        cols = [EVENT_ID, EVENT_TIME, USER, ITEM, SESSION]
        ev = batch.withColumn(EVENT_TIME, F.col(EVENT_TIME).cast("timestamp_ntz")).select(*cols)
        before = latest_version(self.spark, f"{self.root}/open", batch_id)
        touched = None
        if before is not None:
            # ``refresh`` reads these rows several times; the search for them runs once
            touched = materialize(before.join(ev.select(SESSION).distinct(), SESSION, "left_semi").select(*cols), "touched")
        self.refresh(ev, touched).write.mode("overwrite").partitionBy(*self.partition_by) \
            .parquet(f"{self.root}/delta/batch_id={batch_id}")
        if touched is not None:
            discard(touched)
        if before is not None:
            ev = ev.unionByName(before.select(*cols))
        if self.expire_seconds is not None:
            newest = ev.agg((F.max(EVENT_TIME) - F.make_dt_interval(secs=F.lit(self.expire_seconds))).alias("_from"))
            live = ev.groupBy(SESSION).agg(F.max(EVENT_TIME).alias("_last")).crossJoin(F.broadcast(newest)) \
                .where("_last >= _from").select(SESSION)
            ev = ev.join(live, SESSION, "left_semi").select(*cols)
        ev.write.mode("overwrite").parquet(f"{self.root}/open/v={batch_id}")


class SessionRefresh(OpenSessions):
    """M4/M5: histories or sequences of sessions whose events come in any order.

    Each batch writes ``build(rows)`` for the sessions it touches, from all their rows so far; a
    session's result is that of the last batch that touched it.
    """

    def __init__(self, spark, build, expire_seconds: int | None = None, root: str | None = None):
        """build(events) -> rows that carry ``user_session``."""
        super().__init__(spark, expire_seconds, root)
        self.build = build

    def refresh(self, new: DataFrame, stored: DataFrame | None) -> DataFrame:
        return self.build(new if stored is None else new.unionByName(stored))

    def result(self) -> DataFrame:
        d = self.spark.read.parquet(f"{self.root}/delta")
        last = d.groupBy(SESSION).agg(F.max("batch_id").alias("batch_id"))
        return d.join(last, [SESSION, "batch_id"]).drop("batch_id")


class ModelRefresh(OpenSessions):
    """M7: transition counts refreshed per micro-batch.

    A batch re-pairs the sessions it touches, stored rows and new ones together, and writes the
    change of their pair counts (new pairs minus the pairs counted before) as ``delta/batch_id=<id>``.
    So events may come in any order: a late event takes back the pair it splits. The model is the
    sum of the deltas.
    """

    def refresh(self, new: DataFrame, stored: DataFrame | None) -> DataFrame:
        if stored is None:
            return transition_model(session_pairs(new))
        old = transition_model(session_pairs(stored)).withColumn("cnt", -F.col("cnt"))
        counts = transition_model(session_pairs(new.unionByName(stored))).unionByName(old)
        return counts.groupBy("prev_item", "next_item").agg(F.sum("cnt").cast("bigint").alias("cnt")).where("cnt != 0")

    def model(self) -> DataFrame:
        d = self.spark.read.parquet(f"{self.root}/delta")
        return d.groupBy("prev_item", "next_item").agg(F.sum("cnt").cast("bigint").alias("cnt")).where("cnt > 0")


def latest_version(spark, path: str, batch_id: int) -> DataFrame | None:
    """The newest version ``v=<id>`` under ``path`` from before ``batch_id``, if any."""
    if not has_files(spark, path):
        return None
    rows = spark.read.parquet(path)
    v = rows.where(F.col("v") < batch_id).agg(F.max("v")).first()[0]
    return None if v is None else spark.read.schema(rows.drop("v").schema).parquet(f"{path}/v={v}")


# -- M8 ------------------------------------------------------------------------------
class ReplayReservoir:
    """M8: bottom-n events by md5(seed || key) over everything seen so far, kept as whole rows.

    Merge = bottom-n of (reservoir ∪ batch): associative and order-independent, so
    the final reservoir equals the batch sample of the whole log (C3). Each version
    is written to the shared folder; a batch starts from the newest version before its
    own id and rewrites its own, so delivering it again changes nothing. The capacity
    ``n`` is the feature. Events are told apart by session and id; one delivered in two batches
    counts once. ``key`` names the columns that are drawn by, joined by a slash: the id alone if ids are
    unique, else (session, id), since equal keys would leave ties open. A model can be trained from
    ``sample()``.
    """

    def __init__(self, spark, n: int, seed: str = "replay", root: str | None = None, key: tuple[str, ...] = (EVENT_ID,)):
        self.spark = spark
        self.key = key
        self.n = n
        self.seed = seed
        self.root = root or scratch_path(spark, "reservoir")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        ev = batch.select(EVENT_ID, F.col(EVENT_TIME).cast("timestamp_ntz").alias(EVENT_TIME), USER, ITEM, SESSION)
        before = latest_version(self.spark, self.root, batch_id)
        if before is not None:
            ev = ev.unionByName(before)
        ev = ev.withColumn("_key", F.concat_ws("/", *[F.col(c).cast("string") for c in self.key]))
        # repeated rows share their hash, so only what can be drawn is compared
        ev = distinct_head(ev, self.n, [EVENT_ID, SESSION], seed=self.seed, key="_key")
        exact_sample(ev, self.n, seed=self.seed, key="_key").drop("_key").write.mode("overwrite").parquet(f"{self.root}/v={batch_id}")

    def sample(self) -> DataFrame:
        return latest_version(self.spark, self.root, LAST_BATCH)


LAST_BATCH = 2 ** 62

__all__ = ["events_stream", "dedup_stream", "windowed_popularity", "popularity_stream", "session_stream",
           "history_stream", "recommend_stream", "OpenSessions", "SessionRefresh", "ModelRefresh", "ReplayReservoir"]
