"""Sessions, event order, (prev, next) pairs and sliding histories.

Order inside a session is total: ``(event_time, event_id)``. No operator here puts
a whole session into one task or one array: positions go through
``ordered_index`` (time-bucket blocks) and histories/sequences through
fixed-size chunks of the position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.arrays import clamp_ids, left_pad
from ..functions.time import MICROS_PER_SECOND, epoch_micros, time_bucket
from ..schema import EVENT_ID, EVENT_TIME, ITEM, SESSION, USER
from .ordered import ordered_index

# Width of the time blocks that bound one window task inside a session.
DEFAULT_BLOCK_SECONDS = 3600


def gap_sessions(events: DataFrame, gap_seconds: int = 86_400, user: str = USER,
                 out: str = SESSION) -> DataFrame:
    """Sessionize by inactivity: a new session starts at a user's first event or
    after a gap strictly longer than ``gap_seconds``; ``out = user || '-' || ordinal``.

    Buckets are exactly one gap wide, so two events in one bucket are never more than
    a gap apart: sessions can only start at a bucket's first event. The whole
    decision is therefore taken on the (user, bucket) summary table — one row per
    active user-bucket — and joined back; no window ever sees a user's full history.
    """
    b = "_gap_bucket"
    ev = events.withColumn(b, time_bucket(EVENT_TIME, gap_seconds))
    blocks = ev.groupBy(user, b).agg(F.min(EVENT_TIME).alias("_first"), F.max(EVENT_TIME).alias("_last"))
    w = Window.partitionBy(user).orderBy(b)
    prev_last = F.lag("_last", 1).over(w)
    starts = F.when(prev_last.isNull() |
                    (epoch_micros("_first") - epoch_micros(prev_last) > F.lit(gap_seconds * MICROS_PER_SECOND)),
                    F.lit(1)).otherwise(F.lit(0))
    blocks = blocks.withColumn("_start", starts)
    blocks = blocks.withColumn("_ord", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = blocks.select(user, b, F.concat(F.col(user).cast("string"), F.lit("-"),
                                             F.col("_ord").cast("string")).alias(out))
    return ev.join(blocks, on=[user, b], how="inner").drop(b)


def gap_session_rows(events: DataFrame, gap_seconds: int = 86_400, next_of=(), with_size: bool = False,
                     user: str = USER) -> DataFrame:
    """``gap_sessions`` and ``session_rows`` fused into one pass over the events.

    A block is one gap-wide time bucket of one user; it never spans two sessions
    (two of its events are less than a gap apart). So row numbers and successors
    can be taken inside (user, block) — the only full shuffle — and everything
    else comes from the block summary (one row per active user-block): session
    ordinal, the block's offset inside its session, the next block's first values
    when it continues the same session. The join back is co-partitioned with the
    window's output, so only the summary moves. Equals ``session_rows(gap_sessions(…))``.
    """
    b = "_gb"
    base = events.withColumn(b, time_bucket(EVENT_TIME, gap_seconds))
    w_in = Window.partitionBy(user, b).orderBy(EVENT_TIME, EVENT_ID)
    d = base.withColumn("_r", F.row_number().over(w_in))
    for c in next_of:
        d = d.withColumn(f"_nx_{c}", F.lead(c, 1).over(w_in))
    # the summary is a partial aggregate of the un-windowed input: no second full shuffle
    okey = F.struct(EVENT_TIME, EVENT_ID)
    aggs = [F.count(F.lit(1)).alias("_n"), F.min(EVENT_TIME).alias("_first"), F.max(EVENT_TIME).alias("_last")]
    aggs += [F.min_by(F.col(c), okey).alias(f"_first_{c}") for c in next_of]
    blocks = base.groupBy(user, b).agg(*aggs)
    wu = Window.partitionBy(user).orderBy(b)
    prev_last = F.lag("_last", 1).over(wu)
    start = F.when(prev_last.isNull() |
                   (epoch_micros("_first") - epoch_micros(prev_last) > F.lit(gap_seconds * MICROS_PER_SECOND)),
                   F.lit(1)).otherwise(F.lit(0))
    blocks = blocks.withColumn("_start", start)
    blocks = blocks.withColumn("_ord", F.sum("_start").over(wu.rowsBetween(Window.unboundedPreceding, 0)))
    ws = Window.partitionBy(user, "_ord").orderBy(b)
    blocks = blocks.withColumn("_off", F.coalesce(F.sum("_n").over(ws.rowsBetween(Window.unboundedPreceding, -1)),
                                                  F.lit(0)))
    for c in next_of:
        blocks = blocks.withColumn(f"_nb_{c}", F.lead(f"_first_{c}", 1).over(ws))
    if with_size:
        blocks = blocks.withColumn("session_len", F.sum("_n").over(Window.partitionBy(user, "_ord")))
    keep = [user, b, "_n", "_off", F.concat(F.col(user).cast("string"), F.lit("-"),
                                            F.col("_ord").cast("string")).alias(SESSION)]
    keep += [f"_nb_{c}" for c in next_of] + (["session_len"] if with_size else [])
    out = d.join(blocks.select(*keep), on=[user, b], how="inner")
    out = out.withColumn("row_num", (F.col("_off") + F.col("_r")).cast("bigint"))
    for c in next_of:
        out = out.withColumn(f"next_{c}", F.when(F.col("_r") == F.col("_n"), F.col(f"_nb_{c}"))
                             .otherwise(F.col(f"_nx_{c}")))
    drop = [b, "_r", "_n", "_off"] + [f"_nx_{c}" for c in next_of] + [f"_nb_{c}" for c in next_of]
    return out.drop(*drop)


def pairs_from_rows(rows: DataFrame, compat: bool = False) -> DataFrame:
    """Pairs from ordered rows carrying ``row_num`` and ``next_<item>`` (and ``session_len``
    when compat): the last row of a session has no successor."""
    d = rows.filter(F.col(f"next_{ITEM}").isNotNull())
    if compat:
        d = d.filter(F.col("row_num") <= F.col("session_len") - 2).drop("session_len")
    return d.withColumnRenamed(ITEM, "prev_item").withColumnRenamed(f"next_{ITEM}", "next_item")


def session_rows(events: DataFrame, block_seconds: int = DEFAULT_BLOCK_SECONDS,
                 next_of=(), with_size: bool = False) -> DataFrame:
    """Add ``row_num`` (1-based) inside each session along (event_time, event_id)."""
    return ordered_index(
        events, [SESSION], [EVENT_TIME, EVENT_ID],
        [("_blk", time_bucket(EVENT_TIME, block_seconds))],
        name="row_num", start=1, next_of=next_of,
        key_size="session_len" if with_size else None)


def session_pairs(events: DataFrame, compat: bool = False,
                  block_seconds: int = DEFAULT_BLOCK_SECONDS, extra_next=()) -> DataFrame:
    """One row per consecutive (prev, next) pair inside a session.

    Default: a session of n events gives n−1 pairs. ``compat=True`` reproduces the
    reference's filter order (last event dropped before pairing): n−2 pairs.
    Columns: user_session, row_num, prev_item, next_item (+ ``next_<c>`` for extra_next).
    """
    nx = [ITEM] + [c for c in extra_next if c != ITEM]
    return pairs_from_rows(session_rows(events, block_seconds, next_of=nx, with_size=compat), compat)


def session_sequences(events: DataFrame, min_len: int = 2, chunk_len: int = 1024,
                      block_seconds: int = DEFAULT_BLOCK_SECONDS) -> DataFrame:
    """Items per session in order, as bounded chunks of ``chunk_len`` items.

    Rows: (user_session, chunk, session_len, items) — chunk c holds positions
    c*chunk_len+1 … (c+1)*chunk_len. No group ever exceeds ``chunk_len`` rows, so a
    giant session cannot become one giant array. Sessions shorter than ``min_len``
    are dropped.
    """
    return sequences_from_rows(session_rows(events, block_seconds, with_size=True), min_len, chunk_len)


def sequences_from_rows(rows: DataFrame, min_len: int = 2, chunk_len: int = 1024) -> DataFrame:
    """``session_sequences`` for rows already carrying ``row_num`` and ``session_len``."""
    d = rows.filter(F.col("session_len") >= min_len)
    d = d.withColumn("chunk", ((F.col("row_num") - 1) / chunk_len).cast("bigint"))
    g = d.groupBy(SESSION, "chunk", "session_len").agg(
        F.array_sort(F.collect_list(F.struct("row_num", ITEM))).alias("_s"))
    return g.select(SESSION, "chunk", "session_len",
                    F.transform("_s", lambda x: x[ITEM]).alias("items"))


def history_windows(rows: DataFrame, length: int, value: str = ITEM,
                    carry=(f"next_{ITEM}",)) -> DataFrame:
    """For every event, the last ``length`` values of its session up to and including it.

    ``rows`` must carry ``row_num`` (see ``session_rows``). Rows are grouped in chunks
    of ``length`` positions; each chunk also receives the previous chunk as context,
    so every group holds at most 2·length rows whatever the session size, and each
    event finds its whole frame inside its own group.
    Output: user_session, row_num, history (array, oldest first), carried columns.
    """
    carry = [c for c in carry if c in rows.columns]
    base = rows.select(SESSION, "row_num", value, *carry) \
        .withColumn("_c", ((F.col("row_num") - 1) / length).cast("bigint"))
    own = base.withColumn("_own", F.lit(True))
    ctx = base.withColumn("_c", F.col("_c") + 1).withColumn("_own", F.lit(False))
    fields = ["row_num", value, "_own"] + carry
    g = own.unionByName(ctx).groupBy(SESSION, "_c").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("_a"))
    e = g.select(SESSION, "_a", F.explode(F.filter("_a", lambda x: x["_own"])).alias("_e"))
    lo = F.col("_e.row_num") - F.lit(length - 1)
    hist = F.transform(
        F.filter("_a", lambda x: (x["row_num"] >= lo) & (x["row_num"] <= F.col("_e.row_num"))),
        lambda x: x[value])
    return e.select(SESSION, F.col("_e.row_num").alias("row_num"), hist.alias("history"),
                    *[F.col(f"_e.{c}").alias(c) for c in carry])


def history_pairs(events: DataFrame, length: int, block_seconds: int = DEFAULT_BLOCK_SECONDS) -> DataFrame:
    """(history of ≤ length items, target) for every event that has a successor."""
    rows = session_rows(events, block_seconds, next_of=[ITEM])
    h = history_windows(rows, length)
    return h.filter(F.col(f"next_{ITEM}").isNotNull()).withColumnRenamed(f"next_{ITEM}", "target")


def padded(history, length: int, pad: int = -1, n_items=None):
    """Fixed-length model input: optional out-of-range clamp, then left pad/truncate."""
    h = F.col(history) if isinstance(history, str) else history
    if n_items is not None:
        h = clamp_ids(h, n_items)
    return left_pad(h, length, pad)
