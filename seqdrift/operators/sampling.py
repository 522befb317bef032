"""Seeded splits and samples.

No global shuffle and no unseeded randomness: membership is a function of
``md5(seed || key)``, so both engines and every partitioning give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import discard, materialize
from ..functions.hashing import drawn, hash_key
from ..schema import EVENT_ID, EVENT_TIME, SESSION
from .ranges import range_index

SPLIT_HEX_WIDTH = 4


def split_flag(session_col: str = SESSION, frac: float = 0.8, seed: str = ""):
    """True for sessions in the training share (C1): md5 prefix below the fraction."""
    return drawn(F.col(session_col), frac, seed, SPLIT_HEX_WIDTH)


def split_sessions(events: DataFrame, frac: float = 0.8, seed: str = "") -> DataFrame:
    """Add ``is_train``: a per-row test of the session id, no shuffle, no join."""
    return events.withColumn("is_train", split_flag(SESSION, frac, seed))


def session_list(events: DataFrame, frac: float = 0.8, seed: str = "", train: bool = True) -> DataFrame:
    """Distinct sessions on one side of the split."""
    f = split_flag(SESSION, frac, seed)
    return events.select(SESSION).filter(f if train else ~f).distinct()


def semi(df: DataFrame, keys: DataFrame, on: str = SESSION) -> DataFrame:
    """Rows whose key is in ``keys``."""
    return df.join(keys, on=on, how="left_semi")


def anti(df: DataFrame, keys: DataFrame, on: str = SESSION) -> DataFrame:
    """Rows whose key is not in ``keys``."""
    return df.join(keys, on=on, how="left_anti")


def sample_rows(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Bernoulli row sample (C2); size is approximate, fraction capped at 1."""
    return df.sample(withReplacement=False, fraction=min(1.0, max(0.0, fraction)), seed=seed)


def seeded_rows(df: DataFrame, fraction: float, seed: str = "", key: Column | str = EVENT_ID) -> DataFrame:
    """Bernoulli row sample (C2) that any engine and partitioning draws alike: by a hash of the key, no shuffle."""
    return df.filter(drawn(F.col(key) if isinstance(key, str) else key, fraction, seed))


def exact_sample(df: DataFrame, n, seed: str = "", key: str = EVENT_ID, block_hex: int = 4) -> DataFrame:
    """Exactly ``min(n, rows)`` rows: the bottom-n by ``md5(seed || key)``.

    ``n`` may be an int or a one-row DataFrame column named ``n``. Rows are counted by the first
    ``block_hex`` hex digits of their hash (at most 16**block_hex counts); blocks wholly under n
    stay, later blocks go at the scan, and only the rows of the boundary block are ranked.
    """
    d = df.withColumn("_h", F.coalesce(hash_key(F.col(key), seed), F.lit("")))  # null keys come first
    blocks = d.groupBy(F.substring("_h", 1, block_hex).alias("_hb")).agg(F.count(F.lit(1)).alias("_c"))
    want = df.sparkSession.range(1).select(F.lit(n).cast("bigint").alias("n")) if isinstance(n, int) else n.select("n")
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the last block that starts under n, and how many of its rows are wanted; one row
    edge = blocks.withColumn("_before", before).crossJoin(F.broadcast(want)).filter(F.col("_before") < F.col("n")) \
        .agg(F.max("_hb").alias("_edge"), F.min(F.col("n") - F.col("_before")).alias("_need"))
    d = d.withColumn("_hb", F.substring("_h", 1, block_hex)).crossJoin(F.broadcast(materialize(edge, "sample-edge")))
    rank = F.row_number().over(Window.partitionBy("_hb").orderBy("_h"))
    last = d.filter(F.col("_hb") == F.col("_edge")).withColumn("_r", rank).filter(F.col("_r") <= F.col("_need"))
    return d.filter(F.col("_hb") < F.col("_edge")).select(*df.columns).unionByName(last.select(*df.columns))


def distinct_head(df: DataFrame, n: int, by: list[str], seed: str = "", key: str = EVENT_ID, block_hex: int = 4) -> DataFrame:
    """Rows that differ in ``by``, of the first hash blocks that hold ``n`` of them (all, if there are fewer); written.

    Holds the bottom-n of ``exact_sample(df.dropDuplicates(by), n, seed, key)``, where rows equal in ``by`` have equal
    keys: they share a block. Rows are counted by hash prefix as they come, and only the blocks that
    reach n are compared; while repeats leave fewer than n, twice as many rows are taken.
    """
    h = F.coalesce(hash_key(F.col(key), seed), F.lit(""))
    block = F.substring(h, 1, block_hex)
    counts = df.groupBy(block.alias("_hb")).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.orderBy("_hb").rowsBetween(Window.unboundedPreceding, 0))  # at most 16**block_hex rows
    counts = materialize(counts.select("_hb", upto.alias("_upto")), "head-blocks")
    want = n
    while True:
        edge = counts.filter(F.col("_upto") >= want).agg(F.min(F.struct("_hb", "_upto")).alias("e")).first()["e"]
        part = df if edge is None else df.filter(block <= edge["_hb"])
        head = materialize(part.dropDuplicates(by), "head-rows")
        if edge is None or head.count() >= n:
            return head
        discard(head)
        want = max(2 * want, edge["_upto"] + 1)


def split_sessions_exact(events: DataFrame, share_pct: int = 80, seed: str = "") -> DataFrame:
    """(user_session, is_train): exactly ⌊share·sessions⌋ training sessions, the first by hash."""
    sessions = events.select(SESSION).distinct()
    n = sessions.agg((F.count(F.lit(1)) * share_pct / 100).cast("bigint").alias("n"))
    train = exact_sample(sessions, n, seed, key=SESSION).withColumn("is_train", F.lit(True))
    return sessions.join(train, SESSION, "left").select(SESSION, F.coalesce("is_train", F.lit(False)).alias("is_train"))


def validation_tail(pairs: DataFrame, share_pct: int = 20, order=(EVENT_TIME, EVENT_ID)) -> DataFrame:
    """Flag the last ``share_pct``% of pairs in (time, id) order as validation (C4).

    ``is_validation = pos >= n*(100-share) div 100`` — integer arithmetic, like an
    ``int(n*0.8)`` split, with positions from range blocks of the whole key (no single-task sort).
    """
    d = range_index(pairs, list(order), pos="pair_pos", key_size="n_pairs", name="pair-positions")
    cut = (F.col("n_pairs") * F.lit(100 - share_pct)) / F.lit(100)
    return d.withColumn("is_validation", F.col("pair_pos") >= F.floor(cut))
