"""M7 with the update clock: versioned models over trailing windows, kept up to date by a stream.

The stream follows the protocol of ``plans.daily``: from a cutoff on, a version is fitted whenever
whole days have passed since the last event the model saw, on the pairs inside its trailing window.
Nothing is counted twice to get there:

* a batch turns into the *signed change* of the session pairs it touches (a late event takes back the
  pair it splits), written once, in folders by the days of both events;
* a new version is its predecessor's counts, plus the pairs of the days it adds, minus those of the days
  that left the window: only these days' folders are read;
* versions that exist already receive the batch's change inside their bounds, so a late event corrects
  every model it belongs to; one whose bounds a late event has moved is fitted anew;
* the calendar is one row per day (the latest event), from which the schedule is folded again.

The version list names the counts that belong to it and becomes current by one commit record, so
readers see whole versions, and a batch delivered again, or failed half-way, changes nothing.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from ..config import materialize
from ..functions.time import whole_days_between
from ..operators.sessions import session_pairs
from ..plans.daily import DailyProtocol, day_key
from ..schema import EVENT_TIME
from .commits import commit, committed
from .jobs import OpenSessions
from .staging import has_files

CHANGES = "prev_time timestamp_ntz, next_time timestamp_ntz, prev_item bigint, next_item bigint, cnt bigint, " \
          "batch_id bigint, prev_day date, next_day date"
COUNTS = "key string, prev_item bigint, next_item bigint, cnt bigint, batch_id bigint"
VERSION = ["version", "fit_date", "fit_time", "lo", "hi"]


class StreamCalendar(DailyProtocol):
    """The daily protocol's calendar from a table of days and a cutoff that is given, not derived."""

    def __init__(self, days: DataFrame, cutoff: dt.datetime, window_days: int, every_days: int):
        super().__init__(days, window_days=window_days, every_days=every_days)
        self.days, self.cutoff = days, cutoff

    @cached_property
    def per_day(self) -> DataFrame:
        return self.days

    @cached_property
    def _bounds(self) -> DataFrame:
        b = self.days.agg(F.max("_mt").alias("max_time")).withColumn("cutoff", F.lit(self.cutoff).cast("timestamp_ntz"))
        return b.withColumn("n_dates", whole_days_between(F.col("cutoff"), F.col("max_time"))).where("max_time >= cutoff")


def session_changes(new: DataFrame, stored: DataFrame | None) -> DataFrame:
    """(prev_time, next_time, prev_item, next_item, cnt): pairs gained (> 0) and lost (< 0) by new rows."""
    def pairs(events: DataFrame, sign: int) -> DataFrame:
        return session_pairs(events, extra_next=[EVENT_TIME]).select(
            F.col(EVENT_TIME).alias("prev_time"), F.col(f"next_{EVENT_TIME}").alias("next_time"), "prev_item", "next_item",
            F.lit(sign).cast("bigint").alias("cnt"))

    out = pairs(new, 1) if stored is None else pairs(new.unionByName(stored), 1).unionByName(pairs(stored, -1))
    return out.groupBy("prev_time", "next_time", "prev_item", "next_item").agg(F.sum("cnt").alias("cnt")).where("cnt != 0")


class RefitStream(OpenSessions):
    """``foreachBatch`` job that keeps the version list and the counts of every version (see the module).

    cutoff: the end of the first training span, a midnight. ``versions()`` and ``counts()`` read what the
    last commit made current; ``model()`` is the newest version's counts. Events may come in any order.
    """

    def __init__(self, spark, cutoff: dt.datetime, window_days: int = 3, every_days: int = 3,
                 expire_seconds: int | None = None, root: str | None = None):
        super().__init__(spark, expire_seconds, root)
        self.cutoff, self.window_days, self.every_days = cutoff, window_days, every_days

    # -- one batch ----------------------------------------------------------------------
    partition_by = ("prev_day", "next_day")

    def refresh(self, new: DataFrame, stored: DataFrame | None) -> DataFrame:
        rows = session_changes(new, stored).withColumn("prev_day", F.to_date("prev_time")).withColumn("next_day", F.to_date("next_time"))
        # few files a folder; a day with most of the pairs is split by its size
        return rows.hint("rebalance", "prev_day", "next_day")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        super().__call__(batch, batch_id)
        done = committed(self.spark, self.root, before=batch_id)
        last = done[-1] if done else None
        days = batch.select(F.col(EVENT_TIME).cast("timestamp_ntz").alias("_mt")).groupBy(day_key("_mt").alias("_key")).agg(F.max("_mt").alias("_mt"))
        if last is not None:
            days = days.unionByName(self._table("days", last).select("_key", "_mt")).groupBy("_key").agg(F.max("_mt").alias("_mt"))
        days = self._write(days, "days", batch_id)
        now = StreamCalendar(days, self.cutoff, self.window_days, self.every_days).versions()
        # one row per update: the control table, not the data
        now = [r.asDict() for r in now.select(*VERSION).orderBy("version").collect() if r["fit_time"] is not None]
        old = {} if last is None else {(r["fit_date"], r["lo"], r["hi"]): r["key"] for r in self._table("versions", last).collect()}
        log = self._changes([*done, batch_id])
        mine = log.where(F.col("batch_id") == batch_id)
        fresh, parts = [], []
        for at, v in enumerate(now):
            v["key"] = old.get((v["fit_date"], v["lo"], v["hi"]))
            if v["key"] is None:
                v["key"] = f"{batch_id}-{v['version']}"
                fresh.append(v["key"])
                key, rows = self._fit(v, now[at - 1] if at else None, log, parts, old, done)
                # written, so that the next version adds to these counts instead of all that led to them
                parts.append((key, materialize(summed(rows), "version-counts")))
            else:
                parts.append((v["key"], summed(inside(mine, v["lo"], v["hi"]))))
        out = None
        for key, rows in parts:
            rows = rows.select(F.lit(key).alias("key"), "*")
            out = rows if out is None else out.unionByName(rows)
        none = self.spark.createDataFrame([], "key string, prev_item bigint, next_item bigint, cnt bigint")
        (none if out is None else out).hint("rebalance").write.mode("overwrite").parquet(f"{self.root}/counts/batch_id={batch_id}")
        listed = self.spark.createDataFrame([tuple(v[c] for c in [*VERSION, "key"]) for v in now],
                                            "version bigint, fit_date timestamp_ntz, fit_time timestamp_ntz, lo timestamp_ntz, hi timestamp_ntz, key string")
        self._write(listed.coalesce(1), "versions", batch_id)
        commit(self.spark, self.root, batch_id)

    def _fit(self, v: dict, before: dict | None, log: DataFrame, parts: list, old: dict, done: list[int]) -> tuple[str, DataFrame]:
        """Counts of a new version: its predecessor's, plus the added days, minus the expired ones."""
        if before is None or before["lo"] is None or before["lo"] > v["lo"] or before["hi"] > v["hi"]:
            return v["key"], inside(log, v["lo"], v["hi"])
        rows = dict(parts)[before["key"]].select("prev_item", "next_item", "cnt")
        if before["key"] in old.values():  # counts of earlier batches; ``parts`` holds this batch's change only
            rows = rows.unionByName(self._counts(done).where(F.col("key") == before["key"]).select("prev_item", "next_item", "cnt"))
        added = inside(log, v["lo"], v["hi"], after=before["hi"])
        expired = inside(log, before["lo"], before["hi"], until=v["lo"])
        return v["key"], rows.unionByName(added).unionByName(expired.withColumn("cnt", -F.col("cnt")))

    # -- tables -------------------------------------------------------------------------
    def _write(self, df: DataFrame, name: str, batch_id: int) -> DataFrame:
        path = f"{self.root}/{name}/batch_id={batch_id}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def _table(self, name: str, batch_id: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/batch_id={batch_id}")

    def _changes(self, ids: list[int]) -> DataFrame:
        return self.spark.read.schema(CHANGES).parquet(f"{self.root}/delta").where(F.col("batch_id").isin(ids))

    def _counts(self, ids: list[int]) -> DataFrame:
        if not has_files(self.spark, f"{self.root}/counts"):
            return self.spark.createDataFrame([], COUNTS)
        return self.spark.read.schema(COUNTS).parquet(f"{self.root}/counts").where(F.col("batch_id").isin(ids))

    # -- what readers see ----------------------------------------------------------------
    def versions(self) -> DataFrame:
        """(version, fit_date, fit_time, lo, hi) as of the last commit."""
        return self._current().drop("key")

    def _current(self) -> DataFrame:
        done = committed(self.spark, self.root)
        if not done:
            raise ValueError("no batch is committed yet")
        return self._table("versions", done[-1])

    def counts(self) -> DataFrame:
        """(version, prev_item, next_item, cnt) of every current version."""
        rows = self._counts(committed(self.spark, self.root)).join(F.broadcast(self._current().select("key", "version")), "key")
        return rows.groupBy("version", "prev_item", "next_item").agg(F.sum("cnt").alias("cnt")).where("cnt > 0")

    def model(self) -> DataFrame:
        """(prev_item, next_item, cnt) of the newest version."""
        newest = self.versions().agg(F.max("version").alias("version"))
        return self.counts().join(F.broadcast(newest), "version").drop("version")


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("prev_item", "next_item").agg(F.sum("cnt").alias("cnt")).where("cnt != 0")


def inside(changes: DataFrame, lo: dt.datetime | None, hi: dt.datetime, after: dt.datetime | None = None,
           until: dt.datetime | None = None) -> DataFrame:
    """(prev_item, next_item, cnt) of pairs with lo <= prev and next <= hi; the days prune folders.

    after: only pairs whose next event is later; until: only pairs whose previous event is earlier.
    """
    def at(t: dt.datetime):
        return F.lit(t).cast("timestamp_ntz")

    rows = changes.where((F.col("next_day") <= F.lit(hi.date())) & (F.col("next_time") <= at(hi)))
    if lo is not None:
        rows = rows.where((F.col("prev_day") >= F.lit(lo.date())) & (F.col("prev_time") >= at(lo)))
    if after is not None:
        rows = rows.where((F.col("next_day") >= F.lit(after.date())) & (F.col("next_time") > at(after)))
    if until is not None:
        rows = rows.where((F.col("prev_day") <= F.lit(until.date())) & (F.col("prev_time") < at(until)))
    return rows.select("prev_item", "next_item", "cnt")


__all__ = ["RefitStream", "StreamCalendar", "session_changes", "inside"]
