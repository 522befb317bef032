"""Daily protocol with trailing-window refits and model transfer.

* cutoff = midnight of (max time − ``shift_days``); the initial model trains on
  events ≤ cutoff; its clock (``last_update``) is the latest event it saw.
* test dates = cutoff + 1 day … (every midnight ≤ max time).
* at date d an update happens when ``whole_days(last_update, d) ≥ every``: it trains
  on events in [t_d − window, d] where t_d is the latest event ≤ d, and the clock
  becomes t_d. The schedule is a true recurrence, so it is folded over the (tiny,
  one row per day) date array with ``aggregate`` — no per-day job, no driver loop.
* scoring (default, prequential): day d scores the pairs inside (d − 1 day, d] with
  the model in force *before* d's update; ``cumulative=True`` scores every pair with
  both events ≤ d with the model updated at d (the reference's order).
* variants: ``static`` (initial model forever), ``updated`` (latest refit),
  ``transfer`` (counts carried across refits: C_v = C_{v−1} div 2 + W_v, aligned by
  item id).

Scale: pairs are aggregated once by (lower-bound key of prev time, upper-bound key
of next time, prev, next) where the keys count version bounds — so the
overlapping version windows meet an aggregate, not raw pairs — and by day key for
scoring. Versions and dates are a few rows each, broadcast with a proven bound.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window, functions as F

from ..config import materialize
from ..functions.time import day_start, minus_days, whole_days_between
from ..operators.sessions import session_pairs
from ..operators.transitions import DEFAULT_KS, keep_keys, target_ranks, topk_accuracy, transition_model
from ..schema import EVENT_ID, EVENT_TIME, ITEM

def day_key(col):
    """The test date d with t ∈ (d − 1 day, d]: midnight after t (t itself at midnight)."""
    c = F.col(col) if isinstance(col, str) else col
    one_micro = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0.000001))
    return day_start(c - one_micro) + F.make_dt_interval(F.lit(1))


class DailyProtocol:
    def __init__(self, events: DataFrame, shift_days: int = 14, window_days: int = 3, every_days: int = 3,
                 cumulative: bool = False, timed: DataFrame | None = None):
        """``timed``: a frame with the event times of ``events`` that is cheaper to read (the log
        before sessionization); the calendar needs no more."""
        self.raw_events = events
        self.timed = timed
        self.shift_days = shift_days
        self.window_days = window_days
        self.every_days = every_days
        self.cumulative = cumulative

    @cached_property
    def events(self) -> DataFrame:
        """The event log, computed once (sessionization included) and read by every branch."""
        return materialize(self.raw_events.select(EVENT_ID, EVENT_TIME, "user_session", ITEM), "daily-events")

    # -- calendar (tiny control tables, built once and materialized) --------------------
    def bounds(self) -> DataFrame:
        return self._bounds

    def test_dates(self) -> DataFrame:
        return self._dates

    def latest_upto(self) -> DataFrame:
        return self._upto

    def schedule(self) -> DataFrame:
        return self._schedule

    def versions(self) -> DataFrame:
        return self._versions

    @cached_property
    def per_day(self) -> DataFrame:
        """(_key, _mt): latest event of each day key — one pass, one row per day. Every
        calendar table (bounds, dates, per-date maxima, schedule) derives from it."""
        g = (self.events if self.timed is None else self.timed).groupBy(day_key(EVENT_TIME).alias("_key")).agg(F.max(EVENT_TIME).alias("_mt"))
        return materialize(g, "daily-per-day")

    @cached_property
    def _bounds(self) -> DataFrame:
        """One row: max_time, cutoff, n_dates."""
        m = self.per_day.agg(F.max("_mt").alias("max_time"))
        m = m.withColumn("cutoff", day_start(minus_days("max_time", self.shift_days)))
        return m.withColumn("n_dates", whole_days_between(F.col("cutoff"), F.col("max_time")))

    @cached_property
    def _dates(self) -> DataFrame:
        """(test_date) — every midnight after the cutoff up to the max time."""
        b = self.bounds()
        k = F.explode(F.sequence(F.lit(1).cast("bigint"), F.greatest(F.col("n_dates"), F.lit(1)).cast("bigint")))
        d = b.select("cutoff", "n_dates", k.alias("_k")).filter(F.col("_k") <= F.col("n_dates"))
        return d.select((F.col("cutoff") + F.make_dt_interval(F.col("_k"))).alias("test_date"))

    @cached_property
    def _upto(self) -> DataFrame:
        """(test_date, upto): latest event time ≤ each date (and the cutoff), via per-day maxima."""
        dates = self.test_dates().unionByName(self.bounds().select(F.col("cutoff").alias("test_date")))
        j = F.broadcast(dates).join(self.per_day, F.col("_key") <= F.col("test_date"), "left")
        return j.groupBy("test_date").agg(F.max("_mt").alias("upto"))

    @cached_property
    def _schedule(self) -> DataFrame:
        """L2/L3/I8: (test_date, is_update, last_update) — the folded update recurrence."""
        up = self.latest_upto()
        b = self.bounds().select("cutoff")
        init = up.join(F.broadcast(b), F.col("test_date") == F.col("cutoff")).select(F.col("upto").alias("_init"))
        arr = up.join(F.broadcast(b), F.col("test_date") > F.col("cutoff")) \
            .agg(F.array_sort(F.collect_list(F.struct("test_date", "upto"))).alias("_arr"))
        every = self.every_days
        row_t = "struct<test_date: timestamp_ntz, is_update: boolean, last_update: timestamp_ntz>"

        def step(acc, x):
            due = acc["last"].isNull() | (whole_days_between(acc["last"], x["test_date"]) >= F.lit(every))
            new_last = F.when(due, x["upto"]).otherwise(acc["last"])
            rec = F.struct(x["test_date"].alias("test_date"), due.alias("is_update"), new_last.alias("last_update"))
            return F.struct(new_last.alias("last"), F.concat(acc["out"], F.array(rec)).alias("out"))

        start = F.struct(F.col("_init").alias("last"), F.array().cast(f"array<{row_t}>").alias("out"))
        folded = init.crossJoin(arr).select(F.aggregate("_arr", start, step)["out"].alias("_out"))
        return folded.select(F.explode("_out").alias("_r")).select("_r.*")

    @cached_property
    def _versions(self) -> DataFrame:
        """(version, fit_date, fit_time, lo, hi): version 0 = initial fit; then one per update.
        Training events of a version: lo ≤ event_time ≤ hi (lo NULL = unbounded)."""
        up = self.latest_upto()
        b = self.bounds().select("cutoff")
        v0 = up.join(F.broadcast(b), F.col("test_date") == F.col("cutoff")).select(
            F.lit(0).cast("bigint").alias("version"), F.col("cutoff").alias("fit_date"),
            F.col("upto").alias("fit_time"), F.lit(None).cast("timestamp_ntz").alias("lo"),
            F.col("cutoff").alias("hi"))
        s = self.schedule().filter("is_update")
        w = Window.orderBy("test_date")  # one row per update: a handful of rows
        vs = s.select(F.row_number().over(w).cast("bigint").alias("version"), F.col("test_date").alias("fit_date"),
                      F.col("last_update").alias("fit_time"),
                      minus_days("last_update", self.window_days).alias("lo"), F.col("test_date").alias("hi"))
        return materialize(v0.unionByName(vs), "daily-versions")

    def model_in_force(self) -> DataFrame:
        return self._mif

    @cached_property
    def _mif(self) -> DataFrame:
        """(test_date, version) — as-of join of each date to the version valid then.
        Validity [fit_date, next fit_date) is closed on the left for cumulative scoring
        (update before scoring) and shifted by one date for prequential scoring."""
        v = self.versions()
        w = Window.orderBy("fit_date")
        v = v.withColumn("_to", F.lead("fit_date").over(w))
        d = self.test_dates()
        if self.cumulative:
            cond = (F.col("test_date") >= F.col("fit_date")) & (F.col("_to").isNull() | (F.col("test_date") < F.col("_to")))
        else:
            cond = (F.col("test_date") > F.col("fit_date")) & (F.col("_to").isNull() | (F.col("test_date") <= F.col("_to")))
        return d.join(F.broadcast(v), cond).select("test_date", "version")

    # -- training and test pairs ---------------------------------------------------------
    def pairs(self) -> DataFrame:
        p = session_pairs(self.events, extra_next=[EVENT_TIME])
        return p.select("prev_item", "next_item", F.col(EVENT_TIME).alias("prev_time"),
                        F.col(f"next_{EVENT_TIME}").alias("next_time"))

    def _version_keys(self) -> DataFrame:
        return self._vkeys

    @cached_property
    def _vkeys(self) -> DataFrame:
        v = self.versions()
        los = v.filter(F.col("lo").isNotNull()).agg(F.array_sort(F.collect_set("lo")).alias("_los"))
        his = v.agg(F.array_sort(F.collect_set("hi")).alias("_his"))
        return los.crossJoin(his)

    @staticmethod
    def _lo_key(c):
        return F.size(F.filter("_los", lambda b: b <= c)).cast("bigint")

    @staticmethod
    def _hi_key(c):
        return F.size(F.filter("_his", lambda b: b < c)).cast("bigint")

    @cached_property
    def pair_counts(self) -> DataFrame:
        """Pairs aggregated once by (version-bound keys, day keys, prev, next) and
        materialized: every model version and every scored day reads this table."""
        keys = F.broadcast(self._version_keys())
        agg = self.pairs().crossJoin(keys).groupBy(
            self._lo_key(F.col("prev_time")).alias("_lk"), self._hi_key(F.col("next_time")).alias("_hk"),
            day_key("prev_time").alias("_dp"), day_key("next_time").alias("_dn"),
            "prev_item", "next_item").agg(F.count(F.lit(1)).cast("bigint").alias("cnt"))
        return materialize(agg, "daily-pair-counts")

    def window_counts(self) -> DataFrame:
        return self._window_counts

    @cached_property
    def _window_counts(self) -> DataFrame:
        """W_v: (version, prev_item, next_item, cnt) — pairs with both events in version v's window."""
        keys = F.broadcast(self._version_keys())
        agg = self.pair_counts
        v = self.versions().crossJoin(keys)
        v = v.select("version", F.when(F.col("lo").isNull(), F.lit(0).cast("bigint"))
                     .otherwise(self._lo_key(F.col("lo"))).alias("_vl"), self._hi_key(F.col("hi")).alias("_vh"))
        # t ≥ lo ⟺ lo_key(t) ≥ lo_key(lo);  t ≤ hi ⟺ hi_key(t) ≤ hi_key(hi)
        j = agg.join(F.broadcast(v), (F.col("_lk") >= F.col("_vl")) & (F.col("_hk") <= F.col("_vh")))
        w = j.groupBy("version", "prev_item", "next_item").agg(F.sum("cnt").cast("bigint").alias("cnt"))
        return materialize(w, "daily-window-counts")

    def transfer_counts(self) -> DataFrame:
        return self._transfer

    @cached_property
    def _transfer(self) -> DataFrame:
        """K5: C_0 = W_0, C_v = C_{v−1} div 2 + W_v, per (prev, next) aligned by item id.

        Each (prev, next) folds over the version list (a one-row array, a handful of
        entries): groups are bounded by the number of versions, not by data size.
        """
        w = self.window_counts()
        vids = self.versions().agg(F.array_sort(F.collect_list("version")).alias("_vids"))
        g = w.groupBy("prev_item", "next_item").agg(
            F.map_from_entries(F.collect_list(F.struct("version", "cnt"))).alias("_w"))
        g = g.crossJoin(F.broadcast(vids))

        def step(acc, v):
            prev = F.when(F.size(acc) > 0, F.element_at(acc, -1)).otherwise(F.lit(0).cast("bigint"))
            cur = F.shiftright(prev, 1) + F.coalesce(F.try_element_at(F.col("_w"), v), F.lit(0).cast("bigint"))
            return F.concat(acc, F.array(cur))

        c = g.select("prev_item", "next_item", "_vids",
                     F.aggregate("_vids", F.array().cast("array<bigint>"), step).alias("_c"))
        e = c.select("prev_item", "next_item", F.arrays_zip("_vids", "_c").alias("_z")) \
            .select("prev_item", "next_item", F.explode("_z").alias("_e"))
        e = e.select(F.col("_e._vids").alias("version"), "prev_item", "next_item", F.col("_e._c").alias("cnt"))
        return e.filter(F.col("cnt") > 0)

    def test_counts(self) -> DataFrame:
        """(test_date, prev_item, target, n) — the scored pairs of each date."""
        p = self.pair_counts
        dates = F.broadcast(self.test_dates())
        if self.cumulative:
            a = p.groupBy(F.col("_dn").alias("_key"), "prev_item", F.col("next_item").alias("target")) \
                .agg(F.sum("cnt").alias("n"))
            j = a.join(dates, F.col("_key") <= F.col("test_date"))
            return j.groupBy("test_date", "prev_item", "target").agg(F.sum("n").cast("bigint").alias("n"))
        a = p.filter(F.col("_dp") == F.col("_dn")).groupBy(
            F.col("_dn").alias("test_date"), "prev_item", F.col("next_item").alias("target")) \
            .agg(F.sum("cnt").cast("bigint").alias("n"))
        return a.join(dates, "test_date", "left_semi")

    def accuracy(self, variants=("static", "updated", "transfer"), ks=DEFAULT_KS) -> DataFrame:
        """(test_date, variant, k, n, hits, accuracy)."""
        tests = keep_keys(self.test_counts(), self.test_dates())
        mif = self.model_in_force()
        out = None
        for v in variants:
            if v == "static":
                m = self.window_counts().filter(F.col("version") == 0).drop("version")
                r = target_ranks(tests, m, None, max(ks), fill=False, tie="item")
            else:
                counts = self.window_counts() if v == "updated" else self.transfer_counts()
                t = tests.join(F.broadcast(mif), "test_date")
                r = target_ranks(t, counts, None, max(ks), keys=["version"], fill=False, tie="item")
            a = topk_accuracy(r, ks, keys=["test_date"]).withColumn("variant", F.lit(v))
            out = a if out is None else out.unionByName(a)
        return out.select("test_date", "variant", "k", "n", "hits", "accuracy")

    # -- row-level views ---------------------------------------------------------------
    def window_rows(self) -> DataFrame:
        """L4: (version, event_id) — training events of each refit (B3 per update)."""
        v = F.broadcast(self.versions().filter(F.col("version") >= 1))
        j = self.events.join(v, (F.col(EVENT_TIME) >= F.col("lo")) & (F.col(EVENT_TIME) <= F.col("hi")))
        return j.select("version", EVENT_ID)

    def initial_model(self) -> DataFrame:
        """L1: transition counts of the initial fit (pairs with both events ≤ cutoff)."""
        return self.window_counts().filter(F.col("version") == 0).drop("version")


def initial_events(events: DataFrame, shift_days: int = 14) -> DataFrame:
    d = DailyProtocol(events, shift_days)
    return events.crossJoin(F.broadcast(d.bounds().select("cutoff"))) \
        .filter(F.col(EVENT_TIME) <= F.col("cutoff")).drop("cutoff")


def initial_transitions(events: DataFrame, shift_days: int = 14) -> DataFrame:
    """L1 straight from the definition (used to cross-check ``initial_model``)."""
    return transition_model(session_pairs(initial_events(events, shift_days)))


__all__ = ["DailyProtocol", "day_key", "initial_events", "initial_transitions"]
