"""Sliding-window + replay protocol, all phases in one job.

Positions are the global (event_time, event_id) order. With N events:
init = ⌊.45N⌋, train = ⌊.40N⌋, test = buffer = ⌊.05N⌋, step = ⌊.10N⌋ (integer maths).
Phase 0 trains on [0, init) and tests [init, init+test). Phase p ≥ 1 has
end = N − init + (p−1)·step, trains on [end−train, end) and tests [end, end+test),
kept while end+test ≤ N.

Replay (default ``unit="session"``): draw 0 (the seed) keeps the rows before
step+test of the sessions whose md5(seed, 0, session) is under buffer/(step+test);
draw q ≥ 1, taken after phase q's fit, keeps the rows before phase q's window of the
sessions under buffer/start_q. Phase p trains on its window plus draws {0 … p−1}
(``buffer="growing"``) or draw 0 only (``"frozen"``, the reference's effective
behaviour). A session's drawn rows are a prefix of it, so replay pairs are the
session's own consecutive pairs inside that prefix and never overlap the window.

Scale: the plan has at most a handful of rows (fixed fractions), so it is broadcast
with a proven bound. Pairs are first aggregated by (segment of prev, segment of next,
first draw, prev, next) — segments cut at every plan boundary — and only that
aggregate meets the plan, so overlapping windows multiply counts, not raw rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window, functions as F

from ..config import materialize
from ..functions.hashing import HEX_WIDTH, threshold_column
from ..operators.ordered import ordered_index
from ..operators.sessions import DEFAULT_BLOCK_SECONDS, session_rows
from ..operators.slices import event_positions
from ..functions.time import time_bucket
from ..operators.transitions import DEFAULT_KS, keep_keys, target_ranks, topk_accuracy
from ..schema import EVENT_ID, ITEM, SESSION

REPLAY_SEED = "replay"


def sizes(events: DataFrame) -> DataFrame:
    """One row: N and the integer slice sizes."""
    return events.agg(F.count(F.lit(1)).cast("bigint").alias("N")).select(
        "N", F.expr("N * 45 div 100").alias("init"), F.expr("N * 40 div 100").alias("train"),
        F.expr("N * 5 div 100").alias("test"), F.expr("N * 10 div 100").alias("step"),
        F.expr("N * 5 div 100").alias("buffer"))


def phase_plan(sz: DataFrame) -> DataFrame:
    """(phase, train_start, train_end, test_start, test_end) — a few rows."""
    pmax = F.when(F.col("step") > 0, F.expr("(init + test) div greatest(step, 1)") + 1) \
        .otherwise(F.lit(0).cast("bigint"))
    p = sz.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), pmax)).alias("phase"))
    end = F.when(F.col("phase") == 0, F.col("init")).otherwise(
        F.col("N") - F.col("init") + (F.col("phase") - 1) * F.col("step"))
    start = F.when(F.col("phase") == 0, F.lit(0).cast("bigint")).otherwise(end - F.col("train"))
    p = p.select("phase", start.alias("train_start"), end.alias("train_end"), end.alias("test_start"),
                 (end + F.col("test")).alias("test_end"), "N", "buffer", "step", "test")
    return p.filter(F.col("test_end") <= F.col("N"))


def replay_draws(sz: DataFrame, plan: DataFrame) -> DataFrame:
    """(q, bound, thr): draw q keeps rows with pos < bound of sessions whose hash is under thr."""
    seed = sz.select(F.lit(0).cast("bigint").alias("q"), (F.col("step") + F.col("test")).alias("bound"), "buffer")
    later = plan.filter(F.col("phase") >= 1).select(F.col("phase").alias("q"), F.col("train_start").alias("bound"),
                                                    "buffer")
    d = seed.unionByName(later)
    return d.select("q", "bound", threshold_column("buffer", "bound").alias("thr"))


def _one_row_arrays(plan: DataFrame, draws: DataFrame) -> DataFrame:
    """Plan boundaries and draws folded into one row of arrays (broadcast-safe)."""
    b = plan.select(F.explode(F.array("train_start", "train_end", "test_start", "test_end")).alias("b"))
    b = b.unionByName(draws.select(F.col("bound").alias("b")))
    bounds = b.agg(F.array_sort(F.collect_set("b")).alias("_bounds"))
    dr = draws.agg(F.collect_list(F.struct("q", "bound", "thr")).alias("_draws"))
    return bounds.crossJoin(dr)


def _seg(pos_col: str):
    return F.size(F.filter("_bounds", lambda b: b <= F.col(pos_col))).cast("bigint")


def _first_draw(pos_col: str):
    """Smallest draw index whose prefix and session hash admit this position."""
    def admits(d):
        key = F.concat(F.lit(REPLAY_SEED), d["q"].cast("string"), F.lit("|"), F.col(SESSION))
        return (F.col(pos_col) < d["bound"]) & (F.substring(F.md5(key), 1, HEX_WIDTH) < d["thr"])
    return F.array_min(F.transform(F.filter("_draws", admits), lambda d: d["q"]))


def positioned_pairs(events: DataFrame, positioned: bool = False) -> DataFrame:
    """Consecutive in-session pairs with both global positions."""
    ev = events if positioned else event_positions(events)
    rows = session_rows(ev, next_of=[ITEM, "pos"])
    return rows.filter(F.col(f"next_{ITEM}").isNotNull()).select(
        SESSION, EVENT_ID, F.col(ITEM).alias("prev_item"), F.col(f"next_{ITEM}").alias("next_item"),
        F.col("pos").alias("prev_pos"), F.col("next_pos"))


class PhaseProtocol:
    """All derived tables of the protocol for one event log (lazy DataFrames)."""

    def __init__(self, events: DataFrame, buffer: str = "growing", counted: DataFrame | None = None):
        """``counted``: a frame with as many rows as ``events`` that is cheaper to count (the log
        before sessionization), so that the plan alone neither orders nor writes the log."""
        self.events = events
        self.counted = counted
        self.buffer = buffer
        self._segment_rows: dict[str, DataFrame] = {}

    # -- the event log with global positions: computed once, read by every branch ----
    @cached_property
    def base(self) -> DataFrame:
        cols = [EVENT_ID, "event_time", SESSION, ITEM]
        return materialize(event_positions(self.events.select(*cols)), "phase-base")

    # -- control tables: a few rows each, built once and materialized --------------
    @cached_property
    def sz(self) -> DataFrame:
        return materialize(sizes(self.base if self.counted is None else self.counted), "phase-sizes")

    # plan, draws and arrays are projections of the one-row ``sz`` table: cheap to
    # derive wherever they are used, so they stay lazy.
    @cached_property
    def plan(self) -> DataFrame:
        return phase_plan(self.sz)

    @cached_property
    def draws(self) -> DataFrame:
        d = replay_draws(self.sz, self.plan)
        if self.buffer == "frozen":
            d = d.filter(F.col("q") == 0)
        return d

    @cached_property
    def arrays(self) -> DataFrame:
        return _one_row_arrays(self.plan, self.draws)

    def plan_segs(self) -> DataFrame:
        return self._plan_segs

    @cached_property
    def _plan_segs(self) -> DataFrame:
        p = self.plan.crossJoin(F.broadcast(self.arrays.select("_bounds")))
        for c in ("train_start", "train_end", "test_start", "test_end"):
            p = p.withColumn(f"{c}_seg", _seg(c))
        return p.drop("_bounds")

    # -- pairs aggregated by segment ----------------------------------------------
    def segment_counts(self) -> DataFrame:
        return self._segment_counts

    @cached_property
    def _segment_counts(self) -> DataFrame:
        """Pairs → (seg_prev, seg_next, draw, prev, next, cnt), materialized: every phase,
        variant and test slice reads this aggregate instead of the raw pairs."""
        pr = positioned_pairs(self.base, positioned=True).crossJoin(F.broadcast(self.arrays))
        pr = pr.select("prev_item", "next_item", _seg("prev_pos").alias("seg_prev"),
                       _seg("next_pos").alias("seg_next"), _first_draw("next_pos").alias("draw"))
        agg = pr.groupBy("seg_prev", "seg_next", "draw", "prev_item", "next_item") \
            .agg(F.count(F.lit(1)).cast("bigint").alias("cnt"))
        return materialize(agg, "phase-segment-counts")

    @cached_property
    def positioned(self) -> DataFrame:
        """Events with global position and first replay draw (a projection of ``base``)."""
        ev = self.base.crossJoin(F.broadcast(self.arrays))
        return ev.withColumn("draw", _first_draw("pos")).drop("_bounds", "_draws")

    def train_counts(self, variant: str = "replay") -> DataFrame:
        """(phase, prev_item, next_item, cnt) — the transition model of every phase."""
        sc = self.segment_counts()
        ps = F.broadcast(self.plan_segs())
        in_window = (F.col("seg_prev") >= F.col("train_start_seg")) & (F.col("seg_next") < F.col("train_end_seg"))
        cond = in_window
        if variant == "replay":
            cond = in_window | ((F.col("phase") >= 1) & F.col("draw").isNotNull() & (F.col("draw") < F.col("phase")))
        j = sc.join(ps, cond, "inner")
        return j.groupBy("phase", "prev_item", "next_item").agg(F.sum("cnt").cast("bigint").alias("cnt"))

    def initial_counts(self) -> DataFrame:
        """(prev_item, next_item, cnt): the model of phase 0, which the static variant never refits."""
        first = F.broadcast(self.plan_segs().filter(F.col("phase") == 0))
        j = self.segment_counts().join(first, (F.col("seg_prev") >= F.col("train_start_seg"))
                                       & (F.col("seg_next") < F.col("train_end_seg")))
        return j.groupBy("prev_item", "next_item").agg(F.sum("cnt").cast("bigint").alias("cnt"))

    def test_counts(self) -> DataFrame:
        """(phase, prev_item, target, n) — test pairs with both events in the test slice."""
        sc = self.segment_counts()
        ps = F.broadcast(self.plan_segs())
        cond = (F.col("seg_prev") >= F.col("test_start_seg")) & (F.col("seg_next") < F.col("test_end_seg"))
        j = sc.join(ps, cond, "inner")
        return j.groupBy("phase", "prev_item", F.col("next_item").alias("target")) \
            .agg(F.sum("cnt").cast("bigint").alias("n"))

    # -- unit="row": the reference's replay ---------------------------------------------
    @cached_property
    def row_draws(self) -> DataFrame:
        """(event_id, draw): draw q keeps exactly ``buffer`` rows — the bottom ones by
        md5(seed, q, event_id) among rows before its bound; ``draw`` = first draw keeping
        the row. Rows are counted per draw and hash prefix (at most 65,536 counts a draw);
        later blocks go at the scan and only rows of a draw's boundary block are ranked."""
        ev = self.base.select(EVENT_ID, "pos")
        d = ev.join(F.broadcast(self.draws.select("q", "bound")), F.col("pos") < F.col("bound"))
        key = F.concat(F.lit(REPLAY_SEED), F.col("q").cast("string"), F.lit("|"), F.col(EVENT_ID).cast("string"))
        d = d.select(EVENT_ID, "q", F.md5(key).alias("_h")).withColumn("_hb", F.substring("_h", 1, 4))
        before = Window.partitionBy("q").orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
        blocks = d.groupBy("q", "_hb").agg(F.count(F.lit(1)).alias("_c"))
        blocks = blocks.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        # one row per draw: its last block that starts under the buffer, and the rows wanted of that block
        edge = blocks.crossJoin(F.broadcast(self.sz.select("buffer"))).filter(F.col("_before") < F.col("buffer")) \
            .groupBy("q").agg(F.max("_hb").alias("_edge"), F.min(F.col("buffer") - F.col("_before")).alias("_need"))
        d = d.join(F.broadcast(materialize(edge, "phase-draw-edges")), "q").filter(F.col("_hb") <= F.col("_edge"))
        place = F.row_number().over(Window.partitionBy("q", "_hb").orderBy("_h"))
        last = d.filter(F.col("_hb") == F.col("_edge")).withColumn("_r", place).filter(F.col("_r") <= F.col("_need"))
        kept = d.filter(F.col("_hb") < F.col("_edge")).select(EVENT_ID, "q").unionByName(last.select(EVENT_ID, "q"))
        return materialize(kept.groupBy(EVENT_ID).agg(F.min("q").alias("draw")), "phase-row-draws")

    def row_replay_counts(self) -> DataFrame:
        """(phase, prev_item, next_item, cnt): pairs rebuilt by ``lead`` over each phase's
        window ∪ buffer rows, so a buffer row may pair with a window row (Q27)."""
        base = self.base.join(self.row_draws, EVENT_ID, "left")
        p = F.broadcast(self.plan.select("phase", "train_start", "train_end"))
        win = base.join(p, (F.col("pos") >= F.col("train_start")) & (F.col("pos") < F.col("train_end")))
        buf = base.filter(F.col("draw").isNotNull()).join(
            F.broadcast(self.plan.filter(F.col("phase") >= 1).select("phase")), F.col("draw") < F.col("phase"))
        cols = ["phase", EVENT_ID, "event_time", SESSION, ITEM]
        rows = win.select(*cols).unionByName(buf.select(*cols))
        o = ordered_index(rows, ["phase", SESSION], ["event_time", EVENT_ID],
                          [("_blk", time_bucket("event_time", DEFAULT_BLOCK_SECONDS))], name="_rn",
                          next_of=[ITEM])
        o = o.filter(F.col(f"next_{ITEM}").isNotNull())
        return o.groupBy("phase", F.col(ITEM).alias("prev_item"), F.col(f"next_{ITEM}").alias("next_item")) \
            .agg(F.count(F.lit(1)).cast("bigint").alias("cnt"))

    def accuracy(self, variants=("window", "replay"), ks=DEFAULT_KS, tie: str = "item") -> DataFrame:
        """(phase, variant, k, n, hits, accuracy) for every phase and variant at once.
        Variants: ``window`` (no replay), ``replay`` (session draws), ``replay_rows`` (row draws),
        ``static`` (phase 0's model on every phase). A phase without test pairs has n = 0."""
        tests = keep_keys(self.test_counts(), self.plan.select("phase"))
        out = None
        for v in variants:
            if v == "static":
                r = target_ranks(tests, self.initial_counts(), None, max(ks), fill=False, tie=tie)
            else:
                model = self.row_replay_counts() if v == "replay_rows" else self.train_counts(v)
                r = target_ranks(tests, model, None, max(ks), keys=["phase"], fill=False, tie=tie)
            a = topk_accuracy(r, ks, keys=["phase"]).withColumn("variant", F.lit(v))
            out = a if out is None else out.unionByName(a)
        return out.select("phase", "variant", "k", "n", "hits", "accuracy")

    # -- row-level views --------------------------------------------------------------
    def positioned_events(self) -> DataFrame:
        return self.positioned

    def phase_events(self) -> DataFrame:
        """(phase, role, event_id) — range join of events with the plan (no replay)."""
        ev = self.positioned
        p = F.broadcast(self.plan)
        tr = ev.join(p, (F.col("pos") >= F.col("train_start")) & (F.col("pos") < F.col("train_end")))
        te = ev.join(p, (F.col("pos") >= F.col("test_start")) & (F.col("pos") < F.col("test_end")))
        return tr.select("phase", F.lit("train").alias("role"), EVENT_ID).unionByName(
            te.select("phase", F.lit("test").alias("role"), EVENT_ID))

    def replay_buffer(self) -> DataFrame:
        """(phase, event_id, phase_added) — the buffer each phase p ≥ 1 trains with."""
        ev = self.positioned_events().filter(F.col("draw").isNotNull())
        p = F.broadcast(self.plan.filter(F.col("phase") >= 1).select("phase"))
        return ev.join(p, F.col("draw") < F.col("phase")).select("phase", EVENT_ID, F.col("draw").alias("phase_added"))

    def train_rows(self) -> DataFrame:
        """(phase, source, event_id, …) — window rows UNION ALL buffer rows, by name."""
        ev = self.positioned_events()
        p = F.broadcast(self.plan)
        win = ev.join(p, (F.col("pos") >= F.col("train_start")) & (F.col("pos") < F.col("train_end"))) \
            .select("phase", F.lit("window").alias("source"), EVENT_ID, SESSION, ITEM)
        buf = ev.filter(F.col("draw").isNotNull()).join(
            F.broadcast(self.plan.filter(F.col("phase") >= 1).select("phase")), F.col("draw") < F.col("phase")) \
            .select("phase", F.lit("replay").alias("source"), EVENT_ID, SESSION, ITEM)
        return win.unionByName(buf)

    def train_stats(self) -> DataFrame:
        """Per phase, training rows, distinct items (= vocabulary size), sessions."""
        items = self.train_segments(ITEM).groupBy("phase").agg(
            F.sum("cnt").cast("bigint").alias("n_rows"), F.countDistinct(ITEM).cast("bigint").alias("n_items"))
        sessions = self.train_segments(SESSION).groupBy("phase").agg(
            F.countDistinct(SESSION).cast("bigint").alias("n_sessions"))
        return items.join(sessions, "phase")

    def train_stats_sketch(self, log2_size: int = 14) -> DataFrame:
        """L10/F3 from mergeable sketches: distinct counts of overlapping phases without counting again.

        One pass gives a row count and two HyperLogLog sketches per (segment, draw), a table of a few
        rows with at most 2 ** log2_size bytes a sketch; a phase is the union of its segments' sketches.
        The relative standard error is 1.04 / sqrt(2 ** log2_size), 0.8 % by default.
        """
        ev = self.base.crossJoin(F.broadcast(self.arrays))
        segs = ev.groupBy(_seg("pos").alias("seg"), _first_draw("pos").alias("draw")).agg(
            F.count(F.lit(1)).alias("cnt"), F.hll_sketch_agg(ITEM, F.lit(log2_size)).alias("items"),
            F.hll_sketch_agg(SESSION, F.lit(log2_size)).alias("sessions"))
        window = (F.col("seg") >= F.col("train_start_seg")) & (F.col("seg") < F.col("train_end_seg"))
        replay = (F.col("phase") >= 1) & F.coalesce(F.col("draw") < F.col("phase"), F.lit(False))
        j = materialize(segs, "phase-sketches").join(F.broadcast(self.plan_segs()), window | replay)
        return j.groupBy("phase").agg(
            F.sum(F.col("cnt") * (window.cast("int") + replay.cast("int"))).cast("bigint").alias("n_rows"),
            F.hll_sketch_estimate(F.hll_union_agg("items")).alias("n_items"),
            F.hll_sketch_estimate(F.hll_union_agg("sessions")).alias("n_sessions"))

    def segment_rows(self, column: str) -> DataFrame:
        """(seg, draw, column, cnt): events counted by segment before they meet the plan."""
        if column not in self._segment_rows:
            ev = self.base.crossJoin(F.broadcast(self.arrays))
            agg = ev.groupBy(_seg("pos").alias("seg"), _first_draw("pos").alias("draw"), column) \
                .agg(F.count(F.lit(1)).cast("bigint").alias("cnt"))
            self._segment_rows[column] = materialize(agg, f"phase-segments-{column}")
        return self._segment_rows[column]

    def train_segments(self, column: str) -> DataFrame:
        """(phase, column, cnt): the segments of window and buffer rows of every phase."""
        window = (F.col("seg") >= F.col("train_start_seg")) & (F.col("seg") < F.col("train_end_seg"))
        replay = (F.col("phase") >= 1) & F.coalesce(F.col("draw") < F.col("phase"), F.lit(False))
        j = self.segment_rows(column).join(F.broadcast(self.plan_segs()), window | replay)
        return j.select("phase", column, (F.col("cnt") * (window.cast("int") + replay.cast("int"))).alias("cnt"))

    def unknown_share(self) -> DataFrame:
        """per phase, share of test events / test targets unseen in its training rows."""
        known = self.train_segments(ITEM).select("phase", F.col(ITEM).alias("_item")).distinct().withColumn("_k", F.lit(1))
        te = self.segment_rows(ITEM).join(F.broadcast(self.plan_segs()), (F.col("seg") >= F.col("test_start_seg"))
                                          & (F.col("seg") < F.col("test_end_seg")))
        te = te.select("phase", F.col(ITEM).alias("_item"), "cnt").join(known, ["phase", "_item"], "left")
        ev_share = te.groupBy("phase").agg(
            F.sum("cnt").cast("bigint").alias("n_test_events"),
            (F.sum(F.when(F.col("_k").isNull(), F.col("cnt")).otherwise(0)).cast("double")
             / F.sum("cnt").cast("double")).alias("unknown_item_share"))
        tc = self.test_counts().select("phase", F.col("target").alias("_item"), "n").join(known, ["phase", "_item"], "left")
        pr_share = tc.groupBy("phase").agg(
            F.sum("n").cast("bigint").alias("n_test_pairs"),
            (F.sum(F.when(F.col("_k").isNull(), F.col("n")).otherwise(0)).cast("double")
             / F.sum("n").cast("double")).alias("unknown_target_share"))
        return ev_share.join(pr_share, "phase", "left")
