"""Time cutoffs, trailing windows, global positions and position slices
(B2, B3, B7, B8, F1, G4, H6, I6).

Data-derived bounds (max time, N) stay one-row DataFrames joined by broadcast —
a proven one-row size — instead of being collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.time import day_start, minus_days, time_bucket
from ..schema import EVENT_ID, EVENT_TIME, ITEM, SESSION, USER
from .ordered import ordered_index
from .ranges import range_index

POSITION_BLOCK_SECONDS = 3600


def max_time(events: DataFrame, out: str = "max_time") -> DataFrame:
    """one-row table with the global max of ``event_time``."""
    return events.agg(F.max(EVENT_TIME).alias(out))


def initial_cutoff(events: DataFrame, days: int = 14) -> DataFrame:
    """One row ``cutoff`` = midnight of (max time − days)."""
    m = max_time(events)
    return m.select(day_start(minus_days("max_time", days)).alias("cutoff"))


def before_cutoff(events: DataFrame, cutoff: DataFrame, col: str = "cutoff", inclusive: bool = True) -> DataFrame:
    """B2: ``event_time <= cutoff`` with the bound as a one-row broadcast."""
    j = events.crossJoin(F.broadcast(cutoff.select(col)))
    cond = F.col(EVENT_TIME) <= F.col(col) if inclusive else F.col(EVENT_TIME) < F.col(col)
    return j.filter(cond).drop(col)


def trailing_window(events: DataFrame, days: int) -> DataFrame:
    """Events with ``event_time >= max(event_time) − days`` (whole days)."""
    lo = max_time(events).select(minus_days("max_time", days).alias("_lo"))
    return events.crossJoin(F.broadcast(lo)).filter(F.col(EVENT_TIME) >= F.col("_lo")).drop("_lo")


def event_positions(events: DataFrame, block_seconds: int = POSITION_BLOCK_SECONDS,
                    name: str = "pos", next_of=()) -> DataFrame:
    """0-based global position along (event_time, event_id) — the file order of a
    time-sorted log — never one task over all rows: range blocks bounded by the whole key, so
    date-only times or one long hour are split by id. With ``next_of`` blocks are spans of time."""
    if not next_of:
        return range_index(events, [EVENT_TIME, EVENT_ID], pos=name, name="event-positions")
    return ordered_index(events, [], [EVENT_TIME, EVENT_ID],
                         [("_blk", time_bucket(EVENT_TIME, block_seconds))],
                         name=name, start=0, next_of=next_of)


def position_slice(positioned: DataFrame, a, b, col: str = "pos") -> DataFrame:
    """Rows with ``a <= pos < b``; a first-N ``limit`` is the slice [0, N)."""
    def c(x):
        return F.col(x) if isinstance(x, str) else F.lit(x)
    return positioned.filter((F.col(col) >= c(a)) & (F.col(col) < c(b)))


REFERENCE_COLUMNS = [EVENT_TIME, USER, ITEM, SESSION]


def slice_except_compat(positioned: DataFrame, a, b, col: str = "pos") -> DataFrame:
    """H6: prefix [0, b) EXCEPT DISTINCT prefix [0, a) on the log's own columns —
    the reference's slice. Repeated rows collapse; B7 is the sound form.
    ``a``/``b`` are ints or column names already on ``positioned``."""
    def c(x):
        return F.col(x) if isinstance(x, str) else F.lit(x)
    cols = REFERENCE_COLUMNS
    top = positioned.filter(F.col(col) < c(b)).select(*cols)
    low = positioned.filter(F.col(col) < c(a)).select(*cols)
    return top.subtract(low)
