"""The account of late and repeated rows against a row-by-row evaluation."""

import datetime as dt
import random

import pytest

from seqdrift.config import scratch_path
from seqdrift.schema import EVENT_SCHEMA
from seqdrift.streaming.late import LateAccount
from seqdrift.streaming.staging import read_stream, run_foreach_batch, stage_batches

START = dt.datetime(2024, 1, 1)
DELAY = 3600


def _expected(batches):
    newest, open_rows, out = None, {}, []
    delay = dt.timedelta(seconds=DELAY)
    for rows in batches:
        mark = None if newest is None else newest - delay
        late = [r for r in rows if r[1] is None or (mark is not None and r[1] <= mark)]
        fresh = {}
        for r in sorted((r for r in rows if r not in late), key=lambda r: (r[1], r[2], r[3])):
            fresh.setdefault(r[0], r)
        kept = [r for i, r in fresh.items() if not any(mark is not None and t + delay > mark for t in open_rows.get(i, []))]
        for r in kept:
            open_rows.setdefault(r[0], []).append(r[1])
        times = [r[1] for r in rows if r[1] is not None] + ([newest] if newest else [])
        newest = max(times) if times else None
        out.append((len(rows), len(kept), len(late), len(rows) - len(late) - len(kept)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_account_by_row(spark, seed):
    rng = random.Random(seed)
    batches = [[]]  # an empty batch first
    for b in range(4):
        rows = []
        for _ in range(40):
            t = None if rng.random() < 0.05 else START + dt.timedelta(minutes=40 * b + rng.randrange(-120, 60))
            rows.append((rng.choice([None, *range(25)]), t, rng.randrange(3), rng.randrange(5), "s"))
        batches.append(rows)
    root = scratch_path(spark, "late-test")
    for i, rows in enumerate(batches):
        for _ in range(2 if i % 2 else 1):  # delivered again, by a job that starts again
            LateAccount(spark, root, DELAY)(spark.createDataFrame(rows, EVENT_SCHEMA), i)
    job = LateAccount(spark, root, DELAY)
    got = [tuple(r)[1:] for r in sorted(job.account().collect())]
    assert got == _expected(batches)
    assert job.kept().count() == sum(r[1] for r in got) and job.late().count() == sum(r[2] for r in got)


def test_batches_passed_by_the_watermark_are_not_read(spark):
    root = scratch_path(spark, "late-open")
    job = LateAccount(spark, root, DELAY)
    for i in range(4):
        job(spark.createDataFrame([(7, START + dt.timedelta(days=i), 1, 1, "s")], EVENT_SCHEMA), i)
    assert [r["id"] for r in job._past(4)] == [3]
    # a batch is judged by the watermark before it: the row of the last batch is still open, the one before has expired
    assert [tuple(r) for r in sorted(job.account().collect())] == [(i, 1, 1 - i % 2, 0, i % 2) for i in range(4)]


def test_as_a_stream(spark, log):
    folder, per = stage_batches(log, n_batches=2, overlap_seconds=120)
    job = LateAccount(spark, scratch_path(spark, "late-stream"))
    run_foreach_batch(read_stream(spark, folder, per), "late-stream", job)
    assert sorted(r["event_id"] for r in job.kept().collect()) == list(range(1, 11))
    assert all(r["kept"] + r["late"] + r["repeated"] == r["sent"] for r in job.account().collect())
