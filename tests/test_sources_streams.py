"""Sources/sinks (A1, A2, A4, A5) and stream = batch (M1–M8) on the hand log (FIXTURES §3.5)."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from conftest import LOG, SF001
from seqdrift.config import scratch_path
from seqdrift.schema import EVENT_SCHEMA


def test_csv_by_header_with_utc_suffix(spark, tmp_path):
    p = tmp_path / "log.csv"
    p.write_text("event_time,event_type,product_id,category,user_id,user_session\n"
                 "2019-10-01 00:00:00 UTC,view,44600062,x,541312140,abc\n"
                 "2019-10-01 00:00:05 UTC,view,3900821,y,554748717,def\n"
                 "garbage,view,zz,y,1,ghi\n")
    from seqdrift.sources.files import read_events_csv
    df = read_events_csv(spark, str(p))
    assert df.columns == ["event_id", "event_time", "user_id", "product_id", "user_session"]
    r = sorted(df.collect(), key=lambda x: x.user_session)
    assert r[0].event_time == dt.datetime(2019, 10, 1) and r[0].product_id == 44600062
    assert r[2].event_time is None and r[2].product_id is None
    from seqdrift.sources.sinks import ingest_stats
    s = ingest_stats(df).first()
    assert (s.n_rows, s.null_items) == (3, 1)


def test_empty_and_metrics_sink(spark, tmp_path):
    from seqdrift.sources.files import empty_events
    from seqdrift.sources.sinks import append_metrics
    e = empty_events(spark)
    assert e.count() == 0 and e.schema == EVENT_SCHEMA
    m = spark.createDataFrame([("r1", 1, 0.5)], "run string, k int, accuracy double")
    out = str(tmp_path / "metrics")
    append_metrics(m, out)
    append_metrics(m.withColumn("run", F.lit("r2")), out)
    assert spark.read.parquet(out).count() == 2


def _write_batches(spark, batches):
    folder = scratch_path(spark, "fixture-stream")
    import time
    for rows in batches:
        spark.createDataFrame(rows, EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    return folder


def test_stream_dedup_and_late_rows(spark):
    from seqdrift.streaming.jobs import dedup_stream
    from seqdrift.streaming.staging import batch_time, read_stream, run_to_parquet
    late = (11, dt.datetime(2023, 12, 30, 10, 0), 9, 55, "late")  # 2 days behind the watermark
    batches = [LOG[:4], LOG[4:8] + [LOG[2]], LOG[8:] + [late],
               [(99, dt.datetime(2100, 1, 1), -1, -1, "-1")]]
    folder = _write_batches(spark, batches)
    out = batch_time(run_to_parquet(dedup_stream(read_stream(spark, folder, 1)), "t-dedup"))
    got = sorted(r.event_id for r in out.filter("event_id < 99").collect())
    assert got == list(range(1, 11))  # repeat removed, late row dropped


def test_stream_history_equals_batch_frames(spark):
    from seqdrift.streaming.jobs import history_stream
    from seqdrift.streaming.staging import read_stream, run_to_parquet
    folder = _write_batches(spark, [LOG[:3], LOG[3:7], LOG[7:]])
    out = run_to_parquet(history_stream(read_stream(spark, folder, 1), length=2), "t-hist")
    got = {(r.user_session, r.row_num): r.history for r in out.collect()}
    assert got[("s1", 4)] == "30,20" and got[("s2", 3)] == "30,10" and got[("s4", 1)] == "20"


def test_model_refresh_and_reservoir_equal_batch(spark):
    from seqdrift.operators.sampling import exact_sample
    from seqdrift.operators.sessions import session_pairs
    from seqdrift.operators.transitions import transition_model
    from seqdrift.streaming.jobs import ModelRefresh, ReplayReservoir
    from seqdrift.streaming.staging import read_stream, run_foreach_batch
    folder = _write_batches(spark, [LOG[:2], LOG[2:6], LOG[6:]])
    m = ModelRefresh(spark)
    run_foreach_batch(read_stream(spark, folder, 1), "t-model", m)
    log = spark.createDataFrame(LOG, EVENT_SCHEMA)
    want = sorted(map(tuple, transition_model(session_pairs(log)).collect()))
    assert sorted(map(tuple, m.model().select("prev_item", "next_item", "cnt").collect())) == want
    r = ReplayReservoir(spark, n=4, seed="x")
    run_foreach_batch(read_stream(spark, folder, 1), "t-res", r)
    assert {x.event_id for x in r.sample().collect()} == \
        {x.event_id for x in exact_sample(log, 4, seed="x").collect()}


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["k", "n", "hits", "accuracy"] and df.count() == 5
    assert set(E.oracle_sql()) <= set(E.queries())
    assert os.path.isdir(SF001)


def test_event_log_partition_pruning(spark, tmp_path):
    from seqdrift.sources.adapters import clicks
    from seqdrift.sources.sinks import read_event_log, write_event_log
    ev = clicks(spark, SF001)
    out = str(tmp_path / "log")
    write_event_log(ev, out, files=3)
    r = read_event_log(spark, out, until=dt.datetime(2024, 1, 10, 12, 0))
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "PushedFilters" in plan
    want = ev.filter(F.col("event_time") <= F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")).count()
    assert r.count() == want


def _model(rows):
    return {(r.prev_item, r.next_item): r.cnt for r in rows.collect()}


def test_model_refresh_takes_any_order_ids_and_redelivery(spark, log):
    """Late events take back the pair they split; negative ids count; a batch delivered twice is one."""
    from pyspark.sql import functions as F
    from seqdrift.operators.sessions import session_pairs
    from seqdrift.operators.transitions import transition_model
    from seqdrift.streaming.jobs import ModelRefresh, ReplayReservoir
    ev = log.withColumn("event_id", F.col("event_id") - 100)
    want = _model(transition_model(session_pairs(ev)))
    late, rest = ev.where("event_id in (-98, -94)"), ev.where("event_id not in (-98, -94)")
    m = ModelRefresh(spark)
    for b, part in ((0, rest), (1, late), (1, late), (0, rest), (1, late)):
        m(part, b)
    assert _model(m.model()) == want
    again = ModelRefresh(spark, root=m.root)  # a driver that starts anew goes on from the stored state
    again(ev.limit(0), 2)
    assert _model(again.model()) == want
    r = ReplayReservoir(spark, n=4)
    for b, part in ((0, rest), (1, late), (1, late)):
        r(part, b)
    whole = ReplayReservoir(spark, n=4)
    whole(ev, 0)
    assert sorted(r.sample().collect()) == sorted(whole.sample().collect())


def test_ingest_drops_counts_what_adapters_drop(spark, log):
    from pyspark.sql import functions as F
    from seqdrift.sources.sinks import ingest_drops
    bad = log.withColumn("product_id", F.when(F.col("event_id") > 2, F.col("product_id"))) \
        .withColumn("user_id", F.when(F.col("event_id") != 2, F.col("user_id")))
    assert tuple(ingest_drops(bad).first()) == (10, 0, 1, 2, 2, 8)


def test_recommend_stream_answers_unseen_items(spark, log):
    from seqdrift.streaming.jobs import recommend_stream
    recs = spark.createDataFrame([(10, 1, 20, 3), (10, 2, 30, 1), (None, 1, 20, 0)],
                                 "prev_item bigint, rank bigint, item bigint, score bigint")
    got = sorted((r.event_id, r.rank, r.item) for r in recommend_stream(log, recs).collect())
    want = [(r.event_id, k, i) for r in log.collect() for k, i in ([(1, 20), (2, 30)] if r.product_id == 10 else [(1, 20)])]
    assert got == sorted(want)
    known = recommend_stream(log, recs.where("prev_item is not null")).collect()
    assert {r.product_id for r in known} == {10} and len(known) == 4


def test_session_refresh_takes_late_and_repeated_batches(spark, log):
    from seqdrift.operators import sessions as S
    from seqdrift.streaming.jobs import SessionRefresh
    m = SessionRefresh(spark, lambda e: S.history_windows(S.session_rows(e), 2))
    for b, cond in ((0, "event_id in (1, 4, 7)"), (1, "event_id in (3, 5, 10)"), (1, "event_id in (3, 5, 10)"),
                    (2, "event_id in (2, 6, 8, 9)")):
        m(log.where(cond), b)
    got = {(r.user_session, r.row_num): list(r.history) for r in m.result().collect()}
    assert got == {("s1", 1): [10], ("s1", 2): [10, 20], ("s1", 3): [20, 30], ("s1", 4): [30, 20],
                   ("s2", 1): [20], ("s2", 2): [20, 30], ("s2", 3): [30, 10],
                   ("s3", 1): [9], ("s3", 2): [9, 100], ("s4", 1): [20]}


def test_csv_with_a_stated_schema(spark, tmp_path):
    """The stated schema gives the rows of the plain reader; a header in another order is an error."""
    from seqdrift.schema import RAW_CSV_SCHEMA
    from seqdrift.sources.files import read_events_csv
    names = [f.name for f in RAW_CSV_SCHEMA]
    values = {"event_time": "2019-10-01 00:00:00 UTC", "product_id": "7", "user_id": "8", "user_session": "abc", "event_id": "9"}
    for name, order in (("same", names), ("other", names[::-1])):
        (tmp_path / f"{name}.csv").write_text(",".join(order) + "\n" + ",".join(values[c] for c in order) + "\n")
    same = str(tmp_path / "same.csv")
    assert read_events_csv(spark, same, schema=RAW_CSV_SCHEMA).collect() == read_events_csv(spark, same).collect()
    with pytest.raises(Exception, match="(?i)header"):
        read_events_csv(spark, str(tmp_path / "other.csv"), schema=RAW_CSV_SCHEMA).collect()
