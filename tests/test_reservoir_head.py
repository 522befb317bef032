"""The reservoir compares only rows that it can draw, repeats included."""

from pyspark.sql import functions as F

from seqdrift.operators import sampling as C
from seqdrift.streaming.jobs import ReplayReservoir


def _ids(df):
    return sorted(r["event_id"] for r in df.collect())


def test_head_holds_the_sample_of_the_distinct_rows(spark):
    """Every row three times, the first of the hash order a thousand times; more rows asked for than there are; none."""
    ids = spark.range(4000).select(F.col("id").alias("event_id"), F.lit("s").alias("user_session"))
    first = ids.orderBy(F.md5(F.concat(F.lit("x"), F.col("event_id").cast("string")))).limit(1).crossJoin(spark.range(1000)).drop("id")
    rows = ids.unionByName(ids).unionByName(ids).unionByName(first)
    by = ["event_id", "user_session"]
    for n in (0, 1, 50, 3999, 4000, 9000):
        head = C.distinct_head(rows, n, by, seed="x")
        assert _ids(C.exact_sample(head, n, seed="x")) == _ids(C.exact_sample(ids, n, seed="x"))
    assert C.distinct_head(rows, 50, by, seed="x").count() < 400
    assert C.distinct_head(rows.limit(0), 5, by).count() == 0


def test_reservoir_compares_few_rows(spark, monkeypatch, tmp_path):
    compared = []

    def counted(df, *args, **kw):
        compared.append(df.count())
        return C.exact_sample(df, *args, **kw)

    monkeypatch.setattr("seqdrift.streaming.jobs.exact_sample", counted)
    log = spark.range(20_000).select(F.col("id").alias("event_id"), F.lit("2024-01-01").cast("timestamp").alias("event_time"),
                                     F.lit(1).cast("bigint").alias("user_id"), F.lit(2).cast("bigint").alias("product_id"),
                                     (F.col("id") % 7).cast("string").alias("user_session"))
    r = ReplayReservoir(spark, n=30, seed="x", root=str(tmp_path / "r"))
    for b in (0, 1, 1):
        r(log.unionByName(log.limit(500)), b)
    assert _ids(r.sample()) == _ids(C.exact_sample(log, 30, seed="x")) and max(compared) < 200
