"""M2 with an account: every row sent is kept, repeated or late, and late rows go to a side table.

A batch's watermark is the latest event time of all batches before it less the delay; the first has
none. Rows at or behind it, and rows without a time, are late. Of the others the earliest of an id is
kept (ties by the other columns, nulls first), unless a row of that id was kept before and is still open: its time plus
the delay lies after the watermark. The rest are repeated. Null ids are one id.

A batch reads the kept ids of open batches only (what the watermark has passed is never read again), and
its tables count once its commit record stands, so a batch delivered again leaves one result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.time import MICROS_PER_SECOND, epoch_micros
from ..schema import EVENT_ID, EVENT_TIME
from .commits import commit, committed, read_committed

ACCOUNT = ("batch_id bigint, sent bigint, kept bigint, late bigint, repeated bigint, "
           "max_us bigint, kept_max_us bigint, open_from bigint")


class LateAccount:
    """foreachBatch sink; ``kept()``, ``late()`` and ``account()`` give what committed batches hold."""

    def __init__(self, spark, root: str, delay_seconds: int = 86_400):
        self.spark, self.root, self.delay = spark, root, delay_seconds * MICROS_PER_SECOND

    def _past(self, batch_id: int) -> list:
        """Account rows of the open batches, the last one included: as many as lie within the delay."""
        done = committed(self.spark, self.root, before=batch_id)
        if not done:
            return []
        last = self._rows(done[-1:])[0]
        return self._rows([i for i in done if i >= last["open_from"]])

    def _rows(self, ids: list[int]) -> list:
        paths = [f"{self.root}/account/batch_id={i}" for i in ids]
        return sorted(self.spark.read.parquet(*paths).collect(), key=lambda r: r["id"])

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        past = self._past(batch_id)
        newest = past[-1]["max_us"] if past else None
        mark = None if newest is None else newest - self.delay
        us = epoch_micros(F.col(EVENT_TIME).cast("timestamp_ntz"))
        rows = batch.select(*batch.columns, us.alias("__us"))
        behind = F.col("__us").isNull() if mark is None else F.col("__us").isNull() | (F.col("__us") <= mark)
        rows = rows.withColumn("__late", behind)
        sums = rows.agg(F.count(F.lit(1)).alias("sent"), F.count_if("__late").alias("late"), F.max("__us").alias("max_us")).first()
        rows.filter("__late").select(*batch.columns).write.mode("overwrite").parquet(f"{self.root}/late/batch_id={batch_id}")

        # the earliest row of an id by a partial aggregate: an id sent a million times is one row a task
        others = [c for c in batch.columns if c != EVENT_ID]
        first = rows.filter(~F.col("__late")).groupBy(EVENT_ID).agg(F.min(F.struct("__us", *others)).alias("__r"))
        kept = first.select(EVENT_ID, "__r.*")
        still = [r["id"] for r in past if r["kept_max_us"] is not None and r["kept_max_us"] + self.delay > mark]
        if still:
            paths = [f"{self.root}/kept/batch_id={i}" for i in still]
            seen = self.spark.read.parquet(*paths).filter(F.col("__us") + F.lit(self.delay) > F.lit(mark)) \
                .select(F.col(EVENT_ID).alias("__id"))
            kept = kept.join(seen, F.col(EVENT_ID).eqNullSafe(F.col("__id")), "left_anti")
        target = f"{self.root}/kept/batch_id={batch_id}"
        kept.select(*batch.columns, "__us").write.mode("overwrite").parquet(target)

        new = self.spark.read.parquet(target).agg(F.count(F.lit(1)).alias("n"), F.max("__us").alias("m")).first()
        times = [t for t in (newest, sums["max_us"]) if t is not None]
        top = max(times) if times else None
        open_ids = [i for i, m in [(r["id"], r["kept_max_us"]) for r in past] + [(batch_id, new["m"])]
                    if m is not None and m + self.delay > top - self.delay]
        row = (batch_id, sums["sent"], new["n"], sums["late"], sums["sent"] - sums["late"] - new["n"], top, new["m"],
               min(open_ids, default=batch_id))
        self.spark.createDataFrame([row], ACCOUNT).withColumnRenamed("batch_id", "id") \
            .write.mode("overwrite").parquet(f"{self.root}/account/batch_id={batch_id}")
        commit(self.spark, self.root, batch_id)

    def kept(self) -> DataFrame | None:
        rows = read_committed(self.spark, self.root, "kept")
        return None if rows is None else rows.drop("__us")

    def late(self) -> DataFrame | None:
        return read_committed(self.spark, self.root, "late")

    def account(self) -> DataFrame | None:
        """(batch_id, sent, kept, late, repeated), kept + late + repeated = sent."""
        rows = read_committed(self.spark, self.root, "account")
        return None if rows is None else rows.select(F.col("id").alias("batch_id"), "sent", "kept", "late", "repeated")


__all__ = ["LateAccount"]
