"""Co-occurrence counts, their factors and the alignment of embedding spaces against plain computation."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqdrift.operators import factors as X


def _pairs(spark, m):
    n = len(m)
    rows = [(i, j, float(m[i, j])) for i in range(n) for j in range(n) if m[i, j]]
    return spark.createDataFrame(rows, "item bigint, context bigint, weight double")


def _matrix(vectors, n):
    out = {r["item"]: r["vector"] for r in vectors.collect()}
    return np.array([out[i] for i in range(n)])


@pytest.mark.parametrize("window", [1, 2, 5])
def test_counts_by_brute_force(spark, log, window):
    sessions = {}
    for r in sorted(log.collect(), key=lambda r: (r["event_time"], r["event_id"])):
        sessions.setdefault(r["user_session"], []).append(r["product_id"])
    want = Counter((a, b) for s in sessions.values() for i, a in enumerate(s) for j, b in enumerate(s)
                   if i != j and abs(i - j) <= window)
    got = {(r["item"], r["context"]): r["n"] for r in X.cooccurrence(log, window).collect()}
    assert got == dict(want)


def test_long_session_has_every_context(spark, log):
    """One session of 60 events: no context is cut at a chunk edge, an item beside itself counts twice."""
    first = log.first().asDict()
    ev = spark.range(60).select(F.col("id").alias("event_id"), F.lit(first["event_time"]).cast("timestamp_ntz").alias("event_time"),
                                F.lit(1).cast("bigint").alias("user_id"), F.lit(7).cast("bigint").alias("product_id"),
                                F.lit("s").alias("user_session"))
    assert X.cooccurrence(ev, 5).first()["n"] == 2 * sum(min(5, i) for i in range(60))


def test_empty_and_null(spark, log):
    assert X.ppmi(X.cooccurrence(log.limit(0))).count() == 0
    vectors, signs = X.factorise(X.ppmi(X.cooccurrence(log.limit(0))), dim=4, extra=2)
    assert vectors.count() == 0 and signs == []
    gap = log.withColumn("product_id", F.when(F.col("event_id") != 2, F.col("product_id")))
    got = {(r["item"], r["context"]): r["n"] for r in X.cooccurrence(gap, 1).filter("item in (10, 30)").collect()}
    assert got == {(30, 20): 2, (30, 10): 1, (10, 30): 1}  # 10 and 30 of s1 stay two rows apart


def test_factors_near_the_best_of_their_rank(spark):
    rng = np.random.default_rng(1)
    n, dim = 60, 6
    a = rng.normal(size=(n, dim)) * np.array([9, 8, 7, 6, 5, 4])
    noise = rng.normal(size=(n, n)) * 0.3
    m = a @ np.diag([1, -1, 1, 1, -1, 1]) @ a.T + noise + noise.T
    vectors, signs = X.factorise(_pairs(spark, np.abs(m)), dim=dim)
    u = _matrix(vectors, n)
    assert u.shape == (n, dim)
    m = np.abs(m)
    values = np.linalg.eigvalsh(m)
    best = np.sqrt(np.sort(values ** 2)[:-dim].sum())
    assert np.linalg.norm(m - (u * signs) @ u.T) <= 1.05 * best


def test_low_rank_is_exact(spark):
    a = np.arange(1, 11, dtype=float)
    m = np.outer(a, a)
    vectors, signs = X.factorise(_pairs(spark, m), dim=4)
    u = _matrix(vectors, 10)
    assert np.abs((u * signs) @ u.T - m).max() < 1e-6


def test_rotated_copy_is_recovered(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(40, 5))
    turn, _ = np.linalg.qr(rng.normal(size=(5, 5)))
    def frame(x, ids):
        return spark.createDataFrame([(int(i), [float(y) for y in x[i]]) for i in ids], X.VECTORS)
    got = _matrix(X.align(frame(v, range(40)), frame(v @ turn, range(8, 40)), 5), 40)
    assert np.abs(got - v @ turn).max() < 1e-6


def test_new_items_among_their_neighbours(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], X.VECTORS)
    pairs = spark.createDataFrame([(3, 1, 3.0), (3, 2, 1.0), (4, 3, 1.0), (1, 2, 9.0)], "item bigint, context bigint, weight double")
    got = {r["item"]: r["vector"] for r in X.place_new(vectors, pairs).collect()}
    assert got == {1: [1.0, 0.0], 2: [0.0, 1.0], 3: pytest.approx([0.75, 0.25])}
