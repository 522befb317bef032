"""FIXTURES §3.1: hand log → vocabulary, pairs, histories, follow stats, recommendations, Top-K."""

from pyspark.sql import functions as F

from seqdrift.functions.arrays import clamp_ids, left_pad
from seqdrift.operators import sessions as S
from seqdrift.operators import transitions as J
from seqdrift.operators import vocab as D


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_vocabulary_frequency_then_text(log):
    v = D.fit_vocab(log, "product_id")
    assert rows(v, "item", "idx", "freq") == sorted([(20, 0, 4), (10, 1, 2), (30, 2, 2), (100, 3, 1), (9, 4, 1)])


def test_encode_unknown_policies(spark, log):
    v = D.fit_vocab(log, "product_id")
    probe = spark.createDataFrame([(77,), (20,), (None,)], "product_id bigint")
    keep = D.encode(probe, v, "product_id", "idx", unknown="keep")
    assert sorted((r.product_id, r.idx) for r in keep.collect() if r.product_id is not None) == [(20, 0), (77, 5)]
    assert [r.idx for r in keep.collect() if r.product_id is None] == [5]
    m1 = D.encode(probe, v, "product_id", "idx", unknown="minus_one")
    assert sorted((r.product_id or 0, r.idx) for r in m1.collect()) == [(0, -1), (20, 0), (77, -1)]
    dec = D.decode(keep, v, "idx", "back")
    assert sorted((r.idx, r.back) for r in dec.collect() if r.product_id == 20) == [(0, 20)]


def test_pairs_default_and_compat(log):
    p = S.session_pairs(log)
    assert rows(p, "user_session", "prev_item", "next_item") == sorted([
        ("s1", 10, 20), ("s1", 20, 30), ("s1", 30, 20), ("s2", 20, 30), ("s2", 30, 10), ("s3", 9, 100)])
    c = S.session_pairs(log, compat=True)
    assert rows(c, "user_session", "prev_item", "next_item") == sorted([
        ("s1", 10, 20), ("s1", 20, 30), ("s2", 20, 30)])


def test_histories_and_padding(log):
    h = S.history_pairs(log, 2)
    got = sorted((r.user_session, tuple(r.history), r.target) for r in h.collect())
    assert got == sorted([("s1", (10,), 20), ("s1", (10, 20), 30), ("s1", (20, 30), 20),
                          ("s2", (20,), 30), ("s2", (20, 30), 10), ("s3", (9,), 100)])
    h3 = S.history_pairs(log, 3).select(left_pad(F.col("history"), 3, -1).alias("p"))
    assert sorted(tuple(r.p) for r in h3.collect()) == sorted([
        (-1, -1, 10), (-1, 10, 20), (10, 20, 30), (-1, -1, 20), (-1, 20, 30), (-1, -1, 9)])


def test_clamp_and_truncate(spark):
    df = spark.createDataFrame([([3, -1, 7, 1, 2],)], "h array<bigint>")
    r = df.select(left_pad(clamp_ids(F.col("h"), 5), 3, 0).alias("x")).first().x
    assert r == [0, 1, 2]
    assert df.select(left_pad(F.col("h"), 7, -9).alias("x")).first().x == [-9, -9, 3, -1, 7, 1, 2]


def test_follow_stats(log):
    p = S.session_pairs(log)
    f = J.follow_stats(p, top_k=5, min_support=1)
    assert rows(f, "prev_item", "item", "support", "confidence", "rank") == sorted([
        (10, 20, 1, 1.0, 1), (20, 30, 2, 1.0, 1), (30, 10, 1, 0.5, 1), (30, 20, 1, 0.5, 2), (9, 100, 1, 1.0, 1)])
    f2 = J.follow_stats(p, top_k=5, min_support=2)
    assert rows(f2, "prev_item", "item", "support", "confidence", "rank") == [(20, 30, 2, 1.0, 1)]


def _lists(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.prev_item, []).append((r.rank, r.item))
    return {k: [i for _, i in sorted(v)] for k, v in out.items()}


def test_recommend_fill_and_exclude(spark, log):
    p = S.session_pairs(log)
    m = J.transition_model(p)
    v = D.fit_vocab(log, "product_id")
    lists = _lists(J.recommend_topk(m, v, k=2, fill=True, tie="idx"))
    assert lists[10] == [20, 10] and lists[20] == [30, 20] and lists[30] == [20, 10]
    assert lists[9] == [100, 20] and lists[None] == [20, 10]
    ex = spark.createDataFrame([(20,)], "item bigint")
    lx = _lists(J.recommend_topk(m, v, k=2, fill=True, tie="idx", exclude=ex))
    assert lx[10] == [10, 30] and lx[30] == [10, 30]


def test_topk_on_training_pairs(log):
    p = S.session_pairs(log)
    m = J.transition_model(p)
    v = D.fit_vocab(log, "product_id")
    r = J.target_ranks(J.aggregate_tests(p), m, v, 2, fill=True, tie="idx")
    acc = {x.k: (x.hits, x.n) for x in J.topk_accuracy(r, (1, 2)).collect()}
    assert acc == {1: (5, 6), 2: (6, 6)}


def test_fill_rank_matches_materialised_lists(log):
    """The closed-form fill rank equals the position in the materialised list."""
    p = S.session_pairs(log)
    m = J.transition_model(p)
    v = D.fit_vocab(log, "product_id")
    k = 5
    lists = _lists(J.recommend_topk(m, v, k=k, fill=True, tie="idx"))
    tests = p.select("prev_item", F.col("next_item").alias("target"), F.lit(1).cast("bigint").alias("n"))
    for r in J.target_ranks(tests, m, v, k, fill=True, tie="idx").collect():
        lst = lists.get(r.prev_item, lists[None])
        want = lst.index(r.target) + 1 if r.target in lst else None
        assert r.rank == want, (r.prev_item, r.target, r.rank, want)


def test_recommend_history_weights(spark, log):
    p = S.session_pairs(log)
    m = J.transition_model(p)
    h = spark.createDataFrame([("q", [10, 30])], "user_session string, history array<bigint>")
    r = J.recommend_history(h, m, length=2, k=3)
    # weights: 30 (newest) → 2, 10 → 1; scores 20: 1*1 + 2*1 = 3, 10: 2*1 = 2
    assert [(x.item, x.score) for x in r.orderBy("rank").collect()] == [(20, 3), (10, 2)]
