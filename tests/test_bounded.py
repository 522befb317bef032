"""Bounded recommendation against the full one and against plain computation."""

import random

import pytest

from seqdrift.operators import bounded as B, transitions as J

HISTORY = "user_session string, history array<bigint>"
MODEL = "prev_item bigint, next_item bigint, cnt bigint"
VOCAB = "item bigint, idx bigint"


def _plain(histories, model, length, k, idx):
    out = {}
    for key, history in histories:
        score = {}
        for d, prev in enumerate(reversed((history or [])[-length:])):
            for p, item, cnt in model:
                if p == prev:
                    score[item] = score.get(item, 0) + (length - d) * cnt
        best = sorted(score, key=lambda i: (-score[i], idx.get(i, 1 << 60), i))[:k]
        out[key] = [(r, i, score[i]) for r, i in enumerate(best, 1)]
    return {key: rows for key, rows in out.items() if rows}


def _rows(answers):
    out = {}
    for r in sorted(answers.collect(), key=lambda r: (r["user_session"], r["rank"])):
        out.setdefault(r["user_session"], []).append((r["rank"], r["item"], r["score"]))
    return out


@pytest.mark.parametrize("shape", ["skewed", "equal", "ties"])
def test_by_brute_force(spark, shape):
    """Counts that fall fast, counts that are all one, and few different counts: the same rows each time."""
    rng = random.Random(shape)
    count = {"skewed": lambda: int(rng.paretovariate(0.7)), "equal": lambda: 1, "ties": lambda: rng.choice([1, 2, 4, 8])}[shape]
    model = [(p, i, count()) for p in range(12) for i in rng.sample(range(40), rng.choice([1, 3, 15, 39]))]
    histories = [(f"s{n}", [rng.randrange(14) for _ in range(rng.randrange(0, 9))]) for n in range(60)]
    idx = {i: n for n, i in enumerate(rng.sample(range(40), 35))}
    h, m = spark.createDataFrame(histories, HISTORY), spark.createDataFrame(model, MODEL)
    v = spark.createDataFrame(list(idx.items()), VOCAB)
    for length, k in ((5, 3), (8, 10)):
        got = B.recommend_history_bounded(h, B.follower_blocks(m, k), length, k, tie_vocab=v)
        assert _rows(got.answers) == _plain(histories, model, length, k, idx)
    got = B.recommend_history_bounded(h, B.follower_blocks(m, 3), 5, 3)
    assert _rows(got.answers) == _plain(histories, model, 5, 3, {})


def test_reads_a_small_share(spark):
    """Of histories times items times followers, under a tenth is joined when counts fall as they do in logs."""
    rng = random.Random(3)
    model = [(p, i, 1 + 4000 // (r + 1)) for p in range(20) for r, i in enumerate(rng.sample(range(2000), 1500))]
    histories = [(f"s{n}", [rng.randrange(20) for _ in range(6)]) for n in range(40)]
    h, m = spark.createDataFrame(histories, HISTORY), spark.createDataFrame(model, MODEL)
    got = B.recommend_history_bounded(h, B.follower_blocks(m, 5), 6, 5)
    assert _rows(got.answers) == _rows(J.recommend_history(h, m, length=6, k=5))
    lists = got.lists.count()
    joined = lists * 5 + got.from_blocks.count() + got.looked_up.count()
    assert joined < 0.1 * lists * 1500


def test_odd_input(spark):
    """Empty tables, null and empty histories, null and unseen items, repeated keys, excluded items, long lists of one."""
    m = spark.createDataFrame([(1, i, 100 - i) for i in range(30)] + [(2, 5, 7)], MODEL)
    odd = spark.createDataFrame([("a", None), ("b", []), ("c", [None, 1]), ("d", [99]), ("e", [2] * 50), ("e", [2] * 50)], HISTORY)
    got = _rows(B.recommend_history_bounded(odd, B.follower_blocks(m, 3), 4, 3).answers)
    assert got == {"c": [(1, 0, 400), (2, 1, 396), (3, 2, 392)], "e": [(1, 5, 70), (1, 5, 70)]}
    gone = spark.createDataFrame([(0,), (2,)], "item bigint")
    got = _rows(B.recommend_history_bounded(odd, B.follower_blocks(m, 3, gone), 4, 3).answers)
    assert got["c"] == [(1, 1, 396), (2, 3, 388), (3, 4, 384)]
    assert B.recommend_history_bounded(odd, B.follower_blocks(m.limit(0), 3), 4, 3).answers.count() == 0
    assert B.recommend_history_bounded(odd.limit(0), B.follower_blocks(m, 3), 4, 3).answers.count() == 0
    with pytest.raises(ValueError):
        B.recommend_history_bounded(odd, B.follower_blocks(m, 3), 63, 3)
