"""Recommendation from a whole history with bounds (J3): exact top-k without expanding every follower.

A history item's followers form a list in the order of their counts. Instead of joining every list in
full, three steps read only what can still reach rank k (a uniform-threshold scheme over integer scores):

1. *Heads*: the k first followers of every history item. The k-th best sum so far is a lower bound.
2. *Blocks*: what is left of a list lies in blocks by powers of two of the count, each with its largest
   count. A threshold is chosen per history so that an item below it in every list can't reach the
   lower bound; blocks whose largest count stays below are not joined at all.
3. *Look-ups*: an item whose sum, with the most that its unread lists could add, still reaches the k-th
   best sum is looked up in those lists by (item, follower).

Every step is an equi-join or a partial aggregate, heads hold k rows, a history at most ``length`` lists.
Results equal ``transitions.recommend_history`` row by row, ties included: what is passed over has a score
strictly below the k-th. When all counts are alike the bounds pass nothing over and all lists are read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import materialize


class Followers(NamedTuple):
    """``heads``: prev_item, head (its k first followers), blocks (level, top), rest_top; ``rest``: the followers after them."""

    heads: DataFrame
    rest: DataFrame


class Bounded(NamedTuple):
    """The ranked answers and the rows that each step joined (written tables, to be counted)."""

    answers: DataFrame
    lists: DataFrame
    from_blocks: DataFrame
    looked_up: DataFrame


def _level(count: Column) -> Column:
    """Position of the highest set bit."""
    return F.length(F.bin(count)) - 1


def follower_blocks(model: DataFrame, k: int = 10, exclude: DataFrame | None = None) -> Followers:
    """Heads and blocks of a (prev_item, next_item, cnt) model; ``exclude`` is a small id table.

    Counts are positive. The rank filter keeps partial lists of k before the shuffle; the rest is what
    comes after a full head's last row, so no list is sorted whole.
    """
    m = model.filter(F.col("cnt") > 0).select("prev_item", F.col("next_item").alias("item"), "cnt")
    if exclude is not None:
        m = m.join(exclude.select("item"), "item", "left_anti").select("prev_item", "item", "cnt")
    m = materialize(m, "bounded-model")
    w = Window.partitionBy("prev_item").orderBy(F.col("cnt").desc(), F.col("item").asc())
    first = m.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    head = first.groupBy("prev_item").agg(F.collect_list(F.struct("item", "cnt")).alias("head"),
                                          F.max(F.struct(-F.col("cnt"), "item")).alias("_last"))
    head = materialize(head, "bounded-head")
    full = head.filter(F.size("head") == k).select(
        "prev_item", (-F.col("_last.col1")).alias("_c"), F.col("_last.item").alias("_i"))
    after = (F.col("cnt") < F.col("_c")) | ((F.col("cnt") == F.col("_c")) & (F.col("item") > F.col("_i")))
    rest = materialize(m.join(full, "prev_item").filter(after)
                       .select("prev_item", "item", "cnt", _level(F.col("cnt")).alias("level")), "bounded-rest")
    tops = rest.groupBy("prev_item", "level").agg(F.max("cnt").alias("top")) \
        .groupBy("prev_item").agg(F.collect_list(F.struct("level", "top")).alias("blocks"),
                                  F.max("top").alias("rest_top"))  # at most 63 levels
    heads = head.drop("_last").join(tops, "prev_item", "left").withColumn("rest_top", F.coalesce("rest_top", F.lit(0)))
    return Followers(materialize(heads, "bounded-heads"), rest)


def _kth(sums: DataFrame, k: int) -> DataFrame:
    """(_tail, _kth): the k-th largest score of every tail, 0 where there are fewer."""
    w = Window.partitionBy("_tail").orderBy(F.col("score").desc())
    top = sums.select("_tail", "score").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    return top.groupBy("_tail").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_m")).select(
        "_tail", F.when(F.col("_n") == k, F.col("_m")).otherwise(F.lit(0)).alias("_kth"))


def _unread(tops: Column, bound: Column) -> Column:
    """The largest x for which Σ min(x, top) stays below ``bound``; null if the tops themselves do.

    With the tops in ascending order the sum is the least, over i, of the i first tops plus x for each
    other one, so x is the largest of the quotients, one per i.
    """
    n, asc = F.size(tops), F.sort_array(tops)
    start = F.struct((bound - 1).cast("bigint").alias("left"), F.lit(0).alias("i"), F.lit(0).cast("bigint").alias("x"))
    step = F.aggregate(asc, start, lambda a, t: F.struct(
        (a["left"] - t).alias("left"), (a["i"] + 1).alias("i"),
        F.greatest(a["x"], F.floor(a["left"] / (n - a["i"])).cast("bigint")).alias("x")))
    return F.when(step["left"] < 0, step["x"])


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("_tail", "item").agg(F.sum("score").alias("score"), F.sum("seen").alias("seen"))


def recommend_history_bounded(histories: DataFrame, followers: Followers, length: int = 10, k: int = 10,
                              key: str = "user_session", tie_vocab: DataFrame | None = None) -> Bounded:
    """``recommend_history`` over ``follower_blocks(model, k)`` of at least the same ``k``.

    histories: (key, history oldest to newest); a null or empty history and one of unseen items only have no
    rows. Null items count for nothing. Equal keys and repeated histories are each answered.
    """
    if not 0 < length <= 62:
        raise ValueError("length must be 1 to 62: lists of a history are marked by the bits of a bigint")
    n = F.size("history")
    tail = F.slice("history", F.greatest(n - F.lit(length - 1), F.lit(1)), length)
    keyed = histories.filter(n > 0).select(key, tail.alias("_tail"))
    # one list per distinct item of a tail, with the weights of its places summed; bit marks the list
    steps = F.transform("_tail", lambda x, p: F.struct(x.alias("prev_item"), (F.lit(length) - F.size("_tail") + 1 + p).alias("w")))
    lists = keyed.select("_tail").distinct().select("_tail", F.array_distinct("_tail").alias("_d"), F.explode(steps).alias("_s")) \
        .filter(F.col("_s.prev_item").isNotNull()) \
        .groupBy("_tail", F.col("_s.prev_item").alias("prev_item")) \
        .agg(F.sum("_s.w").cast("bigint").alias("w"),
             F.first(F.array_position("_d", F.col("_s.prev_item"))).cast("int").alias("_p")) \
        .select("_tail", "prev_item", "w", F.expr("shiftleft(1L, _p - 1)").alias("bit"))
    lists = materialize(lists.join(followers.heads, "prev_item"), "bounded-lists")

    read = _sums(lists.select("_tail", "w", "bit", F.explode("head").alias("_h")).select(
        "_tail", "_h.item", (F.col("w") * F.col("_h.cnt")).alias("score"), F.col("bit").alias("seen")))
    read = materialize(read, "bounded-read")

    open_lists = lists.filter(F.col("rest_top") > 0)
    tops = open_lists.groupBy("_tail").agg(F.collect_list(F.col("w") * F.col("rest_top")).alias("_tops"))
    limit = materialize(tops.join(_kth(read, k), "_tail").select("_tail", _unread(F.col("_tops"), F.col("_kth")).alias("x")),
                        "bounded-limit")
    wanted = open_lists.join(limit.filter(F.col("x").isNotNull()), "_tail") \
        .select("_tail", "prev_item", "w", "bit", "x", F.explode("blocks").alias("_b")) \
        .filter(F.col("w") * F.col("_b.top") > F.col("x")) \
        .select("_tail", "prev_item", "w", "bit", "x", F.col("_b.level").alias("level"))
    blocks = wanted.join(followers.rest, ["prev_item", "level"]).select(
        "_tail", "item", (F.col("w") * F.col("cnt")).alias("score"), F.col("bit").alias("seen"), "x")
    blocks = materialize(blocks, "bounded-blocks")
    read = materialize(_sums(read.unionByName(blocks.filter(F.col("score") > F.col("x")).drop("x"))), "bounded-read")

    # what an unread list could still add: at most x, and at most its own top
    most = F.least(F.coalesce("x", F.col("w") * F.col("rest_top")), F.col("w") * F.col("rest_top"))
    unread = open_lists.join(limit, "_tail").groupBy("_tail").agg(
        F.collect_list(F.struct("prev_item", "w", "bit", most.alias("most"))).alias("_u"))
    missing = F.filter("_u", lambda u: (u["most"] > 0) & (u["bit"].bitwiseAND(F.col("seen")) == 0))
    c = read.join(_kth(read, k), "_tail").join(unread, "_tail", "left") \
        .withColumn("_u", F.coalesce(missing, F.array().cast("array<struct<prev_item:bigint,w:bigint,bit:bigint,most:bigint>>")))
    add = F.aggregate("_u", F.lit(0).cast("bigint"), lambda a, u: a + u["most"])
    c = materialize(c.filter(F.col("score") + add >= F.col("_kth")).select("_tail", "item", "score", "_u"), "bounded-candidates")
    asked = materialize(c.select("_tail", "item", F.explode("_u").alias("_u"))
                        .select("_tail", "item", "_u.prev_item", "_u.w"), "bounded-asked")
    more = asked.join(followers.rest.select("prev_item", "item", "cnt"), ["prev_item", "item"]) \
        .select("_tail", "item", (F.col("w") * F.col("cnt")).alias("score"))

    s = c.select("_tail", "item", "score").unionByName(more).groupBy("_tail", "item").agg(F.sum("score").cast("bigint").alias("score"))
    order = [F.col("score").desc(), F.col("item").asc()]
    if tie_vocab is not None:
        s = s.join(tie_vocab.select("item", "idx"), "item", "left")
        order.insert(1, F.col("idx").asc_nulls_last())
    r = s.withColumn("rank", F.row_number().over(Window.partitionBy("_tail").orderBy(*order)).cast("bigint")) \
        .filter(F.col("rank") <= k)
    return Bounded(keyed.join(r, "_tail").select(key, "rank", "item", "score"), lists, blocks, asked)
