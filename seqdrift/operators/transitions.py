"""Transition model, follow statistics, recommendation and Top-K scoring.

Scores are integer counts so ranks are exact and engine-independent. Every
operator takes optional grouping ``keys`` (e.g. ``phase``, ``version``) so one job
fits and scores all phases / model versions at once.

Scoring never materialises a Top-K list per test pair: a test pair joins the
(prev, target) rank directly (E5). Popularity fill is exact without lists too —
for a target that does not follow ``prev``, its rank is
``followers(prev) + 1 + idx(target) − #followers of prev with a smaller idx``, and
only targets with ``idx < k`` can reach rank ≤ k, so each prev needs at most k
follower indices (a bounded array), never its whole neighbourhood.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

DEFAULT_KS = (1, 5, 10, 20, 50)


def transition_model(pairs: DataFrame, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(keys…, prev_item, next_item, cnt) — partial+final hash aggregate."""
    w = F.sum(weight) if weight else F.count(F.lit(1))
    return pairs.groupBy(*keys, "prev_item", "next_item").agg(w.cast("bigint").alias("cnt"))


def follow_stats(pairs: DataFrame, top_k: int = 5, min_support: int = 5,
                 keys: Sequence[str] = ()) -> DataFrame:
    """Per prev, its top_k followers by count (ties by item), then the
    support filter; confidence = count / *all* followers of prev.

    The rank filter runs as a window-group limit (partial top-k before the shuffle);
    the denominator is a separate per-prev aggregate joined back.
    """
    keys = list(keys)
    c = transition_model(pairs, keys)
    tot = c.groupBy(*keys, "prev_item").agg(F.sum("cnt").cast("bigint").alias("_tot"))
    w = Window.partitionBy(*keys, "prev_item").orderBy(F.col("cnt").desc(), F.col("next_item").asc())
    top = c.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= top_k)
    top = top.filter(F.col("cnt") >= min_support)
    j = top.join(tot, keys + ["prev_item"])
    return j.select(*keys, "prev_item", F.col("next_item").alias("item"), F.col("cnt").alias("support"),
                    (F.col("cnt").cast("double") / F.col("_tot").cast("double")).alias("confidence"), "rank")


def follow_stats_temporal(pairs: DataFrame, top_k: int = 5, min_support: int = 1) -> DataFrame:
    """follow statistics overall, by hour of day and by day of week, in one scan
    (GROUPING SETS). ``pairs`` must carry ``event_time`` of the prev event.
    dim ∈ {'all','hour','dow'}; ``slot`` = hour 0–23, day of week 1 (Sun)–7, or −1."""
    p = pairs.withColumn("_h", F.hour("event_time").cast("bigint")) \
        .withColumn("_d", F.dayofweek("event_time").cast("bigint"))
    g = p.groupingSets([["prev_item", "next_item"], ["prev_item", "next_item", "_h"],
                        ["prev_item", "next_item", "_d"]], "prev_item", "next_item", "_h", "_d") \
        .agg(F.count(F.lit(1)).cast("bigint").alias("cnt"))
    dim = F.when(F.col("_h").isNotNull(), F.lit("hour")).when(F.col("_d").isNotNull(), F.lit("dow")) \
        .otherwise(F.lit("all"))
    g = g.select(dim.alias("dim"), F.coalesce("_h", "_d", F.lit(-1).cast("bigint")).alias("slot"),
                 "prev_item", "next_item", "cnt")
    keys = ["dim", "slot"]
    tot = g.groupBy(*keys, "prev_item").agg(F.sum("cnt").cast("bigint").alias("_tot"))
    w = Window.partitionBy(*keys, "prev_item").orderBy(F.col("cnt").desc(), F.col("next_item").asc())
    top = g.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= top_k)
    top = top.filter(F.col("cnt") >= min_support)
    j = top.join(tot, keys + ["prev_item"])
    return j.select(*keys, "prev_item", F.col("next_item").alias("item"), F.col("cnt").alias("support"),
                    (F.col("cnt").cast("double") / F.col("_tot").cast("double")).alias("confidence"), "rank")


def _ranked_followers(model: DataFrame, vocab: DataFrame | None, keys, kmax: int, tie: str,
                      exclude: DataFrame | None = None) -> DataFrame:
    """(keys…, prev_item, item, cnt, idx, rank) for the top kmax followers of each prev."""
    m = model
    if vocab is not None:
        v = vocab.select(F.col("item").alias("next_item"), F.col("idx").alias("idx"), *[
            F.col(k) for k in keys if k in vocab.columns])
        m = m.join(v, [k for k in keys if k in vocab.columns] + ["next_item"], "left")
    else:
        m = m.withColumn("idx", F.lit(None).cast("bigint"))
    if exclude is not None:
        m = m.join(exclude.select(F.col("item").alias("next_item")), "next_item", "left_anti")
    tb = F.col("idx").asc_nulls_last() if tie == "idx" else F.col("next_item").asc()
    w = Window.partitionBy(*keys, "prev_item").orderBy(F.col("cnt").desc(), tb, F.col("next_item").asc())
    r = m.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= kmax)
    return r.select(*keys, "prev_item", F.col("next_item").alias("item"), "cnt", "idx", "rank")


def recommend_topk(model: DataFrame, vocab: DataFrame, k: int = 50, keys: Sequence[str] = (),
                   fill: bool = True, tie: str = "idx", exclude: DataFrame | None = None) -> DataFrame:
    """Top-k next items per prev (rows keys…, prev_item, rank, item, score).

    Followers first (count desc, then idx or item), then the most popular items that
    are not followers of that prev, up to k. A row with ``prev_item`` NULL is the
    fallback list for unseen items. Excluded items (a small id table) are removed
    from both parts. Output size is (#prev + 1) × k at most.
    """
    keys = list(keys)
    fol = _ranked_followers(model, vocab, keys, k, tie, exclude)
    out = fol.select(*keys, "prev_item", "rank", "item", F.col("cnt").alias("score"))
    if not fill:
        return out
    vk = [c for c in keys if c in vocab.columns]
    prevs = model.select(*keys, "prev_item").distinct()
    fb = (model.select(*keys).distinct() if keys else model.sparkSession.range(1).select())
    prevs = prevs.unionByName(fb.withColumn("prev_item", F.lit(None).cast(model.schema["prev_item"].dataType)))
    # The k most popular items that are not excluded, as one row: of k candidates at most the
    # followers drop out, so at least the missing places stay filled. No join on idx, whose k
    # values would each take all prevs.
    allowed = vocab.select(*vk, "idx", "item")
    if exclude is not None:
        allowed = allowed.join(exclude.select("item"), "item", "left_anti")
    if vk:
        wk = Window.partitionBy(*vk).orderBy("idx")
        first = allowed.withColumn("_r", F.row_number().over(wk)).filter(F.col("_r") <= k).drop("_r")
    else:
        first = allowed.orderBy("idx").limit(k)
    first = first.groupBy(*vk).agg(F.array_sort(F.collect_list(F.struct("idx", "item"))).alias("_c"))
    cand = prevs.join(F.broadcast(first), vk, "inner") if vk else prevs.crossJoin(F.broadcast(first))
    cand = cand.select(*keys, "prev_item", F.explode("_c").alias("_c")).select(*keys, "prev_item", "_c.idx", "_c.item")
    fol_all = model.select(*keys, "prev_item", F.col("next_item").alias("item"))
    cand = cand.join(fol_all, keys + ["prev_item", "item"], "left_anti")
    nf = fol.groupBy(*keys, "prev_item").agg(F.count(F.lit(1)).alias("_nf"))
    cand = cand.join(nf, keys + ["prev_item"], "left").withColumn("_nf", F.coalesce("_nf", F.lit(0)))
    wf = Window.partitionBy(*keys, "prev_item").orderBy("idx")
    cand = cand.withColumn("rank", (F.col("_nf") + F.row_number().over(wf)).cast("bigint")) \
        .filter(F.col("rank") <= k)
    fills = cand.select(*keys, "prev_item", "rank", "item", F.lit(0).cast("bigint").alias("score"))
    return out.unionByName(fills)


def target_ranks(tests: DataFrame, model: DataFrame, vocab: DataFrame | None, kmax: int,
                 keys: Sequence[str] = (), fill: bool = False, tie: str = "item") -> DataFrame:
    """Rank of each test target under the model (NULL = not in the top kmax).

    tests: (keys…, prev_item, target, n) — pairs pre-aggregated with multiplicity n.
    """
    keys = list(keys)
    fol = _ranked_followers(model, vocab if (tie == "idx" or fill) else None, keys, kmax, tie)
    hit = fol.select(*keys, "prev_item", F.col("item").alias("target"), F.col("rank").alias("_frank"))
    t = tests.join(hit, keys + ["prev_item", "target"], "left")
    if not fill:
        return t.withColumn("rank", F.col("_frank")).drop("_frank")
    vk = [c for c in keys if c in vocab.columns]
    tv = vocab.select(*vk, F.col("item").alias("target"), F.col("idx").alias("_tidx"))
    t = t.join(tv, vk + ["target"], "left")
    # Per prev: number of followers, and the (bounded) list of follower idx < kmax.
    mv = model.join(vocab.select(*vk, F.col("item").alias("next_item"), "idx"), vk + ["next_item"], "left")
    per_prev = mv.groupBy(*keys, "prev_item").agg(
        F.count(F.lit(1)).alias("_nf"),
        F.collect_list(F.when(F.col("idx") < kmax, F.col("idx"))).alias("_low"))
    t = t.join(per_prev, keys + ["prev_item"], "left")
    nf = F.coalesce(F.col("_nf"), F.lit(0))
    smaller = F.coalesce(F.size(F.filter("_low", lambda x: x < F.col("_tidx"))), F.lit(0))
    fill_rank = nf + F.lit(1) + F.col("_tidx") - smaller
    rank = F.when(F.col("_frank").isNotNull(), F.col("_frank")) \
        .when(F.col("_tidx").isNotNull() & (fill_rank <= kmax), fill_rank)
    return t.withColumn("rank", rank.cast("bigint")).drop("_frank", "_tidx", "_nf", "_low")


def topk_accuracy(ranked: DataFrame, ks: Sequence[int] = DEFAULT_KS, keys: Sequence[str] = ()) -> DataFrame:
    """(keys…, k, n, hits, accuracy) for all k in one pass; n = 0 → NULL accuracy.

    A key without tests has a row only if ``ranked`` holds one of it with n = 0 (``keep_keys``).
    """
    keys = list(keys)
    aggs = [F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("_n")]
    for k in ks:
        aggs.append(F.sum(F.when(F.col("rank") <= k, F.col("n")).otherwise(F.lit(0))).cast("bigint").alias(f"_h{k}"))
    aggs[1:] = [F.coalesce(a, F.lit(0).cast("bigint")).alias(f"_h{k}") for a, k in zip(aggs[1:], ks)]
    a = ranked.groupBy(*keys).agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.col(f"_h{k}").alias("hits"))
                               for k in ks])).alias("_kh")
    e = a.select(*keys, F.col("_n").alias("n"), rows)
    acc = F.when(F.col("n") > 0, F.col("_kh.hits").cast("double") / F.col("n").cast("double"))
    return e.select(*keys, F.col("_kh.k").alias("k"), "n", F.col("_kh.hits").alias("hits"), acc.alias("accuracy"))


def keep_keys(tests: DataFrame, keyed: DataFrame) -> DataFrame:
    """``tests`` plus a pair of multiplicity 0 per row of ``keyed``, a small table of the key columns:
    a phase or day without test pairs keeps its accuracy rows (n = 0, Q9)."""
    empty = {c: F.lit(None).cast(tests.schema[c].dataType).alias(c) for c in ("prev_item", "target")}
    return tests.unionByName(keyed.select("*", *empty.values(), F.lit(0).cast("bigint").alias("n")))


def aggregate_tests(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Test pairs → (keys…, prev_item, target, n): scoring joins each distinct pair once."""
    return pairs.groupBy(*keys, "prev_item", F.col("next_item").alias("target")) \
        .agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def recommend_history(histories: DataFrame, model: DataFrame, length: int = 10, k: int = 10,
                      key: str = "user_session", tie_vocab: DataFrame | None = None,
                      fill: bool = False, exclude: DataFrame | None = None) -> DataFrame:
    """Score next items from a whole history: Σ over history items of
    recency weight (L − distance from the end) × transition count; top-k per key.

    histories: (key, history array oldest→newest). All candidates are scored (no cap). Each distinct
    history tail is scored once, with the weights of an item summed before the model is joined.
    ``fill`` (needs ``tie_vocab``) offers the k most popular items at score 0 beside the followers, so
    every key gets an answer: empty histories and unseen items too. ``exclude``: a small id table.
    """
    n = F.size("history")
    tail = F.slice("history", F.greatest(n - F.lit(length - 1), F.lit(1)), length)
    keyed = histories.withColumn("history", F.coalesce("history", F.array().cast(
        histories.schema["history"].dataType))).select(key, tail.alias("_tail"))
    tails = keyed.select("_tail").distinct()
    h = tails.select("_tail", F.size("_tail").alias("_s"), F.posexplode("_tail").alias("_p", "prev_item"))
    # distance from the newest item d = s − 1 − p; weight L − d (newest L, then L−1, …)
    h = h.groupBy("_tail", "prev_item").agg(F.sum(F.lit(length) - (F.col("_s") - 1 - F.col("_p"))).alias("_w"))
    s = h.join(model, "prev_item", "inner").select(
        "_tail", F.col("next_item").alias("item"), (F.col("_w") * F.col("cnt")).cast("bigint").alias("score"))
    if exclude is not None:
        s = s.join(exclude.select("item"), "item", "left_anti").select("_tail", "item", "score")
    if fill:
        allowed = tie_vocab.select("idx", "item")
        if exclude is not None:
            allowed = allowed.join(exclude.select("item"), "item", "left_anti")
        top = allowed.orderBy("idx").limit(k).agg(F.collect_list("item").alias("_top"))  # one row of k items
        s = s.unionByName(tails.crossJoin(F.broadcast(top)).select(
            "_tail", F.explode("_top").alias("item"), F.lit(0).cast("bigint").alias("score")))
    s = s.groupBy("_tail", "item").agg(F.sum("score").cast("bigint").alias("score"))
    if tie_vocab is not None:
        s = s.join(tie_vocab.select("item", "idx"), "item", "left")
        order = [F.col("score").desc(), F.col("idx").asc_nulls_last(), F.col("item").asc()]
    else:
        order = [F.col("score").desc(), F.col("item").asc()]
    w = Window.partitionBy("_tail").orderBy(*order)
    r = s.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)
    return keyed.join(r, "_tail").select(key, "rank", "item", "score")
