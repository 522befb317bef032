"""Registered queries: name → callable(spark, sf_dir) → DataFrame.

Every query reads the driver's tables through an adapter and runs over them whole.
The SQL twin of each name lives in ``seqdrift.oracle.SQL``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.arrays import render
from .operators import sampling as C
from .operators import sessions as S
from .operators import slices as B
from .operators import transitions as J
from .operators import vocab as D
from .plans.baseline import split_parts, split_topk_accuracy
from .schema import EVENT_ID, EVENT_TIME, ITEM, SESSION, USER
from .sources import adapters as A
from .sources.adapters import load_events
from .sources.sinks import ingest_drops, ingest_stats

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def clicks(spark, sf_dir):
    """The sessionized ``clicks`` log (lazy).

    The adapter is cheap to recompute (two pruned scans and a shuffle of the
    per-(user, day) summary), so one level of two-pass operators reads it lazily;
    the protocols, which nest several levels, write their own base tables once.
    """
    return A.clicks(spark, sf_dir)


def raw_clicks(spark, sf_dir):
    """The lazy adapter, for single-pass queries (a write would be pure overhead)."""
    return A.clicks(spark, sf_dir)


# ---------------------------------------------------------------- A: sources
register("clicks")(lambda spark, d: A.clicks(spark, d))
register("baskets")(lambda spark, d: A.baskets(spark, d))
@register("csv_log")
def q_csv_log(spark, d):
    """A1/A2: the log as header CSV with text times (with and without `` UTC``, every 50th unreadable),
    columns in another order and one to prune, written and read again."""
    from .config import scratch_path
    from .sources.files import read_events_csv
    path = scratch_path(spark, "csv-log")
    text = F.date_format(EVENT_TIME, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    text = F.when(F.col(EVENT_ID) % 50 == 0, "no time").when(F.col(EVENT_ID) % 2 == 0, F.concat(text, F.lit(" UTC"))).otherwise(text)
    A.parsed_events(spark, d).select(
        F.col(USER).cast("string").alias(SESSION), ITEM, F.lit("x, \"y\"").alias("extra"), text.alias(EVENT_TIME), USER, EVENT_ID,
    ).write.option("header", True).csv(path)
    return read_events_csv(spark, path)


register("ingest_drops")(lambda spark, d: ingest_drops(A.parsed_events(spark, d)))
register("ingest_stats")(lambda spark, d: ingest_stats(raw_clicks(spark, d)))


# ---------------------------------------------------------------- sessions
@register("session_rows")
def q_session_rows(spark, d):
    return A.click_rows(spark, d, next_of=()).select(SESSION, EVENT_ID, "row_num", ITEM)


@register("session_pairs")
def q_session_pairs(spark, d):
    return _pairs(spark, d).select(SESSION, "row_num", "prev_item", "next_item")


@register("session_pairs_compat")
def q_session_pairs_compat(spark, d):
    rows = A.click_rows(spark, d, with_size=True)
    return S.pairs_from_rows(rows, compat=True).select(SESSION, "row_num", "prev_item", "next_item")


@register("basket_pairs")
def q_basket_pairs(spark, d):
    return S.pairs_from_rows(A.basket_rows(spark, d)).select(SESSION, "row_num", "prev_item", "next_item")


@register("session_sequences")
def q_session_sequences(spark, d):
    s = S.sequences_from_rows(A.click_rows(spark, d, next_of=(), with_size=True), min_len=2, chunk_len=1024)
    return s.select(SESSION, "chunk", "session_len", render(F.col("items")).alias("items"))


@register("history_windows")
def q_history_windows(spark, d):
    rows = A.click_rows(spark, d)
    h = S.history_windows(rows, 10)
    return h.select(SESSION, "row_num", render(F.col("history")).alias("history"),
                    F.col(f"next_{ITEM}").alias("target"))


# ---------------------------------------------------------------- flagship
@register("topk_accuracy")
def q_topk_accuracy(spark, d):
    return split_topk_accuracy(A.click_rows(spark, d), frac=0.8, fill=True, tie="idx", ordered=True)


# ---------------------------------------------------------------- D: vocabularies
@register("vocab_items")
def q_vocab_items(spark, d):
    return D.fit_vocab(clicks(spark, d), ITEM)


@register("vocab_users")
def q_vocab_users(spark, d):
    return D.fit_vocab(clicks(spark, d), USER)


@register("vocab_sessions")
def q_vocab_sessions(spark, d):
    return D.fit_vocab(clicks(spark, d), SESSION)


@register("popularity")
def q_popularity(spark, d):
    return D.popularity(raw_clicks(spark, d), ITEM)


def _train_vocabs(spark, d, adapter="clicks"):
    """The split log and its training vocabularies; written once, as each vocabulary reads it twice."""
    from .config import materialize
    ev = materialize(C.split_sessions(A.load_events(spark, d, adapter)), "split-log")
    tr = ev.filter(F.col("is_train"))
    return ev, D.fit_vocab(tr, ITEM), D.fit_vocab(tr, USER)


@register("encoded_events")
def q_encoded_events(spark, d):
    """Indices from the training vocabularies; unseen → n_labels; raw ids dropped."""
    ev, vi, vu = _train_vocabs(spark, d)
    e = D.encode(ev, vi, ITEM, "product_index", unknown="keep")
    e = D.encode(e.drop("is_unknown"), vu, USER, "user_index", unknown="keep")
    return e.select(EVENT_ID, EVENT_TIME, "product_index", "user_index")


@register("decode_items")
def q_decode_items(spark, d):
    """D3: index → id on the baskets log; indices of unseen parts decode to NULL."""
    ev, vi, _ = _train_vocabs(spark, d, "baskets")
    e = D.encode(ev, vi, ITEM, "product_index", unknown="keep")
    e = D.decode(e, vi, "product_index", "decoded_item")
    return e.select(SESSION, EVENT_ID, "product_index", "decoded_item")


@register("encode_unknown")
def q_encode_unknown(spark, d):
    """Held-out baskets encoded with the training vocabulary, unseen → −1."""
    ev, vi, _ = _train_vocabs(spark, d, "baskets")
    e = D.encode(ev.filter(~F.col("is_train")), vi, ITEM, "product_index", unknown="minus_one")
    return e.select(SESSION, EVENT_ID, "product_index", "is_unknown")


@register("vocab_remap")
def q_vocab_remap(spark, d):
    """Training-side vs held-out-side part vocabularies aligned by id."""
    ev = C.split_sessions(A.baskets(spark, d))
    old = D.fit_vocab(ev.filter(F.col("is_train")), ITEM)
    new = D.fit_vocab(ev.filter(~F.col("is_train")), ITEM)
    return D.remap(old, new)


# ---------------------------------------------------------------- C/E: splits and samples
@register("split_sessions")
def q_split_sessions(spark, d):
    return C.split_sessions(raw_clicks(spark, d)).select(SESSION, "is_train").distinct()


@register("split_sessions_exact")
def q_split_sessions_exact(spark, d):
    """Exactly 80% of the sessions (rounded down) train."""
    return C.split_sessions_exact(raw_clicks(spark, d), 80)


@register("split_semi")
def q_split_semi(spark, d):
    ev = clicks(spark, d)
    return C.semi(ev, C.session_list(ev, train=True)).select(EVENT_ID, SESSION)


@register("split_anti")
def q_split_anti(spark, d):
    ev = clicks(spark, d)
    return C.anti(ev, C.session_list(ev, train=True)).select(EVENT_ID, SESSION)


@register("replay_sample")
def q_replay_sample(spark, d):
    """Exactly floor(5% of N) events, the bottom-n by md5('replay' || event_id)."""
    ev = clicks(spark, d)
    n = ev.agg((F.count(F.lit(1)) * 5 / 100).cast("bigint").alias("n"))
    return C.exact_sample(ev, n, seed="replay").select(EVENT_ID, SESSION)


@register("validation_tail")
def q_validation_tail(spark, d):
    """C4: last 20% of the training pairs in (time, id) order."""
    _, train_pairs, _, _ = split_parts(clicks(spark, d))
    v = C.validation_tail(train_pairs)
    return v.select(SESSION, "row_num", "pair_pos", "is_validation")


# ---------------------------------------------------------------- B/G4/H6: slices and positions
def _positioned(spark, d):
    ev = B.event_positions(clicks(spark, d))
    n = ev.agg(F.count(F.lit(1)).alias("_N"))
    return ev.crossJoin(F.broadcast(n))


@register("event_positions")
def q_event_positions(spark, d):
    return B.event_positions(clicks(spark, d)).select(EVENT_ID, "pos")


@register("position_slice")
def q_position_slice(spark, d):
    """The first sliding training window, positions [15% N, 55% N)."""
    p = _positioned(spark, d)
    p = p.withColumn("_a", (F.col("_N") * 15 / 100).cast("bigint")).withColumn("_b", (F.col("_N") * 55 / 100).cast("bigint"))
    return B.position_slice(p, "_a", "_b").select(EVENT_ID, "pos")


@register("slice_except_compat")
def q_slice_except_compat(spark, d):
    """H6: the same window as prefix EXCEPT DISTINCT prefix, on the log's own columns."""
    p = _positioned(spark, d)
    p = p.withColumn("_a", (F.col("_N") * 15 / 100).cast("bigint")).withColumn("_b", (F.col("_N") * 55 / 100).cast("bigint"))
    return B.slice_except_compat(p, "_a", "_b")


@register("cutoff_split")
def q_cutoff_split(spark, d):
    """Events at or before midnight of (max time − 14 days)."""
    ev = clicks(spark, d)
    return B.before_cutoff(ev, B.initial_cutoff(ev, 14)).select(EVENT_ID, EVENT_TIME, SESSION)


@register("trailing_window")
def q_trailing_window(spark, d):
    """Events within 3 days of the latest event."""
    return B.trailing_window(clicks(spark, d), 3).select(EVENT_ID, EVENT_TIME)


# ---------------------------------------------------------------- F/J: statistics and models
def _pairs(spark, d):
    """Pairs of the clicks log straight from the fused sessionizer (one full shuffle)."""
    return S.pairs_from_rows(A.click_rows(spark, d, next_of=(ITEM, EVENT_TIME)))


@register("follow_stats")
def q_follow_stats(spark, d):
    return J.follow_stats(_pairs(spark, d), top_k=5, min_support=5)


@register("follow_stats_temporal")
def q_follow_stats_temporal(spark, d):
    return J.follow_stats_temporal(_pairs(spark, d), top_k=5, min_support=1)


@register("transition_model")
def q_transition_model(spark, d):
    return J.transition_model(_pairs(spark, d))


def _train_model(spark, d):
    from .plans.baseline import SplitProtocol
    sp = SplitProtocol(A.click_rows(spark, d, with_size=True), ordered=True)
    return sp.events, sp.model, sp.vocab


def _last_histories(rows, length=10):
    """The last ``length`` items of every session of ordered, sized rows; earlier rows are not gathered."""
    tail = rows.filter(F.col("row_num") > F.col("session_len") - length)
    h = S.history_windows(tail, length, carry=("session_len",))
    return h.filter(F.col("row_num") == F.col("session_len"))


@register("recommend_topk")
def q_recommend_topk(spark, d):
    """Top-10 per prev item from the training sessions, popularity fill."""
    _, model, vocab = _train_model(spark, d)
    return J.recommend_topk(model, vocab, k=10, fill=True, tie="idx")


@register("recommend_excluding")
def q_recommend_excluding(spark, d):
    """The same lists with the two most popular items excluded."""
    _, model, vocab = _train_model(spark, d)
    excl = vocab.filter(F.col("idx") < 2).select("item")
    return J.recommend_topk(model, vocab, k=10, fill=True, tie="idx", exclude=excl)


@register("recommend_history")
def q_recommend_history(spark, d):
    """For each held-out session, top-10 from its last 10 items (recency-weighted)."""
    ev, model, vocab = _train_model(spark, d)
    h = _last_histories(ev.filter(~F.col("is_train")))
    return J.recommend_history(h, model, length=10, k=10, tie_vocab=vocab)


@register("recommend_history_filled")
def q_recommend_history_filled(spark, d):
    """J3 with the two most popular items left out and popularity fill: every held-out session is
    answered, those of one event and of unseen items too."""
    ev, model, vocab = _train_model(spark, d)
    h = _last_histories(ev.filter(~F.col("is_train")))
    return J.recommend_history(h, model, length=10, k=10, tie_vocab=vocab, fill=True,
                               exclude=vocab.filter(F.col("idx") < 2).select("item"))


@register("recommend_history_bounded")
def q_recommend_history_bounded(spark, d):
    """J3 by heads, blocks and look-ups: the rows of ``recommend_history`` without reading every list whole."""
    from .operators.bounded import follower_blocks, recommend_history_bounded
    ev, model, vocab = _train_model(spark, d)
    h = _last_histories(ev.filter(~F.col("is_train")))
    return recommend_history_bounded(h, follower_blocks(model, 10), length=10, k=10, tie_vocab=vocab).answers


# ---------------------------------------------------------------- L: sliding window + replay
def _phases(spark, d, buffer="growing"):
    from .plans.phases import PhaseProtocol
    return PhaseProtocol(clicks(spark, d), buffer=buffer, counted=A.click_events(spark, d))


@register("phase_plan")
def q_phase_plan(spark, d):
    return _phases(spark, d).plan.select("phase", "train_start", "train_end", "test_start", "test_end")


@register("phase_events")
def q_phase_events(spark, d):
    return _phases(spark, d).phase_events()


@register("replay_buffer")
def q_replay_buffer(spark, d):
    return _phases(spark, d).replay_buffer()


@register("train_with_replay")
def q_train_with_replay(spark, d):
    return _phases(spark, d).train_rows().select("phase", "source", EVENT_ID)


@register("train_stats")
def q_train_stats(spark, d):
    return _phases(spark, d).train_stats()


@register("train_stats_sketch")
def q_train_stats_sketch(spark, d):
    """L10/F3 by sketches (estimates; ``train_stats_sketch_error`` holds them against the exact counts)."""
    return _phases(spark, d).train_stats_sketch()


@register("train_stats_sketch_error")
def q_train_stats_sketch_error(spark, d):
    """Whether every phase's estimates lie within three standard errors (2.4 %) of the exact counts."""
    p = _phases(spark, d)
    exact = p.train_stats().withColumnsRenamed({"n_items": "items", "n_sessions": "sessions"}).drop("n_rows")

    def near(estimate, count):
        return F.abs(F.col(estimate) - F.col(count)) * 1000 <= F.col(count) * 24

    return p.train_stats_sketch().join(exact, "phase").select(
        "phase", "n_rows", near("n_items", "items").alias("items_near"), near("n_sessions", "sessions").alias("sessions_near"))


@register("phase_topk_accuracy")
def q_phase_topk_accuracy(spark, d):
    return _phases(spark, d).accuracy(variants=("window", "replay"))


@register("phase_topk_accuracy_frozen")
def q_phase_topk_accuracy_frozen(spark, d):
    """The reference's effective buffer (seed draw only, never grown)."""
    return _phases(spark, d, buffer="frozen").accuracy(variants=("replay",))


@register("phase_topk_accuracy_static")
def q_phase_topk_accuracy_static(spark, d):
    """The model of phase 0, never refitted, on every phase."""
    return _phases(spark, d).accuracy(variants=("static",))


@register("phase_topk_accuracy_rows_frozen")
def q_phase_topk_accuracy_rows_frozen(spark, d):
    """The reference's effective replay: one row draw, never grown, pairs rebuilt after the union."""
    return _phases(spark, d, buffer="frozen").accuracy(variants=("replay_rows",))


@register("phase_unknown_share")
def q_phase_unknown_share(spark, d):
    return _phases(spark, d).unknown_share()


@register("degradation_alerts")
def q_degradation_alerts(spark, d):
    from .plans.alerts import degradation_alerts
    acc = _phases(spark, d).accuracy(variants=("window", "replay"))
    return degradation_alerts(acc, order="phase").select(
        "variant", "k", "phase", "accuracy", "prev_accuracy", "alert")


# ---------------------------------------------------------------- L: daily protocol
def _daily(spark, d, cumulative=False):
    from .plans.daily import DailyProtocol
    return DailyProtocol(clicks(spark, d), shift_days=14, window_days=3, every_days=3, cumulative=cumulative,
                         timed=A.click_events(spark, d))


@register("test_dates")
def q_test_dates(spark, d):
    return _daily(spark, d).test_dates()


@register("update_schedule")
def q_update_schedule(spark, d):
    return _daily(spark, d).schedule()


@register("model_in_force")
def q_model_in_force(spark, d):
    return _daily(spark, d).model_in_force()


@register("window_refit")
def q_window_refit(spark, d):
    return _daily(spark, d).window_rows()


@register("initial_model")
def q_initial_model(spark, d):
    return _daily(spark, d).initial_model()


@register("transition_transfer")
def q_transition_transfer(spark, d):
    return _daily(spark, d).transfer_counts()


@register("daily_topk_accuracy")
def q_daily_topk_accuracy(spark, d):
    return _daily(spark, d).accuracy()


@register("daily_topk_accuracy_cumulative")
def q_daily_topk_accuracy_cumulative(spark, d):
    """The reference's order: update at d first, then score everything up to d."""
    return _daily(spark, d, cumulative=True).accuracy(variants=("static", "updated"))


# ---------------------------------------------------------------- K: MLlib models (rows-only checks)
@register("item_embeddings")
def q_item_embeddings(spark, d):
    from .operators.mllib import item_embeddings
    ev = C.split_sessions(clicks(spark, d)).filter(F.col("is_train"))
    return item_embeddings(ev).select("item", F.size("vector").alias("dim"), "vector")


@register("item_cooccurrence")
def q_item_cooccurrence(spark, d):
    """K1: how often two items lie within five events of each other in a training session."""
    from .operators.factors import cooccurrence
    return cooccurrence(C.split_sessions(clicks(spark, d)).filter(F.col("is_train")))


@register("item_ppmi")
def q_item_ppmi(spark, d):
    """K1: the positive mutual information that the factors are made of."""
    from .operators.factors import cooccurrence, ppmi
    ev = C.split_sessions(clicks(spark, d)).filter(F.col("is_train"))
    return ppmi(cooccurrence(ev)).select("item", "context", "n", F.round("weight", 6).alias("weight"))


@register("item_factors")
def q_item_factors(spark, d):
    """K1: item vectors by factorising the table, the catalogue never on the driver."""
    from .operators.factors import cooccurrence, factorise, ppmi
    ev = C.split_sessions(clicks(spark, d)).filter(F.col("is_train"))
    return factorise(ppmi(cooccurrence(ev)))[0].select("item", F.size("vector").alias("dim"), "vector")


PROJECTION = 32


def _projected(spark, d):
    """Held-out rows, ordered and sized, and the vectors of the training items; the sessionized log is written once."""
    from .config import materialize
    from .operators.factors import cooccurrence_of_rows
    from .operators.inner_product import projected_vectors
    ev = materialize(C.split_sessions(A.click_rows(spark, d, with_size=True)), "split-rows")
    counts = cooccurrence_of_rows(ev.filter(F.col("is_train")))
    return ev.filter(~F.col("is_train")), materialize(projected_vectors(counts, PROJECTION), "projected-vectors")


@register("item_projection")
def q_item_projection(spark, d):
    """K1: integer item vectors by random indexing of the co-occurrence counts."""
    _, vectors = _projected(spark, d)
    return vectors.select("item", F.posexplode("vector").alias("j", "v")) \
        .select("item", F.col("j").cast("bigint").alias("j"), F.col("v").cast("bigint").alias("v"))


@register("inner_product_topk")
def q_inner_product_topk(spark, d):
    """K2: the ten items of the whole catalogue nearest to the last ten of each held-out session, exact."""
    from .operators.inner_product import history_vectors, top_items
    test, vectors = _projected(spark, d)
    return top_items(history_vectors(_last_histories(test), vectors, [SESSION], PROJECTION), vectors, 10, key=SESSION)


@register("inner_product_accuracy")
def q_inner_product_accuracy(spark, d):
    """K3: Top-K accuracy by the target's rank among all items, without a list or an output as wide as they are."""
    from .operators.inner_product import history_vectors, target_ranks
    test, vectors = _projected(spark, d)
    nxt, key = f"next_{ITEM}", [SESSION, "row_num"]
    h = S.history_windows(test, 10, carry=(nxt,)).filter(F.col(nxt).isNotNull())
    q = h.select(*key, F.col(nxt).alias("target")).join(history_vectors(h, vectors, key, PROJECTION), key, "left")
    q = q.groupBy("vector", "target").agg(F.count(F.lit(1)).alias("n"))
    return J.topk_accuracy(target_ranks(q, vectors))


def _sized_rows(spark, d):
    return A.click_rows(spark, d, with_size=True)


@register("mlp_next_item")
def q_mlp_next_item(spark, d):
    from .plans.learned import MlpProtocol
    p = MlpProtocol(_sized_rows(spark, d), ordered=True)
    return p.predictions().select(SESSION, "row_num", "target", "label", F.col("prediction").cast("bigint"))


@register("mlp_topk_accuracy")
def q_mlp_topk_accuracy(spark, d):
    from .plans.learned import MlpProtocol
    return MlpProtocol(_sized_rows(spark, d), ordered=True).accuracy()


@register("mlp_warm_start")
def q_mlp_warm_start(spark, d):
    from .plans.learned import warm_start_accuracy
    return warm_start_accuracy(_sized_rows(spark, d), ordered=True)


# ---------------------------------------------------------------- M: streaming (stream = batch)
def _staged(spark, d, **kw):
    from .streaming.staging import read_stream, stage_batches
    folder, fpt = stage_batches(clicks(spark, d), **kw)
    return read_stream(spark, folder, fpt)


@register("stream_events")
def q_stream_events(spark, d):
    from .streaming.jobs import events_stream
    from .streaming.staging import run_to_parquet
    out = run_to_parquet(events_stream(_staged(spark, d)), "stream-events")
    return out.select(EVENT_ID, EVENT_TIME, USER, ITEM, SESSION)


@register("stream_dedup")
def q_stream_dedup(spark, d):
    from .streaming.jobs import dedup_stream
    from .streaming.staging import batch_time, run_to_parquet
    out = run_to_parquet(dedup_stream(_staged(spark, d, overlap_seconds=6 * 3600)), "stream-dedup")
    return batch_time(out).select(EVENT_ID, EVENT_TIME, USER, ITEM, SESSION)


@register("windowed_popularity")
def q_windowed_popularity(spark, d):
    from .streaming.jobs import windowed_popularity
    return windowed_popularity(raw_clicks(spark, d))


@register("stream_popularity")
def q_stream_popularity(spark, d):
    from .streaming.jobs import popularity_stream
    from .streaming.staging import batch_time, run_to_parquet
    out = run_to_parquet(popularity_stream(_staged(spark, d, sentinel=True)), "stream-popularity")
    out = batch_time(batch_time(out, "window_start"), "window_end")
    return out.filter(F.col("item") >= 0)


@register("stream_sessions")
def q_stream_sessions(spark, d):
    from .streaming.jobs import session_stream
    from .streaming.staging import batch_time, run_to_parquet
    out = run_to_parquet(session_stream(_staged(spark, d, sentinel=True)), "stream-sessions")
    out = batch_time(batch_time(out, "session_start"), "session_end")
    return out.filter(F.col(USER) >= 0)


@register("stream_history")
def q_stream_history(spark, d):
    from .streaming.jobs import history_stream
    from .streaming.staging import run_to_parquet
    out = run_to_parquet(history_stream(_staged(spark, d, sentinel=True)), "stream-history")
    last = out.filter(F.col(SESSION) != "-1").groupBy(SESSION).agg(
        F.max("row_num").alias("n_events"), F.max_by("history", "row_num").alias("history"))
    return last


@register("stream_recommend")
def q_stream_recommend(spark, d):
    from .streaming.jobs import recommend_stream
    from .streaming.staging import run_to_parquet
    _, model, vocab = _train_model(spark, d)
    recs = J.recommend_topk(model, vocab, k=10, fill=True, tie="idx")
    from .config import materialize
    recs = materialize(recs, "stream-recs")
    return run_to_parquet(recommend_stream(_staged(spark, d), recs), "stream-recommend")


@register("stream_model_refresh")
def q_stream_model_refresh(spark, d):
    from .streaming.jobs import ModelRefresh
    from .streaming.staging import run_foreach_batch
    m = ModelRefresh(spark, expire_seconds=86_400)  # clicks sessions: 1-day inactivity gap
    run_foreach_batch(_staged(spark, d), "stream-model", m)
    return m.model()


def _dealt(spark, d, n):
    """The clicks log with the number ``_b`` of the batch that brings a row, by hash of its id; written once."""
    from .config import materialize
    return materialize(clicks(spark, d).withColumn("_b", F.pmod(F.xxhash64(EVENT_ID, F.lit("arrival")), F.lit(n))), "dealt")


@register("stream_history_unordered")
def q_stream_history_unordered(spark, d):
    """M5 with events arriving in hash order, one batch delivered twice: equals the batch histories."""
    from .streaming.jobs import SessionRefresh
    ev = _dealt(spark, d, 3)
    m = SessionRefresh(spark, lambda e: S.history_windows(S.session_rows(e), 10))
    for b in (0, 1, 1, 2):
        m(ev.filter(F.col("_b") == b).drop("_b"), b)
    return m.result().groupBy(SESSION).agg(
        F.max("row_num").alias("n_events"), render(F.max_by("history", "row_num")).alias("history"))


@register("stream_sequences")
def q_stream_sequences(spark, d):
    """M4: ordered item sequences per session, kept up to date by the stream."""
    from .streaming.jobs import SessionRefresh
    from .streaming.staging import run_foreach_batch
    m = SessionRefresh(spark, lambda e: S.session_sequences(e, min_len=1, chunk_len=1024), expire_seconds=86_400)
    run_foreach_batch(_staged(spark, d), "stream-sequences", m)
    out = m.result().filter(F.col("session_len") >= 2)
    return out.select(SESSION, "chunk", "session_len", render(F.col("items")).alias("items"))


@register("stream_model_refresh_unordered")
def q_stream_model_refresh_unordered(spark, d):
    """M7 with events arriving in hash order and negative ids: equals the batch model."""
    from .streaming.jobs import ModelRefresh
    ev = _dealt(spark, d, 3)
    m = ModelRefresh(spark)
    for b in range(3):
        m(ev.filter(F.col("_b") == b).drop("_b").withColumn(EVENT_ID, F.col(EVENT_ID) - F.lit(1 << 40)), b)
    return m.model()


@register("stream_model_refresh_redelivered")
def q_stream_model_refresh_redelivered(spark, d):
    """M7 with each batch delivered again: equals the batch model."""
    from .streaming.jobs import ModelRefresh
    ev = _dealt(spark, d, 2)
    m = ModelRefresh(spark)
    for b in (0, 0, 1, 1):
        m(ev.filter(F.col("_b") == b).drop("_b"), b)
    return m.model()


@register("baskets_update_model")
def q_baskets_update_model(spark, d):
    """Facade refit on orders (event ids unique only per session) with a replay buffer of older rows."""
    from .api import ContinualNextItemPredictor
    ev = load_events(spark, d, "baskets")
    p = ContinualNextItemPredictor(window_size_days=100_000)
    p.update_model(ev, p.update_buffer(100, ev.limit(0), ev))
    return p.model


@register("baskets_replay_model")
def q_baskets_replay_model(spark, d):
    """Facade refit on the last year of orders, whole, with 20,000 rows drawn from all older ones."""
    from .api import ContinualNextItemPredictor
    ev = load_events(spark, d, "baskets")
    cut = ev.agg((F.max(EVENT_TIME) - F.expr("INTERVAL 365 DAYS")).alias("_cut"))  # one row
    aged = ev.crossJoin(F.broadcast(cut)).withColumn("_old", F.col(EVENT_TIME) < F.col("_cut")).drop("_cut")
    old, recent = (aged.filter(c).drop("_old") for c in (F.col("_old"), ~F.col("_old")))
    p = ContinualNextItemPredictor(window_size_days=30)
    p.update_model(recent, p.update_buffer(20_000, ev.limit(0), old))
    return p.model


@register("stream_history_state")
def q_stream_history_state(spark, d):
    """M5/G3 on the state store: one history per event, events arriving in hash order."""
    from .streaming.histories import history_state_stream, state_store
    from .streaming.staging import read_stream, run_to_parquet, stage_batches
    folder, per = stage_batches(clicks(spark, d), n_batches=3, sentinel=True, shuffled="arrival")
    with state_store(spark):
        # the lateness of hash order is the whole log
        out = run_to_parquet(history_state_stream(read_stream(spark, folder, per), watermark="400 days"), "stream-history-state")
    return out.filter(F.col(SESSION) != "-1").select(SESSION, "row_num", EVENT_ID, "history")


def _refits(spark, d):
    """Streamed refits with the cutoff of the batch protocol (a start date, one scalar)."""
    from .streaming.refits import RefitStream
    return RefitStream(spark, _daily(spark, d).bounds().first()["cutoff"], window_days=3, every_days=3)


@register("stream_refit_schedule")
def q_stream_refit_schedule(spark, d):
    """M7/L3: version list kept by the stream, events in time order: the batch protocol's versions."""
    from .streaming.staging import run_foreach_batch
    m = _refits(spark, d)
    run_foreach_batch(_staged(spark, d, n_batches=4), "stream-refits", m)
    return m.versions()


@register("stream_refit_versions")
def q_stream_refit_versions(spark, d):
    """M7/L4: counts of every version, events in hash order (late for most versions), one batch repeated."""
    m = _refits(spark, d)
    ev = _dealt(spark, d, 3)
    for b in (0, 1, 1, 2):
        m(ev.filter(F.col("_b") == b).drop("_b"), b)
    return m.counts()


@register("stream_replay")
def q_stream_replay(spark, d):
    from .streaming.jobs import ReplayReservoir
    from .streaming.staging import run_foreach_batch
    r = ReplayReservoir(spark, n=500, seed="replay")
    run_foreach_batch(_staged(spark, d), "stream-replay", r)
    return r.sample().select(EVENT_ID, SESSION)


@register("stream_replay_baskets")
def q_stream_replay_baskets(spark, d):
    """M8 on orders, whose event ids are unique only per session: whole rows, drawn by (session, id)."""
    from .streaming.jobs import ReplayReservoir
    from .streaming.staging import read_stream, run_foreach_batch, stage_batches
    folder, per = stage_batches(load_events(spark, d, "baskets"), n_batches=3, shuffled="arrival")
    r = ReplayReservoir(spark, n=500, seed="replay", key=(SESSION, EVENT_ID))
    run_foreach_batch(read_stream(spark, folder, per), "stream-replay-baskets", r)
    return r.sample()


def _arrivals(spark, d):
    """Clicks in thirds of the time span; an eighth arrives a batch later, a sixteenth is sent again with the next."""
    from .config import materialize
    from .functions.hashing import hex_prefix
    from .functions.time import epoch_micros
    ev = clicks(spark, d).withColumn("_t", epoch_micros(EVENT_TIME))
    span = ev.agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
    held = hex_prefix(F.col(EVENT_ID), "held", 1).isin("0", "1").cast("int")
    again = F.when(hex_prefix(F.col(EVENT_ID), "again", 1) == "0", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    ev = ev.crossJoin(F.broadcast(span)).withColumn("_third", F.expr("(_t - _lo) * 3 div (_hi - _lo + 1)") + held)
    ev = ev.withColumn("_copy", F.explode(again)).withColumn("_b", F.col("_third") + F.col("_copy"))
    return materialize(ev.select(EVENT_ID, EVENT_TIME, USER, ITEM, SESSION, "_b"), "arrivals")


def _late_account(spark, d):
    from .config import scratch_path
    from .streaming.late import LateAccount
    ev = _arrivals(spark, d)
    job = LateAccount(spark, scratch_path(spark, "late-account"))
    for b in (0, 1, 1, 2, 3, 4):
        job(ev.where(F.col("_b") == b).drop("_b"), b)
    return job


@register("stream_late_account")
def q_stream_late_account(spark, d):
    """M2: rows sent, kept, late and repeated per batch, one batch delivered twice."""
    return _late_account(spark, d).account()


@register("stream_late_rows")
def q_stream_late_rows(spark, d):
    """M2: the side table of rows behind the watermark."""
    return _late_account(spark, d).late().select(EVENT_ID, EVENT_TIME, SESSION, F.col("batch_id").cast("bigint"))


@register("stream_metrics")
def q_stream_metrics(spark, d):
    """A5: one metrics row per batch, though a batch is delivered twice and the job starts again."""
    from .config import scratch_path
    from .functions.hashing import hex_prefix
    from .streaming.commits import MetricsStream
    ev = clicks(spark, d).withColumn("_b", F.conv(hex_prefix(F.col(SESSION), "batch", 1), 16, 10).cast("int") % 3)

    def measure(batch):
        return batch.agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct(SESSION).alias("n_sessions"),
                         F.countDistinct(ITEM).alias("n_items"), F.max(EVENT_TIME).alias("last_time"))

    root = scratch_path(spark, "stream-metrics")
    for b in (0, 1, 1):
        MetricsStream(spark, measure, "run-1", root)(ev.where(F.col("_b") == b), b)
    m = MetricsStream(spark, measure, "run-1", root)
    for b in (1, 2):
        m(ev.where(F.col("_b") == b), b)
    return m.result()


# ---------------------------------------------------------------- I2/I3, C2
@register("history_padded")
def q_history_padded(spark, d):
    """Model input of held-out sessions — training-vocabulary indices (unseen → −1),
    ids outside [0, n_labels) clamped to 0, left-padded with −1 to length 10."""
    ev, vi, _ = _train_vocabs(spark, d)
    test = D.encode(ev.filter(~F.col("is_train")), vi, ITEM, "idx", unknown="minus_one")
    test = test.drop(ITEM).withColumnRenamed("idx", ITEM)
    rows = S.session_rows(test, next_of=[ITEM])
    h = S.history_windows(rows, 10).crossJoin(F.broadcast(D.vocab_size(vi)))
    x = S.padded("history", 10, pad=-1, n_items=F.col("n_labels"))
    return h.select(SESSION, "row_num", render(x).alias("padded"), F.col(f"next_{ITEM}").alias("target"))


@register("sample_rows")
def q_sample_rows(spark, d):
    """Bernoulli 5% row sample (size approximate; rows-only check)."""
    return C.sample_rows(clicks(spark, d), 0.05, seed=42).select(EVENT_ID, SESSION)


@register("sample_rows_seeded")
def q_sample_rows_seeded(spark, d):
    """Bernoulli 5% row sample by hash of session and id."""
    return C.seeded_rows(clicks(spark, d), 0.05, "rows", F.concat_ws("/", SESSION, EVENT_ID)).select(EVENT_ID, SESSION)


@register("phase_topk_accuracy_rows")
def q_phase_topk_accuracy_rows(spark, d):
    """The reference's replay: exact-size row draws, pairs rebuilt after the union."""
    return _phases(spark, d).accuracy(variants=("replay_rows",))
