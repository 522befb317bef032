"""Learned-model protocols on MLlib (K1–K4): split → embed → pool → MLP → Top-K.

The ordered log, the histories and the training rows are materialized: the optimizer
makes many passes, and a written table is re-read instead of recomputing the session
pipeline (and survives a lost executor).
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from ..config import materialize
from ..operators import mllib as K
from ..operators.sampling import split_sessions
from ..operators.sessions import history_windows, session_rows
from ..operators.slices import initial_cutoff
from ..operators.transitions import DEFAULT_KS, topk_accuracy
from ..operators.vocab import fit_vocab
from ..schema import EVENT_COLUMNS, EVENT_TIME, ITEM

HISTORY = 10
TOP_N = None  # one class per training-vocabulary item (no cap); an int caps it (rest → "other")


def split_rows(events: DataFrame, ordered: bool = False) -> DataFrame:
    """Events with ``is_train``, ``row_num``, ``session_len`` and the next item; ``ordered``: they carry the last three."""
    return split_sessions(events if ordered else session_rows(events, next_of=[ITEM], with_size=True))


def histories(rows: DataFrame, length: int = HISTORY) -> DataFrame:
    """(user_session, row_num, history, target, is_train, event_time) for every row with a successor."""
    h = history_windows(rows, length, carry=(f"next_{ITEM}", "is_train", EVENT_TIME))
    return h.filter(F.col(f"next_{ITEM}").isNotNull()).withColumnRenamed(f"next_{ITEM}", "target")


class MlpProtocol:
    """The log is ordered and written once; histories are written as items, and a row's features are made where
    they are used: once for the fit, once for the predictions."""

    def __init__(self, events: DataFrame, top_n: int | None = TOP_N, length: int = HISTORY, max_iter: int = 20,
                 ordered: bool = False):
        rows = materialize(split_rows(events, ordered), "mlp-rows")
        train = rows.filter(F.col("is_train"))
        self.max_iter = max_iter
        self.vocab = materialize(fit_vocab(train, ITEM), "mlp-vocab")
        # output width = vocabulary size (a scalar): MLlib holds hidden × classes weights on the driver
        self.top_n = top_n if top_n is not None else self.vocab.count()
        self.classes = K.class_vocab(self.vocab, self.top_n)
        self.emb = materialize(K.item_embeddings(train, ordered=True), "mlp-embeddings")
        self.data = materialize(K.labelled(histories(rows, length), self.classes, self.top_n), "mlp-histories")

    def fit(self):
        train = K.pooled_features(self.data.filter(F.col("is_train")), self.emb)
        return K.fit_mlp(train, self.top_n, max_iter=self.max_iter)

    def predictions(self, model=None) -> DataFrame:
        model = model or self.fit()
        test = K.pooled_features(self.data.filter(~F.col("is_train")), self.emb)
        return model.transform(test.withColumn("features", array_to_vector("features")))

    def accuracy(self, model=None, ks=DEFAULT_KS) -> DataFrame:
        r = K.mlp_ranks(self.predictions(model), self.top_n).withColumn("n", F.lit(1).cast("bigint"))
        return topk_accuracy(r, ks)


def warm_start_accuracy(events: DataFrame, top_n: int | None = TOP_N, length: int = HISTORY, shift_days: int = 14,
                        max_iter_old: int = 20, max_iter_new: int = 5, ks=DEFAULT_KS, ordered: bool = False) -> DataFrame:
    """K4: a model fitted up to the cutoff, then refitted on later data from scratch
    ("cold") or from its weights aligned by item ("warm"); both scored on later
    held-out sessions with the old (frozen) embeddings. Rows: variant, k, n, hits, accuracy."""
    rows = materialize(split_rows(events, ordered), "mlp-warm-rows")
    cut = initial_cutoff(rows, shift_days).select("cutoff")

    def aged(d: DataFrame) -> DataFrame:
        return d.crossJoin(F.broadcast(cut)).withColumn("is_old", F.col(EVENT_TIME) <= F.col("cutoff")).drop("cutoff")

    ev = aged(rows)
    old_ev = ev.filter(F.col("is_train") & F.col("is_old"))
    new_ev = ev.filter(F.col("is_train") & ~F.col("is_old"))
    old_v = materialize(fit_vocab(old_ev, ITEM), "mlp-old-vocab")
    new_v = materialize(fit_vocab(new_ev, ITEM), "mlp-new-vocab")
    n_old = top_n if top_n is not None else old_v.count()
    n_new = top_n if top_n is not None else new_v.count()
    old_cls = K.class_vocab(old_v, n_old)
    new_cls = K.class_vocab(new_v, n_new)
    # sessions that go on after the cutoff are shorter here, so their rows are ordered and counted again
    emb = materialize(K.item_embeddings(old_ev.select(*EVENT_COLUMNS)), "mlp-warm-embeddings")
    h = materialize(aged(histories(rows, length)), "mlp-warm-histories")

    def features(part, classes: DataFrame, n: int) -> DataFrame:
        return K.pooled_features(K.labelled(h.filter(part), classes, n), emb)

    old_train = features(F.col("is_train") & F.col("is_old"), old_cls, n_old)
    new_train = features(F.col("is_train") & ~F.col("is_old"), new_cls, n_new)
    new_test = features(~F.col("is_train") & ~F.col("is_old"), new_cls, n_new) \
        .withColumn("features", array_to_vector("features"))
    old_model = K.fit_mlp(old_train, n_old, max_iter=max_iter_old)
    w0 = K.warm_start_weights(old_model, old_cls, new_cls, n_old, n_new)
    out = None
    for variant, init in (("cold", None), ("warm", w0)):
        m = K.fit_mlp(new_train, n_new, max_iter=max_iter_new, initial_weights=init)
        r = K.mlp_ranks(m.transform(new_test), n_new).withColumn("n", F.lit(1).cast("bigint"))
        a = topk_accuracy(r, ks).withColumn("variant", F.lit(variant))
        out = a if out is None else out.unionByName(a)
    return out.select("variant", "k", "n", "hits", "accuracy")
