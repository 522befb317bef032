"""Name-compatible facade over the operators (same classes and method names as the
original scripts). Every method takes and returns DataFrames; nothing is
collected except the scalars the original methods return (a vocabulary size, a
timestamp, a yes/no).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .config import materialize
from .operators import sessions as S
from .operators import transitions as J
from .operators import vocab as D
from .operators.sampling import exact_sample
from .operators.slices import trailing_window
from .plans.alerts import degradation_alerts
from .schema import EVENT_ID, EVENT_TIME, ITEM, SESSION
from .sources.sinks import append_metrics


def _not_in(rows: DataFrame, other: DataFrame) -> DataFrame:
    """Replay rows that ``other`` does not hold: an event is its session, id, time and item."""
    return rows.join(other.select(*EVENT_KEY).distinct(), EVENT_KEY, "left_anti").select(*rows.columns)


EVENT_KEY = [SESSION, EVENT_ID, EVENT_TIME, ITEM]


class NextItemPredictor:
    """Fit on sessions, recommend next items, score Top-K — the transition model."""

    def __init__(self, embedding_dim: int = 32, history_len: int = 100, tie: str = "idx", fill: bool = True):
        self.embedding_dim = embedding_dim
        self.history_len = history_len
        self.tie = tie
        self.fill = fill
        self.vocab: DataFrame | None = None
        self.model: DataFrame | None = None

    def preprocess_data(self, spark_df: DataFrame, fit_encoders: bool) -> DataFrame:
        """Row numbers per session and item indices (unseen → n_labels, flagged)."""
        if fit_encoders or self.vocab is None:
            self.vocab = D.fit_vocab(spark_df, ITEM)
        rows = S.session_rows(spark_df)
        return D.encode(rows, self.vocab, ITEM, "product_index", unknown="keep")

    def create_sequences(self, spark_df: DataFrame, sequence_length: int | None = None) -> DataFrame:
        """(user_session, row_num, history, target) for every event with a successor."""
        return S.history_pairs(spark_df, sequence_length or self.history_len)

    def build_model(self, n_items: int | None = None):
        return self

    def train(self, spark_df: DataFrame, epochs: int = 0, batch_size: int = 0) -> int:
        self.vocab = materialize(D.fit_vocab(spark_df, ITEM), "facade-vocab")
        self.model = materialize(J.transition_model(S.session_pairs(spark_df)), "facade-model")
        return self.vocab.count()

    def predict_next_items(self, histories: DataFrame, k: int = 50, exclude_items: DataFrame | None = None,
                           key: str = SESSION, whole_history: bool = False) -> DataFrame:
        """Top-k per history key: lists of its last item (followers, popularity fill), or with
        ``whole_history`` recency-weighted scores of the last ``history_len`` items."""
        if whole_history:
            return J.recommend_history(histories, self.model, self.history_len, k, key, self.vocab,
                                       fill=self.fill, exclude=exclude_items)
        last = histories.select(key, F.try_element_at("history", F.lit(-1)).alias("prev_item"))
        lists = J.recommend_topk(self.model, self.vocab, k=k, fill=self.fill, tie=self.tie, exclude=exclude_items)
        hit = last.join(lists, "prev_item", "inner")
        miss = last.join(lists.select("prev_item").distinct(), "prev_item", "left_anti") \
            .crossJoin(F.broadcast(lists.filter(F.col("prev_item").isNull()).drop("prev_item")))
        return hit.select(key, "rank", "item", "score").unionByName(miss.select(key, "rank", "item", "score"))

    def evaluate_top_k(self, test_df: DataFrame, k_values=J.DEFAULT_KS) -> DataFrame:
        tests = J.aggregate_tests(S.session_pairs(test_df))
        r = J.target_ranks(tests, self.model, self.vocab, max(k_values), fill=self.fill, tie=self.tie)
        return J.topk_accuracy(r, k_values)


class ContinualNextItemPredictor(NextItemPredictor):
    """Adds the update clock, trailing-window refits, a replay buffer and a metrics log."""

    def __init__(self, embedding_dim: int = 32, window_size_days: int = 30, update_frequency_days: int = 7,
                 min_pattern_support: int = 10, buffer_size: int = 50, history_len: int = 10,
                 metrics_path: str | None = None):
        super().__init__(embedding_dim, history_len)
        self.window_size_days = window_size_days
        self.update_frequency_days = update_frequency_days
        self.min_pattern_support = min_pattern_support
        self.buffer_size = buffer_size
        self.metrics_path = metrics_path
        self.last_update = None
        self.pattern_memory: DataFrame | None = None
        self.performance_history: DataFrame | None = None

    def needs_update(self, current_time) -> bool:
        if self.last_update is None:
            return True
        return (current_time - self.last_update).days >= self.update_frequency_days

    def _fit(self, df: DataFrame) -> None:
        self.train(df)
        self.pattern_memory = J.follow_stats(S.session_pairs(df), top_k=5, min_support=self.min_pattern_support)
        self.last_update = df.agg(F.max(EVENT_TIME)).first()[0]

    def initial_train_model(self, df: DataFrame) -> None:
        self._fit(df)

    def update_model(self, df: DataFrame, buffer_data: DataFrame | None = None) -> None:
        """Refit on the trailing window of ``df``; with a replay buffer on ``df`` whole, the slice that the
        caller chose, and the buffer rows that are not in it.

        The slice and the training rows are written once: fitting reads them several times, and the buffer's
        rows are looked for among the slice's.
        """
        if buffer_data is None:
            rows = trailing_window(df, self.window_size_days)
        else:
            df = materialize(df, "facade-slice")
            rows = df.unionByName(_not_in(buffer_data.select(*df.columns), df))
        self._fit(materialize(rows, "facade-train"))

    def update_buffer(self, buffer_size: int, buffer_data: DataFrame, train_data: DataFrame,
                      seed: str = "replay") -> DataFrame:
        """Returns the grown buffer: an exact seeded sample of ``train_data`` appended.

        Draws are by (session, event id), since ids need be unique only in their session; a row that
        the buffer has already is not added again, other repeated rows are kept.
        """
        keyed = train_data.withColumn("_key", F.concat_ws("\x1f", F.col(SESSION), F.col(EVENT_ID).cast("string")))
        drawn = exact_sample(keyed, buffer_size, seed=seed, key="_key").select(*buffer_data.columns)
        return buffer_data.unionByName(_not_in(drawn, buffer_data))

    def evaluate_and_log_performance(self, test_df: DataFrame, current_time, run: str = "run") -> DataFrame:
        acc = materialize(self.evaluate_top_k(test_df), "facade-accuracy").withColumn("timestamp", F.lit(current_time).cast("timestamp_ntz")) \
            .withColumn("run", F.lit(run)).withColumn("variant", F.lit("model"))
        hist = acc if self.performance_history is None else self.performance_history.unionByName(acc)
        self.performance_history = hist
        out = degradation_alerts(hist, order="timestamp")
        if self.metrics_path:
            append_metrics(acc, self.metrics_path)
        return out
