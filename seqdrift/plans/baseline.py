"""The single-split protocol: train on a seeded share of sessions, score the rest.

Split by session (C1, an md5 test per row: no shuffle) → session pairs (one pass for
both sides, pairs never cross sessions) → vocabulary and transition model from the
training side → Top-K accuracy of the test side, all k at once.

The split log, the vocabulary and one pair aggregate ``(is_train, prev, next) → cnt``
are written once (shared folder) and every branch — model, follower ranks, fill
candidates, test pairs — reads them: the sessionized log is computed once per run
instead of once per branch.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from ..config import materialize
from ..operators.sampling import split_sessions
from ..operators.sessions import pairs_from_rows, session_pairs
from ..operators.transitions import DEFAULT_KS, target_ranks, topk_accuracy
from ..operators.vocab import fit_vocab
from ..schema import EVENT_ID, EVENT_TIME, ITEM, SESSION, USER


def split_parts(events: DataFrame, frac: float = 0.8, seed: str = ""):
    """Lazy (events with is_train, train pairs, test pairs, training vocabulary)."""
    ev = split_sessions(events, frac, seed)
    pairs = session_pairs(ev)
    train_pairs = pairs.filter(F.col("is_train"))
    test_pairs = pairs.filter(~F.col("is_train"))
    vocab = fit_vocab(ev.filter(F.col("is_train")), ITEM)
    return ev, train_pairs, test_pairs, vocab


class SplitProtocol:
    """``ordered=True``: the log already carries ``row_num`` and ``next_<item>`` (e.g. the
    fused clicks sessionizer). The split keeps whole sessions, so those successors stay
    valid and the pairs need no further shuffle."""

    def __init__(self, events: DataFrame, frac: float = 0.8, seed: str = "", ordered: bool = False):
        self.raw = events
        self.frac = frac
        self.seed = seed
        self.ordered = ordered

    @cached_property
    def events(self) -> DataFrame:
        cols = [EVENT_ID, EVENT_TIME, USER, ITEM, SESSION, "is_train"]
        if self.ordered:
            cols += ["row_num", f"next_{ITEM}", *(c for c in self.raw.columns if c == "session_len")]
        ev = split_sessions(self.raw, self.frac, self.seed).select(*cols)
        return materialize(ev, "split-events")

    @cached_property
    def vocab(self) -> DataFrame:
        return materialize(fit_vocab(self.events.filter(F.col("is_train")), ITEM), "split-vocab")

    @cached_property
    def pair_counts(self) -> DataFrame:
        pairs = pairs_from_rows(self.events) if self.ordered else session_pairs(self.events)
        p = pairs.groupBy("is_train", "prev_item", "next_item") \
            .agg(F.count(F.lit(1)).cast("bigint").alias("cnt"))
        return materialize(p, "split-pair-counts")

    @property
    def model(self) -> DataFrame:
        return self.pair_counts.filter(F.col("is_train")).select("prev_item", "next_item", "cnt")

    @property
    def tests(self) -> DataFrame:
        return self.pair_counts.filter(~F.col("is_train")).select(
            "prev_item", F.col("next_item").alias("target"), F.col("cnt").alias("n"))

    def accuracy(self, ks=DEFAULT_KS, fill: bool = True, tie: str = "idx") -> DataFrame:
        ranked = target_ranks(self.tests, self.model, self.vocab, max(ks), fill=fill, tie=tie)
        return topk_accuracy(ranked, ks)


def split_topk_accuracy(events: DataFrame, frac: float = 0.8, seed: str = "", ks=DEFAULT_KS,
                        fill: bool = True, tie: str = "idx", ordered: bool = False) -> DataFrame:
    """(k, n, hits, accuracy) of the transition model on held-out sessions."""
    return SplitProtocol(events, frac, seed, ordered).accuracy(ks, fill, tie)
