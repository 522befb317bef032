"""Quality rules: length-normalised log-likelihood ratio of hashed n-grams, trusted target over raw corpus.

Two multinomials over hashed n-grams are counted over the distinct texts of the whole corpus, once for
all of them (raw) and once for the trusted ones (target): byte 3-grams, and word 1- and 2-grams, each in
``BUCKETS`` buckets. However often a text is copied, it counts once, as trusted if any copy is. A document's score is the mean over its n-grams of log p(target) - log p(raw), added over
the two tables; documents under the fixed ``THRESHOLD`` are rejected. Trusted documents are those
labelled with quality 1. The prior grows with the trusted part, so a larger table of the same kind
gives the same verdicts. Counting folds each task's n-grams into one array before anything is
shuffled, and the tables (131,072 pairs of counts) are bounded by the parameter, not by the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from seqdrift.config import materialize

from .common import read, sized, text_chunks
from .superkmers import gram_hashes, scatter

BUCKETS = 1 << 16
SHIFT = np.uint64(48)
BYTE_GRAM = 3
#: Counts of the prior beside a bucket: this share of the trusted n-grams of its table, at every size.
PRIOR_SHARE = 1e-4
#: Rejection below this score. Clean documents score around 0.1, with few trusted ones down to -0.2;
#: documents of symbols, bars, shouting or stuttering mostly score under -0.4.
THRESHOLD = -0.25

MIN_WORDS = 10
REPEAT_GRAM = 5
REPEAT_PERCENT = 20

BYTE_HASHES = scatter(np.arange(1, 257, dtype=np.uint64))
SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))


def _grams(units: np.ndarray, owner: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the grams of ``m`` units that lie in one text, and the texts' numbers."""
    if len(units) < m:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    g = gram_hashes(units, m)
    inside = owner[:len(g)] == owner[m - 1:m - 1 + len(g)]
    return g[inside], owner[:len(g)][inside]


def _owner(parts: list) -> np.ndarray:
    return np.repeat(np.arange(len(parts)), [len(p) for p in parts])


class Slice:
    """Word hashes and n-gram buckets of a few texts."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        words = [t.split() for t in texts]
        self.n_words = np.array([len(w) for w in words], np.int64)
        self.word_owner = _owner(words)
        self.word_units = np.fromiter((xxhash.xxh64_intdigest(x) for w in words for x in w), np.uint64,
                                      int(self.n_words.sum()))

    def buckets(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per table: bucket numbers and the texts they come from."""
        raw = [np.frombuffer(t, np.uint8) for t in self.texts]
        units = BYTE_HASHES[np.concatenate(raw)] if raw else np.empty(0, np.uint64)
        g, own = _grams(units, _owner(raw), BYTE_GRAM)
        pair, pair_own = _grams(self.word_units, self.word_owner, 2)
        one = scatter(self.word_units)
        return [((g >> SHIFT).astype(np.int64), own),
                ((np.concatenate([one, pair]) >> SHIFT).astype(np.int64), np.concatenate([self.word_owner, pair_own]))]

    def repeat_words(self) -> np.ndarray:
        """Words inside 5-word windows that their text has twice or more."""
        n = len(self.word_units)
        if n < REPEAT_GRAM:
            return np.zeros(len(self.texts), np.int64)
        g = gram_hashes(self.word_units, REPEAT_GRAM)
        own = self.word_owner[:len(g)]
        place = np.flatnonzero(own == self.word_owner[REPEAT_GRAM - 1:])
        if not len(place):
            return np.zeros(len(self.texts), np.int64)
        key = scatter(g[place] ^ scatter(own[place].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key)
        ranked = key[order]
        same = ranked[1:] == ranked[:-1]
        twice = place[order[np.append(same, False) | np.append(False, same)]]
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + REPEAT_GRAM, -1)
        return np.bincount(self.word_owner[np.cumsum(cover[:n]) > 0], minlength=len(self.texts))

    def base(self) -> dict[str, np.ndarray]:
        chars, symbols, dup_lines = [], [], []
        for t in self.texts:
            chars.append(len(t.translate(None, SPACE + CONTINUATION)))
            symbols.append(len(t) - len(t.translate(None, SYMBOLS)))
            lines = [x for x in t.split(b"\n") if x.strip(SPACE)]
            dup_lines.append(len(lines) - len(set(lines)))
        repeat = self.repeat_words()
        as_long = lambda x: np.array(x, np.int64)
        return {"n_words": self.n_words, "word_chars": as_long(chars), "n_symbols": as_long(symbols),
                "n_dup_lines": as_long(dup_lines), "n_repeat_words": as_long(repeat),
                "base_failed": (self.n_words < MIN_WORDS) | (100 * repeat > REPEAT_PERCENT * self.n_words)}


def text_weights(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(h1, h2, weight, good): texts with copies or a trusted row, by the 128-bit digest of the text.

    weight: one over the number of rows with the text. Only digests and ids are shuffled. Texts that
    are not listed stand in one row and are not trusted.
    """
    good = materialize(trusted.select(F.col("doc_id").alias("_good")).where("_good is not null").distinct(), "rules-trusted")
    rows = docs.where("text is not null").select("doc_id", *_digest())
    rows = rows.join(sized(good, good.count()), F.col("doc_id") == F.col("_good"), "left")
    each = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("_good").isNotNull().cast("int")).alias("good"))
    return materialize(each.where("n > 1 or good > 0").select("h1", "h2", (1 / F.col("n")).alias("weight"), "good"),
                       "rules-texts")


def _digest() -> list[Column]:
    return [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]


def count_ngrams(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """Counts [target / raw][table][bucket] over the distinct texts of ``docs``; trusted: (doc_id).

    Each row counts by one over its copies, and the sums are rounded to the whole numbers they stand
    for. The digests of copied and trusted texts are counted and sent to the texts if few enough;
    beyond that the texts are shuffled to them.
    """
    listed = text_weights(docs, trusted)
    rows = docs.where("text is not null").select("text", *_digest()).join(sized(listed, listed.count()), ["h1", "h2"], "left")
    rows = rows.select("text", F.coalesce("weight", F.lit(1.0)).alias("weight"), F.coalesce("good", F.lit(0)).alias("good"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2 * BUCKETS))
        for part, texts in text_chunks(batches, "text"):
            weight = part.column(1).to_numpy()
            target = weight * part.column(2).to_numpy()
            for table, (bucket, own) in enumerate(Slice(texts).buckets()):
                at = slice(table * BUCKETS, (table + 1) * BUCKETS)
                total[1, at] += np.bincount(bucket, weight[own], BUCKETS)
                total[0, at] += np.bincount(bucket, target[own], BUCKETS)
        used = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[0, used]), pa.array(total[1, used])],
                                         names=["bucket", "target", "raw"])

    counts = (rows.mapInArrow(run, "bucket bigint, target double, raw double")
              .groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")))
    out = np.zeros((2, 2 * BUCKETS), np.int64)
    for r in counts.collect():  # at most 2 * BUCKETS rows
        out[0, r["bucket"]], out[1, r["bucket"]] = round(r["target"]), round(r["raw"])
    return out.reshape(2, 2, BUCKETS)


def log_ratio(counts: np.ndarray) -> np.ndarray:
    """log p(target) - log p(raw) per table and bucket; zero where nothing is trusted.

    The target is smoothed towards the raw corpus: a bucket gets the prior's counts beside what it has
    and what the raw share lets expect. A rare n-gram, which a clean document outside the small
    trusted part is full of, then says little; only well-counted ones speak.
    """
    target, raw = counts
    total = counts.sum(axis=2, keepdims=True)
    expected = raw * (total[0] / np.maximum(total[1], 1))
    prior = PRIOR_SHARE * total[0]
    return np.where(total[0] > 0, np.log((target + prior) / (expected + prior)), 0.0)


def scores(part: Slice, ratio: np.ndarray) -> np.ndarray:
    score = np.zeros(len(part.texts))
    for table, (bucket, own) in enumerate(part.buckets()):
        n = np.bincount(own, minlength=len(score))
        score += np.bincount(own, weights=ratio[table][bucket], minlength=len(score)) / np.maximum(n, 1)
    return score


def _ratio(docs: DataFrame, trusted: DataFrame):
    return docs.sparkSession.sparkContext.broadcast(log_ratio(count_ngrams(docs, trusted)))


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, base counts, base_failed, kept, score) of every row of ``docs`` (doc_id, text).

    trusted: (doc_id) of the target documents. Null texts have no words and fail; null ids and
    repeated rows are judged like others; without trusted documents only the base rules reject.
    """
    ratio = _ratio(docs, trusted)
    d = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, "text"):
            s = Slice(texts)
            base, score = s.base(), scores(s, ratio.value)
            base |= {"kept": ~base["base_failed"] & (score >= threshold), "score": score}
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, base.values())], names=["doc_id", *base])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_words bigint, word_chars bigint, "
                             "n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
                             "kept boolean, score double")


def keep_good(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns."""
    ratio = _ratio(docs, trusted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, "text"):
            s = Slice(texts)
            yield part.filter(pa.array(~s.base()["base_failed"] & (scores(s, ratio.value) >= threshold)))

    return docs.mapInArrow(run, docs.schema)


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select("doc_id")


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"), trusted_ids(read(spark, sf_dir, "labels")))
