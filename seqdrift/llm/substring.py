"""Substring deduplication over windows of 50 words by super-k-mer partitioning.

Minimisers (over 8-word grams) cut each text into super-k-mers. A first pass finds minimisers that
different texts share; only super-k-mers under those can hold a repeated window. They travel as
packed strings to the bucket of their minimiser, where all windows are sorted and counted by their
word sequences, exactly.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from .common import read
from .superkmers import HOT, Codec, digest_rows, equal_windows, unfold

WINDOW = 50
GRAM = 8


class WordCodec(Codec):
    def __init__(self, k: int = WINDOW, m: int = GRAM):
        self.k, self.m = k, min(m, k)

    def split(self, text: bytes):
        words = text.split()
        units = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        return b" ".join(words), units, lambda a, b: b" ".join(words[a:b])

    def without(self, text: bytes, starts: list[int], ends: list[int]) -> bytes:
        words, kept, at = text.split(), [], 0
        for s, e in zip(starts, ends):
            kept += words[at:s]
            at = e
        return b" ".join(kept + words[at:])


def compare_words(k: int):
    """Windows of the packed strings that also start in a document with a smaller id."""
    def compare(table):
        ids, start, packed = table.column("id").to_numpy(), table.column("start").to_numpy(), table.column("packed").to_pylist()
        number: dict[bytes, int] = {}
        words, sizes = [], []
        for p in packed:
            w = p.split(b" ")
            sizes.append(len(w))
            words += [number.setdefault(x, len(number)) for x in w]
        sizes = np.array(sizes, np.int64)
        units = np.array(words, np.uint32)
        n = sizes - k + 1
        row = np.repeat(np.arange(len(packed)), n)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = (np.cumsum(sizes) - sizes)[row] + inside
        view = np.ndarray((len(units) - k + 1,), f"S{4 * k}", units, strides=(4,))
        order, group = equal_windows(view[at])
        own = ids[row]
        edge = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        least = np.minimum.reduceat(own[order], edge)
        dup = np.empty(len(row), bool)
        dup[order] = own[order] > least[group]
        # consecutive removed windows of one packed string become one span
        begin = dup & ~np.where(inside > 0, np.append(False, dup[:-1]), False)
        end = dup & ~np.append(np.where(inside[1:] > 0, dup[1:], False), False)
        b, e = np.flatnonzero(begin), np.flatnonzero(end)
        # a folded copy in the same document loses what its first occurrence loses
        held, place = unfold(table)
        at = np.searchsorted(held, np.arange(len(packed) + 1))
        times = np.diff(at)[row[b]]
        span = np.repeat(np.arange(len(b)), times)
        copy = at[row[b]][span] + np.arange(len(span)) - np.repeat(np.cumsum(times) - times, times)
        return row[b][span], place[copy] + inside[b][span], place[copy] + inside[e][span] + k
    return compare


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of ``docs`` (doc_id, text).

    Every word covered by a window that also starts in a document with a smaller doc_id is removed;
    windows are judged on the input. Null texts have no words. A null id counts as the largest id.
    Rows that share an id are not smaller than each other. Empty input gives an empty result.
    """
    rows = digest_rows(docs, WordCodec(window, gram), compare_words(window), False, hot, "substring")
    return rows.select("doc_id", rows["n"].alias("n_words"), "n_removed", "kept_sha256")


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))
