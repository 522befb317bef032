"""Repeats of 100 bytes and more by a partitioned enhanced suffix array.

Texts are cut into super-k-mers of byte windows; those under a minimiser that occurs twice travel
packed to its bucket. There, per slice of whole minimisers:

1. identical packed strings are one repeat group: all but its first occurrence go;
2. the suffixes of the distinct strings are sorted (their first 100 bytes with numpy); classes of
   equal 100-byte prefixes are the top of the common-prefix interval tree;
3. classes whose members all follow the same byte are dropped at once: the same occurrences stand
   one byte further left, so they are no maximal repeats;
4. of the others, the suffixes are ordered to their full length and the longest-common-prefix values
   are scanned with a stack, which yields every interval of the tree with its left extension
   tested; each interval that extends to the left in different ways is a maximal repeat group.

Packed strings are bounded, so a long repeat comes as overlapping groups, whose spans are merged per
document: a byte is removed exactly if some 100-byte string over it also starts earlier.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import LAST_ID, read
from .superkmers import BUCKET_BYTES, HOT, Codec, candidates, digest_rows, equal_windows, packed_runs, scatter, shared_minimisers, \
    survey, unfold, whole_keys

WINDOW = 100
GRAM = 24

BYTE_HASHES = scatter(np.arange(1, 257, dtype=np.uint64))


class ByteCodec(Codec):
    def __init__(self, k: int = WINDOW, m: int = GRAM):
        self.k, self.m = k, min(m, k)

    def split(self, text: bytes):
        return text, BYTE_HASHES[np.frombuffer(text, np.uint8)], lambda a, b: text[a:b]

    def without(self, text: bytes, starts: list[int], ends: list[int]) -> bytes:
        kept, at = [], 0
        for s, e in zip(starts, ends):
            kept.append(text[at:s])
            at = e
        return b"".join(kept) + text[at:]


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


def repeat_intervals(prefix: list[int], left: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the left-diverse intervals of the common-prefix interval tree.

    prefix[i]: common prefix of suffix i - 1 and i in sorted order (prefix[0] unused); left[i]: the
    byte before suffix i, -1 at the start of a string, which differs from everything. Bottom-up
    stack scan; an entry is [length, first, the one left byte of all members or -1].
    """
    stack: list[list[int]] = []
    n = len(left)
    for i in range(1, n + 1):
        length = prefix[i] if i < n else 0
        first, side = i - 1, left[i - 1]
        while stack and length < stack[-1][0]:
            top = stack.pop()
            side = side if side == top[2] else -1
            first = top[1]
            if side == -1:
                yield top[0], first, i - 1
        if length >= least:
            if stack and stack[-1][0] == length:
                stack[-1][2] = side if side == stack[-1][2] else -1
            else:
                stack.append([length, first, side])


def repeat_groups(k: int, strings: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(length, [(string, offset)]): maximal repeats of at least ``k`` bytes in distinct strings."""
    sizes = np.array([len(s) for s in strings], np.int64)
    n = sizes - k + 1
    row = np.repeat(np.arange(len(strings)), n)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    text = np.frombuffer(b"".join(strings), np.uint8)
    at = (np.cumsum(sizes) - sizes)[row] + inside
    view = np.ndarray((len(text) - k + 1,), f"S{k}", text, strides=(1,))
    order, group = equal_windows(view[at])
    before = np.where(inside > 0, text[at - 1].astype(np.int64), -1)[order]
    edge = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(edge, len(order)))
    lo, hi = np.minimum.reduceat(before, edge), np.maximum.reduceat(before, edge)
    diverse = (size > 1) & ((lo != hi) | (lo < 0))
    members = np.flatnonzero(diverse[group])
    if not len(members):
        return
    spots = order[members]
    # full suffix order inside each class of equal first k bytes
    suffix = [strings[r][i:] for r, i in zip(row[spots].tolist(), inside[spots].tolist())]
    cls = group[members].tolist()
    rank = sorted(range(len(spots)), key=lambda j: (cls[j], suffix[j]))
    prefix = [0] + [common_prefix(suffix[a], suffix[b]) if cls[a] == cls[b] else 0 for a, b in zip(rank, rank[1:])]
    left = before[members][rank].tolist()
    place = [(int(row[spots[j]]), int(inside[spots[j]])) for j in rank]
    for length, first, last in repeat_intervals(prefix, left, k):
        yield length, place[first:last + 1]


def fold_copies(ids, h1, start, packed) -> tuple[list[bytes], list[list[int]]]:
    """Distinct packed strings and, for each, its rows by place (document, then start)."""
    rows: dict[bytes, list[int]] = {}
    for i in np.lexsort((start, h1, ids)).tolist():
        rows.setdefault(packed[i], []).append(i)
    return list(rows), list(rows.values())


def compare_bytes(k: int):
    """Spans of all occurrences but the first of every maximal repeat group of a bucket slice."""
    def compare(table):
        ids, h1, start = (table.column(c).to_numpy() for c in ("id", "h1", "start"))
        packed = table.column("packed").to_pylist()
        strings, rows = fold_copies(ids, h1, start, packed)
        # copies that a document folded stand behind the row's own start
        held, place = unfold(table)
        later = np.flatnonzero(held == np.append(-1, held[:-1]))
        row = held[later].tolist()
        s = place[later].tolist()
        e = [a + len(packed[i]) for i, a in zip(row, s)]
        for text, own in zip(strings, rows):
            for i in own[1:]:
                row.append(i)
                s.append(start[i])
                e.append(start[i] + len(text))
        best: dict[tuple[int, int], int] = {}
        for length, group in repeat_groups(k, strings):
            # a place may stand in many nested groups: its longest covers the others
            where = [(ids[rows[r][0]], h1[rows[r][0]], start[rows[r][0]] + i) for r, i in group]
            first = min(range(len(group)), key=where.__getitem__)
            for j, spot in enumerate(group):
                if j != first and best.get(spot, 0) < length:
                    best[spot] = length
        for (r, i), length in best.items():
            row.append(rows[r][0])
            s.append(start[rows[r][0]] + i)
            e.append(start[rows[r][0]] + i + length)
        return np.array(row, np.int64), np.array(s, np.int64), np.array(e, np.int64)
    return compare


def maximal_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(repeat, length, doc_id, start): maximal repeat groups with all their occurrences.

    One row per occurrence; ``repeat`` numbers a group by the digest of its bytes. Exact copies of a
    document are represented by the smallest id. Groups are maximal within the packed text around
    their shared minimiser (up to 2 * window - gram bytes), so longer repeats appear as overlapping
    groups. All minimisers meet in buckets here, hot ones too; the removal uses ``remove_repeats``.
    """
    import xxhash
    codec = ByteCodec(window, gram)
    seen = survey(docs, codec, "repeats")
    shared = shared_minimisers(seen, True, LAST_ID, "repeats")
    cand = candidates(docs, seen, shared, "repeats")

    def run(batches):
        for table in whole_keys(batches, BUCKET_BYTES):
            held, start = unfold(table)
            ids, h1 = (table.column(c).to_numpy()[held] for c in ("id", "h1"))
            packed = table.column("packed").to_pylist()
            strings, rows = fold_copies(ids, h1, start, [packed[i] for i in held.tolist()])
            out = [(xxhash.xxh64_intdigest(t) >> 1, len(t), int(ids[i]), int(start[i]))
                   for t, own in zip(strings, rows) if len(own) > 1 for i in own]
            for length, group in repeat_groups(codec.k, strings):
                r, i = group[0]
                name = xxhash.xxh64_intdigest(strings[r][i:i + length]) >> 1
                out += [(name, length, int(ids[j]), int(start[j]) + i) for r, i in group for j in rows[r]]
            for at in range(0, len(out), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out[at:at + 65536])],
                                                 names=["repeat", "length", "doc_id", "start"])

    dealt = packed_runs(cand, codec).repartition("mh").sortWithinPartitions("mh")
    rows = dealt.mapInArrow(run, "repeat bigint, length bigint, doc_id bigint, start bigint").distinct()
    return rows.withColumn("doc_id", F.nullif("doc_id", F.lit(LAST_ID)))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs`` (doc_id, text).

    Every byte covered by a string of ``window`` bytes that also starts earlier (smaller doc_id, or
    the same document and an earlier start) is removed; overlapping occurrences count, strings are
    judged on the input. Null texts are empty; a null id counts as the largest; rows that share an
    id with different texts are ordered by a digest of the text, identical rows get equal results.
    Empty input gives an empty result.
    """
    rows = digest_rows(docs, ByteCodec(window, gram), compare_bytes(window), True, hot, "suffixes")
    return rows.select("doc_id", rows["n"].alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))
