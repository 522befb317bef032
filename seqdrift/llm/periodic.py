"""Runs (maximal repetitions) of words, by constant-time common extensions over a difference cover.

``Extensions`` answers "how many words agree from places a and b on": only the suffixes at places of a
difference cover are sorted; a query compares fewer than ``COVER`` words until both places are in the
cover, then takes the minimum of the common prefixes between their ranks from a sparse table. The
runs come from the harmonic grid: for every period q, a run of at least three periods holds two
neighbouring grid places, multiples of q, whose extensions to the right and left give the whole run.
All work is done with numpy over many texts at once; the sort is made only for texts in which some
comparison gets as far as the cover.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import read, text_chunks

LEAST_WORDS = 24
LEAST_PERIODS = 3
#: Modulus of the difference cover; places are sampled if their remainder is in the cover.
COVER = 32
#: Grid places compared at once.
PAIRS = 1 << 19


def difference_cover(v: int) -> list[int]:
    """A small set of remainders whose differences are all remainders modulo ``v``, chosen greedily."""
    cover, have = [0], {0}
    while len(have) < v:
        gain = lambda c: len({(c - x) % v for x in cover} | {(x - c) % v for x in cover} | have)
        best = max(range(v), key=lambda c: (gain(c), -c))
        have |= {(best - x) % v for x in cover} | {(x - best) % v for x in cover}
        cover.append(best)
    return sorted(cover)


class Extensions:
    """Common extensions to the right in one array of positive word numbers, texts set apart by unique ones."""

    def __init__(self, units: np.ndarray, v: int = COVER):
        self.n, self.v = len(units), v
        # the end differs from every word, and from itself at any other place
        self.units = np.concatenate([units, int(units.max(initial=0)) + 1 + np.arange(2 * v, dtype=units.dtype)])
        cover = difference_cover(v)
        self.shift = np.zeros((v, v), np.int64)
        for a in range(v):
            for b in range(v):
                self.shift[a, b] = next(d for d in range(v) if (a + d) % v in cover and (b + d) % v in cover)
        places = np.arange(self.n)
        self.places = places[np.isin(places % v, cover)]
        self.number = np.full(self.n + 1, -1, np.int64)
        self.number[self.places] = np.arange(len(self.places))
        self._sort()

    def _sort(self) -> None:
        """Ranks of the sampled suffixes by doubling, all levels kept until neighbours are compared."""
        v, p = self.v, self.places
        wide = np.ndarray((len(self.units) - v + 1,), f"S{4 * v}", self.units.astype(">u4"), strides=(4,))
        _, rank = np.unique(wide[p], return_inverse=True)
        levels, reach = [rank], v
        while len(p) and rank.max() + 1 < len(p):
            ahead = np.where(p + reach < self.n, self.number[np.minimum(p + reach, self.n)], -1)
            pair = rank * (len(p) + 1) + np.where(ahead >= 0, rank[ahead] + 1, 0)
            _, rank = np.unique(pair, return_inverse=True)
            levels.append(rank)
            reach *= 2
        self.rank = rank
        order = np.argsort(rank, kind="stable")
        a, b = p[order[:-1]], p[order[1:]]
        common = np.zeros(len(a), np.int64)
        for j in range(len(levels) - 1, -1, -1):
            x, y = self._at(a + common), self._at(b + common)
            same = (x >= 0) & (y >= 0)
            same[same] = levels[j][x[same]] == levels[j][y[same]]
            common += np.where(same, v << j, 0)
        common += self._plain(a + common, b + common, np.full(len(a), v))
        self.table = [common.astype(np.int32)]
        while len(self.table[-1]) > 1 << len(self.table) - 1:
            last, half = self.table[-1], 1 << len(self.table) - 1
            self.table.append(np.minimum(last[:-half], last[half:]))

    def _at(self, places: np.ndarray) -> np.ndarray:
        return np.where(places < self.n, self.number[np.minimum(places, self.n)], -1)

    def _plain(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that agree, compared one by one, ``most`` at most (never more than the modulus)."""
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(most > 0)
        for t in range(self.v):
            if not len(live):
                break
            x, y = a[live] + t, b[live] + t
            good = (x < self.n) & (y < self.n)
            good[good] = self.units[x[good]] == self.units[y[good]]
            live = live[good]
            out[live] = t + 1
            live = live[most[live] > t + 1]
        return out

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of words that agree from places a and b on (a and b differ)."""
        near = self.shift[a % self.v, b % self.v]
        out = self._plain(a, b, near)
        far = np.flatnonzero((out == near) & (a + near < self.n) & (b + near < self.n))
        if len(far):
            x, y = self.rank[self.number[a[far] + near[far]]], self.rank[self.number[b[far] + near[far]]]
            lo, hi = np.minimum(x, y), np.maximum(x, y)
            level = np.frexp((hi - lo).astype(np.float64))[1] - 1
            got = np.empty(len(far), np.int64)
            for j in np.unique(level).tolist():
                m = level == j
                got[m] = np.minimum(self.table[j][lo[m]], self.table[j][hi[m] - (1 << j)])
            out[far] += got
        return out


def grid(sizes: np.ndarray, offset: np.ndarray, periods: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, period) of the harmonic grid of every text, ``PAIRS`` places at a time.

    For each period q up to a ``periods``-th of a text: the multiples of q that have another q later.
    """
    most = sizes // periods
    text = np.repeat(np.arange(len(sizes)), most)
    q = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    count = (sizes[text] - 1) // q if len(text) else q
    ends = np.cumsum(count)
    at, done = 0, 0
    while at < len(q):
        # whole (text, period) rows; one row alone may be longer, and is cut
        stop = max(at + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
        for first in range(0, int(count[at]) if stop == at + 1 else 1, PAIRS):
            c = np.minimum(count[at:stop] - first, PAIRS) if stop == at + 1 else count[at:stop]
            row = np.repeat(np.arange(at, stop), c)
            step = np.arange(len(row)) - np.repeat(np.cumsum(c) - c, c) + first
            yield text[row], offset[text[row]] + step * q[row], q[row]
        at, done = stop, int(ends[stop - 1])


class Stretches:
    """Runs around grid places, with extensions in both directions over the texts that need them.

    The sorted suffixes are kept from call to call, as one long text may send its places in many parts.
    """

    def __init__(self, units: np.ndarray, sizes: np.ndarray, v: int):
        self.units, self.sizes, self.offset, self.v = units, sizes, np.cumsum(sizes) - sizes, v
        self.chosen = np.empty(0, np.int64)

    def choose(self, chosen: np.ndarray) -> None:
        if len(chosen) == len(self.chosen) and (chosen == self.chosen).all():
            return
        size = self.sizes[chosen]
        start = np.cumsum(size + 1) - (size + 1)
        some = np.empty(int((size + 1).sum()), np.int64)
        inner = np.arange(len(some)) - np.repeat(start, size + 1)
        word = inner < np.repeat(size, size + 1)
        some[word] = self.units[np.repeat(self.offset[chosen], size) + inner[word]] + 1
        # each text is followed by a number of its own
        some[~word] = int(self.units.max()) + 2 + np.arange(len(chosen))
        some = some.astype(np.uint32)
        self.chosen, self.start, self.m = chosen, start, len(some)
        self.right, self.left = Extensions(some, self.v), Extensions(some[::-1].copy(), self.v)

    def __call__(self, text, place, q, need, least: int, periods: int) -> np.ndarray:
        """Rows (text, start, length, period) of the stretches of period q around the places."""
        self.choose(np.unique(text))
        i = self.start[np.searchsorted(self.chosen, text)] + place - self.offset[text]
        ahead = self.right(i, i + q)
        good = np.flatnonzero(ahead >= need)
        text, place, q, i, ahead = text[good], place[good], q[good], i[good], ahead[good]
        # to the left: to the right in the reversed array
        behind = np.zeros(len(i), np.int64)
        inner = np.flatnonzero(i > 0)
        behind[inner] = self.left(self.m - i[inner], self.m - i[inner] - q[inner])
        length = behind + q + ahead
        good = np.flatnonzero(length >= np.maximum(least, periods * q))
        rows = np.stack([text, place - self.offset[text] - behind, length, q], axis=1)[good]
        return np.unique(rows, axis=0)


def find_runs(units: np.ndarray, sizes: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS,
              v: int = COVER) -> list[tuple[int, int, int, int]]:
    """(text, start, length, period) of all runs, sorted; units: word numbers of all texts in a row.

    A run has at least ``least`` words and ``periods`` times its smallest period (two or more), and
    no neighbouring word keeps the period.
    """
    offset = np.cumsum(sizes) - sizes
    stretches, rows, held = Stretches(units, sizes, v), [np.empty((0, 4), np.int64)], []

    def flush():
        if held:
            rows.append(stretches(*np.concatenate(held, axis=1), least, periods))
            held.clear()

    for text, place, q in grid(sizes, offset, periods):
        # from its first grid place a run goes on, past the next one, for its length less two periods
        need = np.maximum(least - 2 * q, (periods - 2) * q) + 1
        live = np.flatnonzero(place + q + need <= offset[text] + sizes[text])
        for t in range(least // periods + 1):
            later = np.minimum(place[live] + q[live] + t, len(units) - 1)
            live = live[(units[later - q[live]] == units[later]) | (need[live] <= t)]
        if len(live):
            held.append(np.stack([text[live], place[live], q[live], need[live]]))
        if sum(x.shape[1] for x in held) >= PAIRS:
            flush()
    flush()
    found = np.unique(np.concatenate(rows), axis=0)
    # a multiple of the smallest period gives the same stretch again
    keep = np.append(True, (found[1:, :3] != found[:-1, :3]).any(axis=1))[:len(found)]
    return [tuple(r) for r in found[keep].tolist()]


def planted(words: list, doc_id: int | None) -> list:
    """The words of a document as the contract repeats them; a row without an id is left as it is."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a:a + p]
    return words[:a] + (period * (-(-(n - a) // p)))[:n - a]


def without_runs(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run covers after its first period; runs: (start, length, period) by start."""
    kept, at = [], 0
    for s, e in sorted((s + q, s + n) for s, n, q in runs):
        if s > at:
            kept += words[at:s]
        at = max(at, e)
    return kept + words[at:]


def find_periodic_runs(docs: DataFrame, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS, plant: bool = False) -> DataFrame:
    """(doc_id, runs, collapsed): runs of words of every text, and the text with each run cut to one period.

    runs: array of (start, length, period) by start, then period; collapsed: kept words joined by one space.
    plant: first repeat words as the contract of op12 says. Null and empty texts have no words, no runs
    and an empty collapsed text; repeated rows and ids are judged each by itself. Other columns are not
    read. Texts are worked on about a megabyte at a time, a longer one alone. Empty input: empty result.
    """
    def run(batches):
        for part, texts in text_chunks(batches, "text"):
            ids = part.column(0).to_pylist()
            words = [t.split() for t in texts]
            if plant:
                words = [planted(w, i) for w, i in zip(words, ids)]
            sizes = np.array([len(w) for w in words], np.int64)
            flat = pa.array([x for w in words for x in w], pa.large_binary())
            units = flat.dictionary_encode().indices.to_numpy().astype(np.int64) if len(flat) else np.empty(0, np.int64)
            runs: dict[int, list] = {}
            for t, s, n, q in find_runs(units, sizes, least, periods):
                runs.setdefault(t, []).append((s, n, q))
            out = [sorted(runs.get(t, []), key=lambda r: (r[0], r[2])) for t in range(len(words))]
            kept = [b" ".join(without_runs(w, r)) for w, r in zip(words, out)]
            yield pa.RecordBatch.from_arrays([
                part.column(0),
                pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in out], RUNS),
                pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    rows = find_periodic_runs(read(spark, sf_dir, "documents"), plant=True)
    # exact order of the fractions by cross multiplication; the runs already stand by start, then period
    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda b, r: F.when(
        b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    rows = rows.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"),
                       F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                       F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
