"""Super-k-mers: consecutive windows that share a minimiser, found with numpy over many texts at once.

A window is ``k`` units (words or bytes), a gram ``m`` units. The minimiser of a window is its
gram with the smallest hash, the leftmost on ties: a function of the window's content alone, so
equal windows have equal minimisers at equal offsets, in whatever text they stand. Consecutive
windows whose minimiser is the same gram at the same place form a super-k-mer of at most
``k - m + 1`` windows; it travels as one packed string instead of as single windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from seqdrift.config import discard, materialize

from .common import LAST_ID, signed, text_chunks

#: Units worked on at once: a position has to fit beside the hash in one sort key.
POSITION_BITS = 24
SPAN = 1 << 22

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def scatter(x: np.ndarray) -> np.ndarray:
    """Mix the bits of 64-bit values (multiply and fold twice)."""
    x = (x ^ (x >> np.uint64(32))) * _MULTIPLY
    x = (x ^ (x >> np.uint64(29))) * _MULTIPLY
    return x ^ (x >> np.uint64(32))


def gram_hashes(units: np.ndarray, m: int) -> np.ndarray:
    """Hash of every gram of ``m`` units, by doubling: a gram of 2a is two grams of a."""
    power = {1: 0xD6E8FEB86659FD93}
    grams = {1: units}
    a = 1
    while 2 * a <= m:
        h = grams[a]
        grams[2 * a] = h[:-a] * np.uint64(power[a]) + h[a:] if len(h) > a else h[:0]
        power[2 * a] = power[a] * power[a] % (1 << 64)
        a *= 2
    out, have = grams[a], a
    for b in sorted(grams, reverse=True):
        if have + b <= m:
            n = len(units) - have - b + 1
            if n <= 0:
                return units[:0]
            out = out[:n] * np.uint64(power[b]) + grams[b][have:have + n]
            have += b
    return scatter(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values, by doubling."""
    have = 1
    while 2 * have <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:len(x) - (w - have)], x[w - have:]) if have < w else x


def runs(units: np.ndarray, owner: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers of concatenated texts: (first window, number of windows, minimiser hash).

    units: 64-bit hashes of the units; owner: the text of each unit, non-decreasing. Windows that
    cross texts are none. A run is also cut where the work is cut (every ``SPAN`` units), which
    changes no window, only how many travel together.
    """
    first, count, least = [], [], []
    w = k - m + 1
    for at in range(0, max(0, len(units) - k + 1), SPAN):
        span = units[at:at + SPAN + k - 1]
        g = gram_hashes(span, m)
        key = (g >> np.uint64(POSITION_BITS) << np.uint64(POSITION_BITS)) | np.arange(len(g), dtype=np.uint64)
        place = (sliding_min(key, w) & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
        own = owner[at:at + len(span)]
        inside = own[:len(place)] == own[k - 1:k - 1 + len(place)]
        change = np.empty(len(place), bool)
        change[0] = True
        change[1:] = (place[1:] != place[:-1]) | (own[1:len(place)] != own[:len(place) - 1]) | (inside[1:] != inside[:-1])
        start = np.flatnonzero(change)
        size = np.diff(np.append(start, len(place)))
        good = inside[start]
        start, size = start[good], size[good]
        first.append(start + at)
        count.append(size)
        least.append(g[place[start]])
    if not first:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(first), np.concatenate(count), np.concatenate(least)


def equal_windows(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, class) of fixed-width byte strings: their sorted order and, along it, class numbers.

    Equality is decided on the bytes themselves, not on a hash.
    """
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    new = np.empty(len(order), bool)
    new[:1] = True
    new[1:] = ranked[1:] != ranked[:-1]
    return order, np.cumsum(new) - 1


def union_of(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint sorted spans covering the same positions (touching spans become one)."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.append(True, s[1:] > e[:-1]))
    return s[new], e[np.append(new[1:] - 1, len(e) - 1)]


# --- the corpus side: which regions of which documents can repeat, and where to compare them ---

#: Documents with one minimiser up to which its packed strings meet in one place. Beyond it the
#: windows are counted one by one with partial aggregates, which no hot key can overfill.
HOT = 4096
#: Runs of one text slice among which copies are folded before the shuffle.
FOLD_RUNS = 8192
#: Packed strings that a task compares at once (more where one minimiser has more).
BUCKET_BYTES = 1 << 20


class Codec:
    """How a text becomes units; see WordCodec (substring.py) and ByteCodec (suffixes.py).

    split(text) -> (canonical bytes, 64-bit unit hashes, slicer); slicer(a, b) gives the packed
    bytes of the units a to b.
    """

    k: int
    m: int

    def split(self, text: bytes):
        raise NotImplementedError

    def scan(self, texts: list[bytes]):
        """(canonical bytes per text, slicers, unit offsets, runs of all texts)."""
        parts = [self.split(t) for t in texts]
        sizes = np.array([len(p[1]) for p in parts], np.int64)
        units = np.concatenate([p[1] for p in parts]) if parts else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(parts)), sizes)
        return [p[0] for p in parts], [p[2] for p in parts], np.cumsum(sizes) - sizes, sizes, owner, \
            runs(units, owner, self.k, self.m)


def keyed(docs: DataFrame) -> DataFrame:
    """(id, k1, k2, text): rows with the key they are found again by, the id with a digest of the text.

    Null ids become LAST_ID; ids may repeat, and rows with one key are equal.
    """
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)).alias("id"),
                       F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), "text")


def survey(docs: DataFrame, codec: Codec, name: str) -> DataFrame:
    """One small row per document, written once: its digest, length and minimisers.

    id (null ids as LAST_ID), k1 and k2 (128-bit digest of the text, see ``keyed``), h1 and h2 (128-bit
    digest of the units), n units, sha256 of the canonical text, mins (distinct minimisers), twice
    (minimisers at two places in it).
    """
    def run(batches):
        for part, texts in text_chunks(batches, "text"):
            canon, _, _, sizes, owner, (first, _, least) = codec.scan(texts)
            own = owner[first] if len(first) else first
            cut = np.searchsorted(own, np.arange(len(texts) + 1))
            mins, twice = [], []
            for i in range(len(texts)):
                values, times = np.unique(least[cut[i]:cut[i + 1]], return_counts=True)
                mins.append(signed(values))
                twice.append(signed(values[times > 1]))
            digest = [xxhash.xxh128_intdigest(c) for c in canon]
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1), part.column(2),
                pa.array(signed(np.array([d >> 64 for d in digest], np.uint64))),
                pa.array(signed(np.array([d & (1 << 64) - 1 for d in digest], np.uint64))),
                pa.array(sizes),
                pa.array([hashlib.sha256(c).hexdigest() for c in canon]),
                pa.array(mins, pa.list_(pa.int64())), pa.array(twice, pa.list_(pa.int64())),
            ], names=["id", "k1", "k2", "h1", "h2", "n", "sha", "mins", "twice"])

    out = keyed(docs).mapInArrow(run, "id bigint, k1 bigint, k2 bigint, h1 bigint, h2 bigint, n bigint, sha string, "
                                      "mins array<bigint>, twice array<bigint>")
    return materialize(out, f"{name}-survey")


def shared_minimisers(seen: DataFrame, within: bool, hot: int, name: str) -> DataFrame:
    """(mh, hot): minimisers of at least two different texts (``within``: or twice in one)."""
    each = seen.select("h1", F.explode("mins").alias("mh"), F.lit(0).alias("again"))
    if within:
        each = each.unionAll(seen.select("h1", F.explode("twice").alias("mh"), F.lit(1).alias("again")))
    count = each.groupBy("mh").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"),
                                   F.count(F.lit(1)).alias("n"), F.max("again").alias("again"))
    return materialize(count.where("lo < hi or again > 0").select("mh", (F.col("n") > hot).alias("hot")),
                       f"{name}-shared")


def candidates(docs: DataFrame, seen: DataFrame, shared: DataFrame, name: str) -> DataFrame:
    """(id, h1, text, mins, hot_mins): the first document of every text with a shared minimiser.

    Exact copies are represented by the smallest id, rows repeated with it by one of them; only these
    texts move on, one row each.
    """
    place = F.struct("id", "k1", "k2")
    rows = seen.groupBy("h1", "h2", "id", "k1", "k2").agg(F.count(F.lit(1)).alias("times"))
    first = rows.groupBy("h1", "h2").agg(F.min(place).alias("place"), F.min_by("times", place).alias("times"))
    first = materialize(first.select("h1", "place.*", "times"), f"{name}-first")
    flags = (seen.select("h1", F.explode("mins").alias("mh")).join(shared, "mh")
             .groupBy("h1").agg(F.collect_set(F.when(~F.col("hot"), F.col("mh"))).alias("mins"),
                                F.collect_set(F.when(F.col("hot"), F.col("mh"))).alias("hot_mins")))
    todo = materialize(first.join(flags, "h1"), f"{name}-todo")
    key = ["id", "k1", "k2"]
    found = keyed(docs).join(todo.where("times = 1"), key).select("id", "h1", "text", "mins", "hot_mins")
    if not todo.where("times > 1").isEmpty():
        again = todo.where("times > 1")
        texts = keyed(docs).join(again.select(*key), key).groupBy(*key).agg(F.min("text").alias("text"))
        found = found.unionAll(texts.join(again, key).select("id", "h1", "text", "mins", "hot_mins"))
    found = materialize(found, f"{name}-candidates")
    discard(first, todo)
    return found


def _regions(batches, codec: Codec, which: str):
    """The runs of candidate texts whose minimiser is listed, one text slice after another."""
    for part, texts in text_chunks(batches, "text"):
        listed = [x.as_py() or [] for x in part.column(part.schema.get_field_index(which))]
        wanted = np.array(sorted({v for x in listed for v in x}), np.int64)
        if not len(wanted):
            continue
        _, slicers, offset, _, owner, (first, count, least) = codec.scan(texts)
        h1 = part.column(part.schema.get_field_index("h1")).to_numpy()
        ids = part.column(part.schema.get_field_index("id")).to_numpy()
        own = owner[first] if len(first) else first
        good = np.flatnonzero(np.isin(signed(least), wanted))
        yield ids, h1, slicers, own[good], (first - offset[own])[good], count[good], signed(least)[good]


def packed_runs(cand: DataFrame, codec: Codec) -> DataFrame:
    """(mh, id, h1, start, packed, more): super-k-mers of the candidates as packed strings.

    Copies inside one document are folded before anything is shuffled: they travel as one row with
    the starts of the others in ``more``. Folding works on a bounded number of runs at a time, so a
    document may still send a string several times.
    """
    def run(batches):
        for ids, h1, slicers, own, start, count, mh in _regions(batches, codec, "mins"):
            for at in range(0, len(own), FOLD_RUNS):
                o, s, c = (x[at:at + FOLD_RUNS].tolist() for x in (own, start, count))
                first: dict[tuple[int, bytes], int] = {}
                more: dict[int, list[int]] = {}
                for j, (i, a, n) in enumerate(zip(o, s, c)):
                    f = first.setdefault((i, slicers[i](a, a + n + codec.k - 1)), j)
                    if f != j:
                        more.setdefault(f, []).append(a)
                stay = np.array(list(first.values()), np.int64)
                o = own[at + stay]
                yield pa.RecordBatch.from_arrays([
                    pa.array(mh[at + stay]), pa.array(ids[o]), pa.array(h1[o]), pa.array(start[at + stay]),
                    pa.array([p for _, p in first], pa.binary()),
                    pa.array([more.get(j, []) for j in first.values()], pa.list_(pa.int64()))],
                    names=["mh", "id", "h1", "start", "packed", "more"])

    return cand.where(F.size("mins") > 0).mapInArrow(
        run, "mh bigint, id bigint, h1 bigint, start bigint, packed binary, more array<bigint>")


def unfold(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(row, start) of all occurrences in a slice of ``packed_runs``, each row's own start first."""
    more = table.column("more").combine_chunks()
    n = more.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.cumsum(n + 1) - (n + 1)
    start = np.empty(int((n + 1).sum()), np.int64)
    other = np.ones(len(start), bool)
    other[at] = False
    start[at] = table.column("start").to_numpy()
    start[other] = more.flatten().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(n)), n + 1), start


def bucket_spans(cand: DataFrame, codec: Codec, compare) -> DataFrame:
    """(id, h1, s, e): spans of units to remove, by comparing the packed strings of each bucket.

    Rows are dealt by minimiser and sorted by it; a task takes whole minimisers, about
    ``BUCKET_BYTES`` of packed strings at a time, so its memory is bounded.
    compare(table of packed_runs) -> arrays (row, first unit, end unit).
    """
    def run(batches):
        for rows in whole_keys(batches, BUCKET_BYTES):
            ids, h1 = (rows.column(i).to_numpy() for i in (1, 2))
            row, s, e = compare(rows)
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(h1[row]), pa.array(s), pa.array(e)],
                                                 names=["id", "h1", "s", "e"])

    dealt = packed_runs(cand, codec).repartition("mh").sortWithinPartitions("mh")
    return dealt.mapInArrow(run, "id bigint, h1 bigint, s bigint, e bigint")


def whole_keys(batches, limit: int):
    """Tables of consecutive rows, cut only where the first column (sorted) changes."""
    held, size = [], 0
    for batch in batches:
        at = 0
        keys = batch.column(0).to_numpy()
        while at < len(batch):
            # take the rest of the open key, then as much as the limit allows
            if held and size >= limit:
                last = held[-1].column(0)[len(held[-1]) - 1].as_py()
                stop = at + int(np.searchsorted(keys[at:], last, side="right"))
                if stop > at:
                    held.append(batch.slice(at, stop - at))
                    at = stop
                if at < len(batch):
                    yield pa.Table.from_batches(held).combine_chunks()
                    held, size = [], 0
                continue
            stop = min(len(batch), at + 1024)
            held.append(batch.slice(at, stop - at))
            size += held[-1].get_total_buffer_size() if len(held[-1]) == len(batch) else held[-1].nbytes
            at = stop
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def hot_spans(cand: DataFrame, codec: Codec, by_place: bool, name: str) -> DataFrame:
    """(id, h1, s, e) for windows of hot minimisers: each window counted by its 128-bit digest.

    The first occurrence per window is a partial aggregate, written once, so that the join back has
    exchanges of its own on both sides and hot windows are dealt to many tasks (skew join). by_place: earlier places in one document count, else smaller ids only.
    """
    def run(batches):
        for ids, h1, slicers, own, start, count, _ in _regions(batches, codec, "hot_mins"):
            if not len(own):
                continue
            row = np.repeat(np.arange(len(own)), count)
            place = start[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            for at in range(0, len(row), 16384):
                o, p = own[row[at:at + 16384]], place[at:at + 16384]
                d = [xxhash.xxh128_intdigest(slicers[i](a, a + codec.k)) for i, a in zip(o.tolist(), p.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(signed(np.array([x >> 64 for x in d], np.uint64))),
                    pa.array(signed(np.array([x & (1 << 64) - 1 for x in d], np.uint64))),
                    pa.array(ids[o]), pa.array(h1[o]), pa.array(p)], names=["w1", "w2", "id", "h1", "s"])

    w = cand.where(F.size("hot_mins") > 0).mapInArrow(run, "w1 bigint, w2 bigint, id bigint, h1 bigint, s bigint")
    place = F.struct("id", "h1", "s") if by_place else F.col("id")
    first = w.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    first = materialize(first.where("n > 1"), f"{name}-hot")
    return (w.join(first.drop("n"), ["w1", "w2"]).where(place > F.col("first"))
            .select("id", "h1", "s", (F.col("s") + codec.k).alias("e")))


def remove_spans(cand: DataFrame, spans: DataFrame, codec: Codec) -> DataFrame:
    """(h1, id, n_removed, n_spans, sha): candidates without their spans."""
    per_doc = spans.groupBy("id", "h1").agg(F.collect_list("s").alias("s"), F.collect_list("e").alias("e"))
    todo = cand.select("id", "h1", "text").join(per_doc, ["id", "h1"])

    def run(batches):
        for part, texts in text_chunks(batches, "text"):
            rows = []
            for t, a, b in zip(texts, part.column(3), part.column(4)):
                s, e = union_of(np.array(a.as_py(), np.int64), np.array(b.as_py(), np.int64))
                kept = codec.without(t, s.tolist(), e.tolist())
                rows.append((int((e - s).sum()), len(s), hashlib.sha256(kept).hexdigest()))
            removed, n, sha = zip(*rows)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(removed, pa.int64()),
                                              pa.array(n, pa.int64()), pa.array(sha)],
                                             names=["id", "h1", "n_removed", "n_spans", "sha"])

    return todo.select("id", "h1", "text", "s", "e").mapInArrow(
        run, "id bigint, h1 bigint, n_removed bigint, n_spans bigint, sha string")


def repeated_spans(docs: DataFrame, codec: Codec, compare, within: bool, hot: int = HOT,
                   name: str = "spans") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(survey without minimisers, candidates, spans to remove of the candidates), all written.

    Each table is written by a job of its own, whose shuffle files go with it, and what only the
    following table needed is deleted: the disk holds one step's shuffle at a time.
    """
    wide = survey(docs, codec, name)
    shared = shared_minimisers(wide, within, hot, name)
    cand = candidates(docs, wide, shared, name)
    seen = materialize(wide.drop("mins", "twice"), f"{name}-seen")
    spans = bucket_spans(cand, codec, compare)
    if not shared.where("hot").isEmpty():
        spans = spans.unionAll(hot_spans(cand, codec, within, name))
    discard(wide, shared)
    return seen, cand, materialize(spans, f"{name}-spans")


def digest_rows(docs: DataFrame, codec: Codec, compare, within: bool, hot: int, name: str) -> DataFrame:
    """(doc_id, n, n_removed, n_spans, sha) of every document.

    A copy of a text that a smaller id has loses everything (if it has a whole window): all its
    windows start there. Other rows take what was removed from their candidate, if anything.
    """
    seen, cand, spans = repeated_spans(docs, codec, compare, within, hot, name)
    cut = materialize(remove_spans(cand, spans, codec), f"{name}-cut")
    discard(cand, spans)
    first = seen.groupBy("h1", "h2").agg(F.min("id").alias("first"))
    told = first.join(cut.select(F.col("id").alias("first"), "h1", "n_removed", "n_spans",
                                 F.col("sha").alias("cut_sha")), ["first", "h1"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    rows = seen.select("id", "h1", "h2", "n", "sha").join(told, ["h1", "h2"])
    copy = (F.col("id") != F.col("first")) & (F.col("n") >= codec.k)
    none = (F.col("id") != F.col("first")) | F.col("n_removed").isNull()
    return rows.select(
        F.nullif("id", F.lit(LAST_ID)).alias("doc_id"), "n",
        F.when(copy, F.col("n")).when(none, 0).otherwise(F.col("n_removed")).cast("bigint").alias("n_removed"),
        F.when(copy, 1).when(none, 0).otherwise(F.col("n_spans")).cast("bigint").alias("n_spans"),
        F.when(copy, nothing).when(none, F.col("sha")).otherwise(F.col("cut_sha")).alias("kept_sha256"))
