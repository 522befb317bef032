"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is cut into two halves; two fingerprints at most 2 bits apart differ in at
most one bit of some half. Each half is 31 bits under the perfect Hamming code (31, 26), whose
codewords cover all 31-bit strings within radius 1, times one free bit. A fingerprint is *at
home* at the one anchor within radius 1 and is *replicated* to every anchor within covering
radius + half threshold = 2 (at most 17). If a half of x and y differs by at most one bit, then
y lies within 2 of x's home anchor, so the pair meets there: nothing is missed. Fingerprints
meet on (half, anchor) and are compared over all 64 bits.

Exact copies share a fingerprint and are folded before anything is replicated; a fingerprint has
at most 2,080 others within 2 bits, so a large group of near copies stays linear in its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from seqdrift.config import materialize

from .common import row_key, signed, smallest_reachable, text_chunks

SEED = 42
LANES = np.uint64(0x0101010101010101)


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of every shingle (fewer words than ``width``: of the whole sequence; none: empty)."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    parts = map(b" ".join, zip(*(words[i:] for i in range(width))))
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(words) - width + 1)


def majority_bits(hashes: list[np.ndarray]) -> np.ndarray:
    """One fingerprint per array: the bits set in over half of its hashes (empty: zero).

    Eight shifts put each bit into its own byte lane; lanes are summed over at most 255 hashes
    at a time, so a lane never overflows.
    """
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    h = np.concatenate([hashes[i] for i in full])
    n = sizes[full]
    ends = np.cumsum(n)
    blocks = (n + 254) // 255
    owner = np.repeat(np.arange(len(full)), blocks)
    first_block = np.cumsum(blocks) - blocks
    starts = (ends - n)[owner] + (np.arange(len(owner)) - first_block[owner]) * 255
    fp = np.zeros(len(full), np.uint64)
    for s in range(8):
        lanes = np.add.reduceat((h >> np.uint64(s)) & LANES, starts)
        per_byte = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        counts = np.add.reduceat(per_byte, first_block, axis=0)
        bits = (2 * counts > n[:, None]).astype(np.uint64)
        for byte in range(8):
            fp |= bits[:, byte] << np.uint64(8 * byte + s)
    out[full] = fp
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp bigint) of every row: SimHash of the lower-cased (A-Z) word shingles of the whole text.

    Null and empty texts have fingerprint 0. Null ids and repeated rows are kept.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, "text"):
            fp = majority_bits([shingle_hashes(t.lower().split(), shingle) for t in texts])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(signed(fp))], names=["id", "fp"])

    return d.mapInArrow(run, f"id {d.schema['id'].dataType.simpleString()}, fp bigint")


# Hamming (31, 26): bit i (0-based) has syndrome i + 1; the codewords are the strings of syndrome 0.
CHECKS = np.array([sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1) for j in range(5)], np.uint64)
#: For each syndrome s, the patterns of weight 1 and 2 with that syndrome.
ONE = np.array([0] + [1 << (s - 1) for s in range(1, 32)], np.uint64)
TWO = np.array([[0] * 15] + [[(1 << (p - 1)) | (1 << ((p ^ s) - 1)) for p in range(1, 32) if p < p ^ s]
                             for s in range(1, 32)], np.uint64)


def syndrome(x: np.ndarray) -> np.ndarray:
    s = np.zeros(len(x), np.int64)
    for j, mask in enumerate(CHECKS):
        s |= (np.bitwise_count(x & mask) & 1).astype(np.int64) << j
    return s


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home anchors of 32-bit halves, and (row, anchor) of all anchors within distance 2."""
    free = np.uint64(1 << 31)
    code = half & np.uint64((1 << 31) - 1)
    s = syndrome(code)
    home = half ^ ONE[s]
    rows = np.arange(len(half))
    off = np.flatnonzero(s)
    # the home anchor; the home anchor with the free bit flipped; codewords two bits away
    every = [home, home ^ free, (half[off, None] ^ TWO[s[off]]).ravel()]
    return home, np.concatenate([rows, rows, np.repeat(off, 15)]), np.concatenate(every)


def replicate(fps: DataFrame, home: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for part in range(2):
                half = (x >> np.uint64(32 * part)) & np.uint64(0xFFFFFFFF)
                at_home, row, anchor = anchors(half)
                fp, key = (x, at_home) if home else (x[row], anchor)
                key = key | np.uint64(part << 32)
                yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(signed(fp))], names=["anchor", "fp"])

    return fps.select("fp").mapInArrow(run, "anchor bigint, fp bigint")


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """All pairs (a < b) of distinct fingerprints at most ``max_bits`` (0 to 2) bits apart."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the code covers thresholds of 0 to 2 bits")
    home = replicate(fps, True).withColumnRenamed("fp", "a")
    near = replicate(fps, False).withColumnRenamed("fp", "b")
    # the planner takes a replicated side for as small as the file it comes from and would broadcast it
    met = home.join(near.hint("merge"), "anchor").where(
        (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) per row: components of fingerprints linked at ``max_bits`` or fewer bits.

    ``component_id`` is the smallest id reachable; null ids count as none (a component of null ids
    only has a null component). Empty texts link like any other (fingerprint 0). Repeated rows give
    repeated results. Empty input gives an empty result. Tables of a row per fingerprint are never broadcast:
    with their struct keys they take several times their file's size in the driver's memory.
    """
    fp = materialize(fingerprints(docs, shingle, id_col, text_col), "simhash-fp")
    least = fp.groupBy("fp").agg(F.min("id").alias("first_id"))
    distinct = materialize(least, "simhash-distinct")
    root = smallest_reachable(links(distinct, max_bits), name="simhash-links")
    named = materialize(
        distinct.join(root.hint("merge"), distinct["fp"] == root["node"], "left")
        .select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    component = named.join(smallest.hint("merge"), "root").select("fp", "component_id")
    return fp.join(component.hint("merge"), "fp").select("id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` without near-duplicates: the row with the smallest doc_id of each component stays.

    Rows are told apart by (doc_id, digest of the text); of rows that share an id the smaller digest
    comes first, null ids come last. Of rows with the staying id and text one stays. Rows with
    neither id nor text hold nothing to compare and stay. Extra columns stay as they are.
    """
    if "doc_id" not in docs.columns:
        raise ValueError("docs needs a column doc_id")
    key = F.struct(F.col("doc_id").isNull().alias("none"), row_key(F.col("doc_id"), F.col("text")).alias("row"))
    blank = F.col("doc_id").isNull() & F.col("text").isNull()
    rows = docs.where(~blank)
    found = materialize(near_duplicates(rows.select(key.alias("doc_id"), "text"), shingle, max_bits), "simhash-found")
    stay = materialize(found.where("id = component_id").groupBy(F.col("id").alias("staying"))
                       .agg(F.count(F.lit(1)).alias("times")), "simhash-stay")
    # the columns of docs travel as one value, so that no name of theirs meets one of these
    whole = rows.select(key.alias("row_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = whole.join(stay.hint("merge"), F.col("row_id") == F.col("staying"))
    once = kept.where("times = 1").select("row")
    if not stay.where("times > 1").isEmpty():
        rest = [F.col("row")[c].cast("string") for c in docs.columns if c not in ("doc_id", "text")]
        again = kept.where("times > 1").groupBy("row_id").agg(F.min_by("row", F.xxhash64(F.lit(0), *rest)).alias("row"))
        once = once.unionAll(again.select("row"))
    return once.select("row.*").unionByName(docs.where(blank))


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    from .common import read
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")
