"""Helpers shared by the text operators: words, batch iteration, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seqdrift.config import materialize, table_path

#: Words of the contracts: runs of characters that are no ASCII white space. ``bytes.split()``
#: without an argument splits on exactly these six characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Sorts null document ids behind all others.
LAST_ID = 2 ** 63 - 1

#: Bytes of text that a Python task works on at once.
CHUNK_BYTES = 1 << 20


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def words_of(text: Column) -> Column:
    """Array of the words of a text (null text: no words), JVM-side."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def row_key(doc_id: Column, text: Column) -> Column:
    """Key of a row that ids may share: the id with a 128-bit digest of the text; never null."""
    return F.struct(doc_id.alias("id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))


#: Rows of a narrow table up to which it is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 1_000_000


def sized(table: DataFrame, rows: int) -> DataFrame:
    """Broadcast ``table`` if its counted rows allow it."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def hash_sample(rows: DataFrame, column: str, n: int, seed: int) -> list[str]:
    """At most ``n`` distinct texts of a column on the driver: those with the smallest hashes.

    The hashes are ranked alone, so no task sends more than n numbers for the ranking, and copies of
    one text count once.
    """
    h = rows.select(F.col(column), F.xxhash64(column, F.lit(seed)).alias("h"))
    last = h.select("h").distinct().orderBy("h").limit(n).agg(F.max("h")).first()[0]
    if last is None:
        return []
    chosen = h.where(F.col("h") <= last).groupBy("h").agg(F.min(column).alias("text"))
    return [r["text"] for r in chosen.orderBy("h").collect()]


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it.

    Adjacent projections are merged, which copies an expression to every use of its column, into
    lambdas too; a lambda variable is bound to the computed value.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_chunks(batches: Iterator[pa.RecordBatch], text_col: str,
                limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with the texts as UTF-8 bytes, about ``limit`` bytes each.

    A batch may hold thousands of very long texts; working slice by slice bounds what
    numpy needs beside it. One longer text is a slice of its own.
    """
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text_col)).cast(pa.large_binary())
        start = 0
        while start < len(batch):
            end, size, texts = start, 0, []
            while end < len(batch) and (end == start or size < limit):
                t = col[end].as_py() or b""
                texts.append(t)
                size += len(t)
                end += 1
            yield batch.slice(start, end - start), texts
            start = end


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def smallest_reachable(links: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """Connected components of an undirected link table of two bigint columns.

    Returns (node, root): every node with a link and the smallest node it reaches. Alternating
    large-star and small-star passes (Kiveris et al., 2014): each pass replaces links by links
    to the smallest neighbour, so long chains collapse in a logarithmic number of passes. The
    smallest neighbour is a partial aggregate, never a list, so a hub is no large group. Each
    pass is written to the shared folder, and two numbers come back to the driver.
    """
    spark = links.sparkSession
    hi, lo = F.greatest(F.col(a), F.col(b)), F.least(F.col(a), F.col(b))
    edges = materialize(links.where(F.col(a) != F.col(b)).select(hi.alias("u"), lo.alias("v")).distinct(), name)

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    last = mark(edges)
    if last[0] == 0:
        return spark.createDataFrame([], "node bigint, root bigint")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        edges = materialize(large.where("u != v"), name)
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = (edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).distinct())
        edges = materialize(small.where("u != v"), name)
        now = mark(edges)
        if now == last:
            break
        last = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
