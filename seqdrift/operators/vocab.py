"""Frequency vocabularies as tables.

A vocabulary is a DataFrame ``(item, idx, freq)``: idx 0 is the most frequent id,
ties broken by the id's *text* ascending (so ints 9, 10, 100 order as
'10' < '100' < '9'), as a string indexer orders labels.

The global rank is computed without a single-task sort: ``range_index`` cuts the
order (−freq, text) into blocks at bounds sampled from the items themselves, so the
long tail of items seen once is split by text, whatever prefix the ids share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .ordered import ordered_index
from .ranges import range_index


def popularity(df: DataFrame, col: str) -> DataFrame:
    """(item, freq) for every non-null id (F8); a partial+final hash aggregate."""
    return df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("item")) \
        .agg(F.count(F.lit(1)).alias("freq"))


def fit_vocab(df: DataFrame, col: str, prefix_len: int | None = None) -> DataFrame:
    """(item, idx, freq): frequency descending, ties by the id's text ascending.

    prefix_len: rank in blocks of (frequency, first characters of the text) instead, which writes
    no table; only for ids that are known to spread over such prefixes.
    """
    counts = popularity(df, col).withColumn("_txt", F.col("item").cast("string"))
    if prefix_len is not None:
        blocks = [("_nf", -F.col("freq")), ("_pfx", F.substring("_txt", 1, prefix_len))]
        v = ordered_index(counts, [], [F.col("freq").desc(), F.col("_txt").asc()], blocks, name="idx", start=0)
        return v.select("item", "idx", "freq")
    v = range_index(counts, [F.col("freq").desc(), F.col("_txt").asc()], pos="idx", name="vocab")
    return v.select("item", "idx", "freq")


def vocab_size(vocab: DataFrame) -> DataFrame:
    """One-row table ``n_labels`` — a scalar kept as data (broadcast-safe: one row)."""
    return vocab.agg(F.count(F.lit(1)).cast("bigint").alias("n_labels"))


def encode(df: DataFrame, vocab: DataFrame, col: str, out: str, unknown: str = "keep") -> DataFrame:
    """Map ids to indices.

    unknown="keep": unseen or NULL ids get ``n_labels`` (the indexer's extra bucket);
    unknown="minus_one": they get −1; unknown="drop": such rows are removed.
    Adds ``is_unknown``. The vocabulary side is small per item; AQE turns the join
    into a broadcast when its measured size allows, else it is a shuffled hash join.
    """
    v = vocab.select(F.col("item").alias("_vk"), F.col("idx").alias("_vidx"))
    j = df.join(v, df[col] == v["_vk"], "left")
    unk = F.col("_vidx").isNull()
    if unknown == "keep":
        n = vocab_size(vocab)
        j = j.crossJoin(F.broadcast(n))
        idx = F.coalesce(F.col("_vidx"), F.col("n_labels"))
        j = j.withColumn(out, idx).withColumn("is_unknown", unk).drop("n_labels")
    elif unknown == "minus_one":
        j = j.withColumn(out, F.coalesce(F.col("_vidx"), F.lit(-1).cast("bigint"))).withColumn("is_unknown", unk)
    elif unknown == "drop":
        j = j.filter(~unk).withColumn(out, F.col("_vidx")).withColumn("is_unknown", F.lit(False))
    else:
        raise ValueError(unknown)
    return j.drop("_vk", "_vidx")


def decode(df: DataFrame, vocab: DataFrame, col: str, out: str) -> DataFrame:
    """Index → id (D3); indices outside the vocabulary decode to NULL."""
    v = vocab.select(F.col("idx").alias("_di"), F.col("item").alias(out))
    return df.join(v, df[col] == v["_di"], "left").drop("_di")


def remap(old: DataFrame, new: DataFrame) -> DataFrame:
    """Align two vocabulary versions by id (D6): status kept / added / retired."""
    o = old.select(F.col("item"), F.col("idx").alias("old_idx"))
    n = new.select(F.col("item"), F.col("idx").alias("new_idx"))
    j = o.join(n, "item", "full_outer")
    status = F.when(F.col("old_idx").isNull(), F.lit("added")) \
        .when(F.col("new_idx").isNull(), F.lit("retired")).otherwise(F.lit("kept"))
    return j.select("item", "old_idx", "new_idx", status.alias("status"))
