"""Positions along an order whose blocks are bounded by the data, not by a fixed width.

``repartitionByRange`` samples the *full* order key (time and id, frequency and text, ...), so one hour
that holds everything, date-only times or ids with one prefix still give blocks of about equal size.
Only rows that are equal in the whole key cannot be told apart; pass a key that ends in an id.

1. rows go to range blocks, are sorted inside them and written with (block, place in the block);
2. per (block, key): rows and first place — at most blocks + keys rows;
3. running offsets over that table give positions; it joins back on (block, key), which no hot key
   overfills, since a key that spans many blocks has one row in each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import materialize

BLOCK, PLACE = "__block", "__place"
_PLACE_BITS = 33  # monotonically_increasing_id: partition in the upper bits, row number in these


def range_blocks(df: DataFrame, order: Sequence[Column | str], name: str = "ranges") -> DataFrame:
    """``df`` written in sorted range blocks; adds ``__block`` and ``__place`` (0-based in the block)."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return materialize(dealt.select("*", F.spark_partition_id().alias(BLOCK), place.alias(PLACE)), name)


def range_index(df: DataFrame, order: Sequence[Column | str], keys: Sequence[str] = (), pos: str = "pos",
                key_start: str | None = None, key_size: str | None = None, name: str = "ranges") -> DataFrame:
    """Add ``pos``: the 0-based position of a row within ``keys`` along ``order``.

    ``order`` starts with the keys themselves, so rows of one key are neighbours. Nulls come first, and
    null keys are one key. key_start: also the global position of the key's first row, a number that
    tells keys apart and orders them as ``order`` does. key_size: also the rows of the key.
    """
    keys = list(keys)
    rows = range_blocks(df, order, name)
    blocks = rows.groupBy(BLOCK).agg(F.count(F.lit(1)).alias("__n"))
    ahead = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    blocks = blocks.select(F.col(BLOCK).alias("__b"), F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__off"))
    per = rows.groupBy(BLOCK, *keys).agg(F.count(F.lit(1)).alias("__n"), F.min(PLACE).alias("__first"))
    per = per.join(F.broadcast(blocks), F.col(BLOCK) == F.col("__b"))  # one row a block
    if keys:
        own = Window.partitionBy(*keys)
        before = F.coalesce(F.sum("__n").over(own.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    else:
        own = Window.partitionBy(F.lit(0))  # one row a block
        before = F.col("__off")
    per = per.select("__b", *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
                     (before - F.col("__first")).alias("__shift"),
                     F.min(F.col("__off") + F.col("__first")).over(own).alias("__start"),
                     F.sum("__n").over(own).alias("__size"))
    same = F.col(BLOCK) == F.col("__b")
    for i, k in enumerate(keys):
        same &= rows[k].eqNullSafe(F.col(f"__k{i}"))
    out = [F.col(c) for c in df.columns] + [(F.col("__shift") + F.col(PLACE)).cast("bigint").alias(pos)]
    out += [F.col("__start").cast("bigint").alias(key_start)] if key_start else []
    out += [F.col("__size").cast("bigint").alias(key_size)] if key_size else []
    return rows.join(per, same).select(*out)
