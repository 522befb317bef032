"""Array helpers for fixed-length history vectors (higher-order functions, JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def left_pad(seq: Column, length: int, pad: int = -1) -> Column:
    """Keep the last ``length`` elements and left-pad to exactly ``length``."""
    n = F.size(seq)
    tail = F.when(n > length, F.slice(seq, n - length + 1, length)).otherwise(seq)
    fill = F.array_repeat(F.lit(pad).cast("bigint"), F.greatest(F.lit(length) - n, F.lit(0)))
    return F.concat(fill, tail)


def clamp_ids(seq: Column, n_items: Column | int, replacement: int = 0) -> Column:
    """Ids outside ``[0, n_items)`` become ``replacement`` (out-of-range history ids)."""
    n = F.lit(n_items) if isinstance(n_items, int) else n_items
    return F.transform(seq, lambda x: F.when((x >= 0) & (x < n), x).otherwise(F.lit(replacement).cast("bigint")))


def render(seq: Column, sep: str = ",") -> Column:
    """Text form of an id array, for engine-neutral comparison."""
    return F.array_join(F.transform(seq, lambda x: x.cast("string")), sep)
