"""Ordered positions and neighbours within a key, without one task per key.

``row_number() over (partition by k order by o)`` puts every row of a key into one
task; a hot key (one user, one session) then holds a third of the data in a single
task. Here the order is split by *bucket* columns that coarsen it (non-decreasing
along the order, e.g. an hour of ``event_time``):

1. inside each (key, bucket) block: ``row_number`` / ``lead`` / ``lag`` — a window
   whose largest partition is one block, not one key;
2. per block: row count, first and last value — a partial aggregate of the
   un-windowed input (map-side combine), at most one row per block;
3. over the small block table, per key ordered by bucket: running offset, the
   next block's first value, the previous block's last value;
4. join back on (key, bucket): the large side is already hash-partitioned on
   exactly these columns by step 1, so only the small side moves (AQE turns it
   into a broadcast when its measured size allows).

The result equals the plain window on every input (property-tested).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def _cols(xs):
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def ordered_index(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    buckets: Sequence[tuple[str, Column]],
    name: str = "pos",
    start: int = 1,
    next_of: Sequence[str] = (),
    prev_of: Sequence[str] = (),
    key_size: str | None = None,
) -> DataFrame:
    """Add ``name`` = position of the row within ``keys`` along ``order``.

    buckets: (column name, expression) pairs, lexicographically non-decreasing along
      ``order``; together with ``keys`` they bound the largest single window task.
    next_of / prev_of: columns whose value at the following / preceding row of the
      same key is added as ``next_<c>`` / ``prev_<c>`` (NULL at the key's end/start).
    key_size: if given, also add the key's row count under this name.
    """
    keys = list(keys)
    bnames = [b for b, _ in buckets]
    if name in ("_r", "_n", "_off") or name in bnames:
        raise ValueError(f"output name {name!r} collides with an internal column")
    order_cols = _cols(order)
    blk = keys + bnames

    base = df
    for b, expr in buckets:
        base = base.withColumn(b, expr)

    w_in = Window.partitionBy(*blk).orderBy(*order_cols)
    d = base.withColumn("_r", F.row_number().over(w_in))
    for c in next_of:
        d = d.withColumn(f"_nx_{c}", F.lead(c, 1).over(w_in))
    for c in prev_of:
        d = d.withColumn(f"_pv_{c}", F.lag(c, 1).over(w_in))

    # Block summary: count, and first/last values along the order. It is aggregated
    # from the un-windowed input (partial aggregation map-side), so this branch
    # shuffles one partial row per block and partition, never the rows themselves.
    # With an ascending order given by column names the first/last row is
    # min/max_by(struct(order)); other orders fall back to the in-block row number.
    plain = all(isinstance(o, str) for o in order)
    src = base if plain else d
    okey = F.struct(*[F.col(o) for o in order]) if plain else F.col("_r")
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in next_of:
        aggs.append(F.min_by(F.col(c), okey).alias(f"_first_{c}"))
    for c in prev_of:
        aggs.append(F.max_by(F.col(c), okey).alias(f"_last_{c}"))
    blocks = src.groupBy(*blk).agg(*aggs)

    w_key = Window.partitionBy(*keys).orderBy(*[F.col(b) for b in bnames]) if keys else \
        Window.orderBy(*[F.col(b) for b in bnames])
    blocks = blocks.withColumn(
        "_off", F.coalesce(F.sum("_n").over(w_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    for c in next_of:
        blocks = blocks.withColumn(f"_nb_{c}", F.lead(f"_first_{c}", 1).over(w_key))
    for c in prev_of:
        blocks = blocks.withColumn(f"_pb_{c}", F.lag(f"_last_{c}", 1).over(w_key))
    if key_size:
        wk = Window.partitionBy(*keys) if keys else Window.partitionBy()
        blocks = blocks.withColumn(key_size, F.sum("_n").over(wk))
    keep = blk + ["_n", "_off"] + [f"_nb_{c}" for c in next_of] + [f"_pb_{c}" for c in prev_of]
    if key_size:
        keep.append(key_size)
    blocks = blocks.select(*keep)

    out = d.join(blocks, on=blk, how="inner")
    out = out.withColumn(name, (F.col("_off") + F.col("_r") - F.lit(1) + F.lit(start)).cast("bigint"))
    for c in next_of:
        out = out.withColumn(f"next_{c}", F.when(F.col("_r") == F.col("_n"), F.col(f"_nb_{c}"))
                             .otherwise(F.col(f"_nx_{c}")))
    for c in prev_of:
        out = out.withColumn(f"prev_{c}", F.when(F.col("_r") == F.lit(1), F.col(f"_pb_{c}"))
                             .otherwise(F.col(f"_pv_{c}")))
    drop = ["_r", "_n", "_off"] + bnames
    drop += [f"_nx_{c}" for c in next_of] + [f"_nb_{c}" for c in next_of]
    drop += [f"_pv_{c}" for c in prev_of] + [f"_pb_{c}" for c in prev_of]
    return out.drop(*drop)
