"""Item embeddings by factorising a co-occurrence table, and alignment of embedding spaces (K1, K4).

* ``cooccurrence``: how often two items lie at most ``window`` events apart in a session. Events meet in
  the overlapping chunks of ``history_windows``, so no context is cut and no session is gathered whole.
* ``ppmi``: positive pointwise mutual information of those counts.
* ``factorise``: randomised subspace iteration. The item vectors are a distributed table throughout; the
  driver sees (dim + extra)² sums per step and nothing that grows with the catalogue.
* ``align``: orthogonal Procrustes rotation on the shared items, from dim² sums; ``place_new`` puts items
  that have no vector yet at the weighted mean of their neighbours.

Empty tables give empty tables; a null item is no item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from ..config import discard, materialize
from .sessions import history_windows, session_rows

VECTORS = "item bigint, vector array<double>"


# -- counts ------------------------------------------------------------------------
def cooccurrence(events: DataFrame, window: int = 5) -> DataFrame:
    """(item, context, n): ordered pairs of events of one session, 1 … window rows apart, in both directions.

    An item beside itself counts in both directions as well. Pairs are counted in one direction first
    (partial aggregates), and only those counts are mirrored.
    """
    return cooccurrence_of_rows(session_rows(events), window)


def cooccurrence_of_rows(rows: DataFrame, window: int = 5) -> DataFrame:
    """``cooccurrence`` of rows that carry ``row_num``; a null item keeps its number and counts for no pair."""
    h = history_windows(rows, window + 1, carry=())
    older = F.slice("history", 1, F.size("history") - 1)
    pairs = h.filter(F.size("history") > 1).select(F.element_at("history", -1).alias("item"), F.explode(older).alias("context"))
    one_way = pairs.filter(F.col("item").isNotNull() & F.col("context").isNotNull()) \
        .groupBy("item", "context").agg(F.count(F.lit(1)).alias("n"))
    both = F.array(F.struct("item", "context", "n"),
                   F.struct(F.col("context").alias("item"), F.col("item").alias("context"), "n"))
    return one_way.select(F.inline(both)).groupBy("item", "context").agg(F.sum("n").cast("bigint").alias("n"))


def ppmi(counts: DataFrame) -> DataFrame:
    """(item, context, n, weight): max(0, ln(n · total / (n_item · n_context))), rows above zero only."""
    sums = counts.groupBy("item").agg(F.sum("n").alias("_ni"))
    total = F.broadcast(counts.agg(F.sum("n").alias("_t")))  # one row
    d = counts.join(sums, "item").join(sums.select(F.col("item").alias("context"), F.col("_ni").alias("_nc")), "context")
    share = F.col("n").cast("double") * F.col("_t") / (F.col("_ni").cast("double") * F.col("_nc"))
    return d.crossJoin(total).select("item", "context", "n", F.log(share).alias("weight")).filter(F.col("weight") > 0)


# -- small matrices beside distributed vectors ------------------------------------------
def _cross_sums(rows: DataFrame, a: str, b: str, width: int) -> np.ndarray:
    """Σ over rows of a·bᵀ (width × width): one partial sum a task, added up by Spark."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = np.zeros((width, width))
        for part in batches:
            if len(part):
                s += np.stack(part["a"].to_numpy()).T @ np.stack(part["b"].to_numpy())
        yield pd.DataFrame({"s": [s.reshape(-1)]})

    sums = rows.select(F.col(a).alias("a"), F.col(b).alias("b")).mapInPandas(partial, "s array<double>")
    out = np.zeros(width * width)
    for r in sums.select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect():  # width² rows
        out[r["i"]] = r["v"]
    return out.reshape(width, width)


def _turn(vectors: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Every vector times ``matrix`` (a small constant)."""
    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                yield pd.DataFrame({"item": part["item"], "vector": list(np.stack(part["vector"].to_numpy()) @ matrix)})

    return vectors.select("item", "vector").mapInPandas(multiply, VECTORS)


def _neighbour_sums(pairs: DataFrame, vectors: DataFrame, metric) -> DataFrame:
    """(item, vector): ``metric`` of its contexts' vectors by weight."""
    v = vectors.select(F.col("item").alias("context"), array_to_vector("vector").alias("_v"))
    s = pairs.join(v, "context").groupBy("item").agg(metric(F.col("_v"), F.col("weight")).alias("_s"))
    return s.select("item", vector_to_array("_s").alias("vector"))


def _orthonormal(vectors: DataFrame, width: int, name: str) -> tuple[DataFrame, int]:
    """The same column space with orthonormal columns; directions without weight go. Takes a written table and deletes it."""
    values, axes = np.linalg.eigh(_cross_sums(vectors, "vector", "vector", width))
    keep = values > values.max(initial=0.0) * 1e-12
    out = materialize(_turn(vectors, axes[:, keep] / np.sqrt(values[keep])), name)
    discard(vectors)
    return out, int(keep.sum())


def factorise(pairs: DataFrame, dim: int = 32, extra: int = 8, rounds: int = 3, seed: int = 42) -> tuple[DataFrame, list[float]]:
    """((item, vector), signs) of a symmetric table (item, context, weight): weight ≈ Σ signs·vector·vector.

    The ``dim`` largest eigenvalues by size, fewer if the rank is lower. ``extra`` columns and ``rounds``
    of multiplication bring the subspace near the true one. Starting signs come from a hash of the item.
    """
    pairs = materialize(pairs.select("item", "context", "weight"), "factor-pairs")
    width = dim + extra
    start = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.when(
        F.xxhash64(F.col("item"), F.lit(seed), j).bitwiseAND(F.lit(1)) == 0, F.lit(1.0)).otherwise(F.lit(-1.0)))
    q = pairs.select("item").distinct().select("item", start.alias("vector"))
    for r in range(rounds):
        y = materialize(_neighbour_sums(pairs, q, Summarizer.sum), f"factor-product-{r}")
        if r:
            discard(q)
        q, width = _orthonormal(y, width, f"factor-basis-{r}")
    product = _neighbour_sums(pairs, q, Summarizer.sum).withColumnRenamed("vector", "product")
    small = _cross_sums(q.join(product, "item"), "vector", "product", width)
    values, axes = np.linalg.eigh((small + small.T) / 2)
    top = np.argsort(-np.abs(values), kind="stable")[:dim]
    vectors = materialize(_turn(q, axes[:, top] * np.sqrt(np.abs(values[top]))), "factor-vectors")
    discard(pairs, q)
    return vectors, [float(s) for s in np.sign(values[top])]


# -- K4: spaces ----------------------------------------------------------------------------
def align(old: DataFrame, new: DataFrame, dim: int) -> DataFrame:
    """``old`` rotated (and mirrored, if that fits better) onto ``new`` by their shared items.

    Without shared items the sums are zero and the rotation is an arbitrary one.
    """
    both = old.select("item", F.col("vector").alias("a")).join(new.select("item", F.col("vector").alias("b")), "item")
    left, _, right = np.linalg.svd(_cross_sums(both, "a", "b", dim))
    return _turn(old, left @ right)


def place_new(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """``vectors`` and, for items of ``pairs`` without one, the weighted mean of their contexts' vectors.

    An item with no known context stays out.
    """
    fresh = pairs.join(vectors.select("item"), "item", "left_anti")
    return vectors.select("item", "vector").unionByName(_neighbour_sums(fresh, vectors, Summarizer.mean))


__all__ = ["cooccurrence", "ppmi", "factorise", "align", "place_new"]
