"""Scoring a whole item catalogue by inner products (K2, K3), in place of a classifier as wide as the catalogue.

* ``projected_vectors``: integer item vectors by random indexing, Σ over contexts of count · ±1 with signs from a hash.
* ``history_vectors``: the sum of the vectors of a history's items.
* ``top_items``: the k items with the largest inner product for every query vector. Exact by default; with
  ``cells`` (``fit_cells``) a query meets only the cells it points at, whose items are scored exactly.
* ``target_ranks``: 1 + the number of items that score above the target (K3), exact.

Vectors travel packed: about ``CHUNK`` items or distinct queries are one row, and pairs of rows meet by an equi-join
on (cell, chunk) and are multiplied in numpy. An exact run meets the stated queries with all items, in blocks; a
large cell is many chunks. The catalogue never reaches the driver: it sees one norm and the cells' centres.

Empty tables give empty answers; null ids and null or empty vectors are no items and no queries. Ties go to the
smaller item. Sums of integer vectors are exact below 2⁵³.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from ..config import materialize
from .sampling import exact_sample

CHUNK = 256
SAMPLE = 20_000  #: rows that cells are fitted on; every row is assigned to one


class Cells(NamedTuple):
    """Centres (n, dim + 1) of unit vectors, and the norm that the items were scaled by."""

    centres: np.ndarray
    norm: float


# -- vectors -----------------------------------------------------------------------------
def projected_vectors(counts: DataFrame, dim: int = 32) -> DataFrame:
    """(item, vector array<double>) of (item, context, n): component j adds n where bit j of a context's
    md5 is set and takes it off otherwise. ``dim`` is at most 128, in steps of 4."""
    if not 0 < dim <= 128 or dim % 4:
        raise ValueError("dim must be 4, 8, … 128")
    bits = F.conv(F.substring(F.md5(F.col("context").cast("string")), F.col("_j") + 1, F.lit(1)), 16, 10).cast("int")
    signs = F.explode(F.sequence(F.lit(0), F.lit(dim // 4 - 1))).alias("_j")
    c = counts.filter(F.col("item").isNotNull() & F.col("context").isNotNull()).select("item", "context", "n", signs) \
        .select("item", "_j", "n", bits.alias("_b"))
    sums = c.groupBy("item", "_j").agg(F.array(*[
        F.sum(F.when(F.col("_b").bitwiseAND(F.lit(8 >> p)) > 0, F.col("n")).otherwise(-F.col("n"))).cast("double")
        for p in range(4)]).alias("_v"))
    parts = F.array_sort(F.collect_list(F.struct("_j", "_v")))  # dim / 4 rows an item
    return sums.groupBy("item").agg(parts.alias("_p")).select("item", F.flatten(F.transform("_p", lambda p: p["_v"])).alias("vector"))


def history_vectors(histories: DataFrame, vectors: DataFrame, key: list[str], dim: int) -> DataFrame:
    """(key…, vector): the sum over the history's items that have a vector; histories without one have no row."""
    e = histories.select(*key, F.explode("history").alias("item")).groupBy(*key, "item").agg(F.count(F.lit(1)).alias("_n"))
    v = e.join(vectors, "item")
    return v.groupBy(*key).agg(F.array(*[F.sum(F.col("_n") * F.col("vector")[j]) for j in range(dim)]).alias("vector"))


# -- cells ---------------------------------------------------------------------------------
def _unit(v: np.ndarray, norm: float) -> np.ndarray:
    """Items scaled to the unit ball and lifted onto the sphere: the order by angle is that by inner product."""
    v = v / norm if norm else v
    return np.hstack([v, np.sqrt(np.maximum(0.0, 1.0 - (v * v).sum(1, keepdims=True)))])


def _squares() -> Column:
    return F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)


def fit_cells(vectors: DataFrame, n: int = 64, sample: int = SAMPLE, seed: int = 42) -> Cells:
    """``n`` centres by k-means on at most ``sample`` items drawn by hash; for an empty table none."""
    vectors = _usable(vectors, "item")
    norm = float(np.sqrt(vectors.agg(F.max(_squares()).alias("s")).first()["s"] or 0.0))
    root = F.aggregate("_u", F.lit(0.0), lambda a, x: a + x * x)
    u = exact_sample(vectors, sample, seed=str(seed), key="item") \
        .select(F.transform("vector", lambda x: x / F.lit(norm or 1.0)).alias("_u"))
    u = materialize(u.select(array_to_vector(F.concat("_u", F.array(F.sqrt(F.greatest(F.lit(0.0), 1 - root))))).alias("features")),
                    "cell-sample")
    if not u.head(1):
        return Cells(np.zeros((0, 0)), norm)
    return Cells(np.array(KMeans(k=n, seed=seed, maxIter=20).fit(u).clusterCenters()), norm)


def _assigned(rows: DataFrame, cells: Cells, probes: int, query: bool) -> DataFrame:
    """``rows`` (_id, vector) with a column cell: an item's nearest one, a query's ``probes`` best."""
    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                v = np.stack(part["vector"].to_numpy())
                c = cells.centres
                score = v @ c[:, :-1].T if query else 2 * _unit(v, cells.norm) @ c.T - (c * c).sum(1)
                best = np.argsort(-score, axis=1, kind="stable")[:, :probes]
                yield pd.DataFrame({"_id": np.repeat(part["_id"].to_numpy(), best.shape[1]), "vector": list(np.repeat(v, best.shape[1], axis=0)),
                                    "cell": best.reshape(-1)})

    return rows.select("_id", "vector").mapInPandas(nearest, "_id bigint, vector array<double>, cell int")


# -- packed rows -----------------------------------------------------------------------------
def _usable(rows: DataFrame, key: str) -> DataFrame:
    return rows.filter(F.col(key).isNotNull() & (F.size("vector") > 0)).select(F.col(key).cast("bigint").alias(key), "vector")


def _packed(rows: DataFrame, prefix: str) -> DataFrame:
    """(cell, chunk, chunks, ids, values): about CHUNK rows (_id, vector, cell[, bar, target]) in one, by hash of the id."""
    carried = [c for c in ("bar", "target") if c in rows.columns]
    sizes = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    d = rows.join(F.broadcast(sizes), "cell").withColumn("chunk", F.pmod(F.xxhash64("_id"), F.col("chunks")).cast("int"))
    d = d.groupBy("cell", "chunk", "chunks").agg(F.array_sort(F.collect_list(F.struct("_id", "vector", *carried))).alias("_r"))
    return d.select("cell", "chunk", "chunks", F.col("_r._id").alias(f"{prefix}_ids"),
                    F.flatten("_r.vector").alias(f"{prefix}_values"), *[F.col(f"_r.{c}").alias(c) for c in carried])


def _pairs(items: DataFrame, queries: DataFrame) -> DataFrame:
    """Every query chunk beside every item chunk of its cell."""
    items = materialize(_packed(items, "i"), "packed-items")
    chunks = F.broadcast(items.groupBy("cell").agg(F.max("chunks").alias("_n")))  # one row a cell
    q = _packed(queries, "q").drop("chunk", "chunks").join(chunks, "cell")
    q = q.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    return items.drop("chunks").join(q, ["cell", "chunk"]).drop("cell", "chunk")


def _scores(row) -> np.ndarray:
    i, q = np.asarray(row.i_values), np.asarray(row.q_values)
    return q.reshape(len(row.q_ids), -1) @ i.reshape(len(row.i_ids), -1).T


def top_items(queries: DataFrame, vectors: DataFrame, k: int = 10, key: str = "user_session",
              cells: Cells | None = None, probes: int = 8) -> DataFrame:
    """(key, rank, item, score) of queries (key, vector) against items (item, vector).

    Equal query vectors are scored once. ``cells`` None: exact, all items. Otherwise an item that lies in
    none of a query's ``probes`` cells can be missed.
    """
    vectors = _usable(vectors, "item").withColumnRenamed("item", "_id")
    keyed = queries.filter(F.size("vector") > 0).select(key, "vector")
    q = materialize(keyed.select("vector").distinct().withColumn("_id", F.monotonically_increasing_id()), "distinct-queries")
    if cells is None or not len(cells.centres):
        i, p = vectors.withColumn("cell", F.lit(0)), q.withColumn("cell", F.lit(0))
    else:
        i, p = _assigned(vectors, cells, 1, False), _assigned(q, cells, probes, True)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for row in part.itertuples():
                s = _scores(row)
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]  # ids ascend in a chunk: ties go to the smaller
                yield pd.DataFrame({"_id": np.repeat(row.q_ids, top.shape[1]), "item": np.asarray(row.i_ids)[top].reshape(-1),
                                    "score": np.take_along_axis(s, top, 1).reshape(-1)})

    found = _pairs(i, p).mapInPandas(best, "_id bigint, item bigint, score double")
    r = found.selectExpr("*", "row_number() over (partition by _id order by score desc, item) as rank") \
        .filter(F.col("rank") <= k)
    return keyed.join(q, "vector").join(r, "_id").select(key, F.col("rank").cast("bigint").alias("rank"), "item", "score")


def target_ranks(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(vector, target, n, rank) of queries (vector, target, n): 1 + the items that score above the target.

    Null for a target without a vector or a query without one.
    """
    vectors = _usable(vectors, "item")
    own = vectors.select(F.col("item").alias("target"), F.col("vector").alias("_t"))
    dot = F.aggregate(F.zip_with("vector", "_t", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    q = materialize(queries.select("vector", "target", "n").join(own, "target", "left").withColumn(
        "bar", F.when(F.size("vector") > 0, dot)).drop("_t").withColumn("_id", F.monotonically_increasing_id()), "target-queries")
    asked = q.filter(F.col("bar").isNotNull()).select("_id", "vector", F.lit(0).alias("cell"), "bar", "target")

    def above(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for row in part.itertuples():
                over = (_scores(row) > np.asarray(row.bar)[:, None]) & (np.asarray(row.i_ids)[None, :] != np.asarray(row.target)[:, None])
                yield pd.DataFrame({"_id": row.q_ids, "over": over.sum(1)})

    items = vectors.select(F.col("item").alias("_id"), "vector", F.lit(0).alias("cell"))
    over = _pairs(items, asked).mapInPandas(above, "_id bigint, over bigint").groupBy("_id").agg(F.sum("over").alias("over"))
    return q.join(over, "_id", "left").select("vector", "target", "n", (F.col("over") + 1).cast("bigint").alias("rank"))
