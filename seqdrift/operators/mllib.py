"""Learned next-item models on MLlib (K1–K4), re-aimed from a driver-side recurrent net.

* K1 ``item_embeddings``: Word2Vec over session sequences. Sentences are the bounded
  chunks of ``session_sequences`` (never one giant array per session).
* K2 ``fit_mlp``: MLlib's multilayer perceptron over the mean of the embeddings of
  the last L history items; one class per training-vocabulary item plus one class
  for unseen targets (always a miss). The output layer (hidden × classes weights)
  is held by the optimizer on the driver: its size grows with the item catalogue,
  not with the data. An explicit ``top_n`` caps the classes (the rest → "other").
  MLlib's classifier gives the initial weights and the model that predicts; between
  them its training steps (``lbfgs.minimise``) take the mean loss and gradient from
  numpy over Arrow batches, several times faster than row blocks on the JVM.
* K3 ``mlp_ranks``: rank of the target class in each probability vector without a
  sort: 1 + #classes with a larger probability ("other" is never a hit).
* K4 ``warm_start_weights``: initial weights for a new model from an old one; the
  hidden layers are copied, output rows are aligned by *item id* (old class of the
  same item), new items start at zero; embeddings are reused (frozen).

Weight layout of a Spark MLP (per layer, in order): the out×in weight matrix in
column-major order (entry (o, i) at i·out + o), then the out biases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, functions as F, types as T

from ..config import discard, materialize
from .lbfgs import minimise
from .sessions import sequences_from_rows, session_sequences

EMBED_DIM = 32
HIDDEN = 64


def item_embeddings(events: DataFrame, dim: int = EMBED_DIM, window: int = 5, seed: int = 42,
                    chunk_len: int = 1024, max_iter: int = 1, ordered: bool = False) -> DataFrame:
    """K1: (item, vector array<double>) for every item of the log. ``ordered``: the events carry ``row_num``
    and ``session_len`` already."""
    seqs = (sequences_from_rows if ordered else session_sequences)(events, min_len=2, chunk_len=chunk_len) \
        .select(F.transform("items", lambda x: x.cast("string")).alias("tokens"))
    w2v = Word2Vec(vectorSize=dim, windowSize=window, minCount=1, seed=seed, maxIter=max_iter,
                   inputCol="tokens", outputCol="_v")
    m = w2v.fit(seqs)
    return m.getVectors().select(F.col("word").cast("bigint").alias("item"),
                                 vector_to_array("vector").alias("vector"))


def class_vocab(vocab: DataFrame, top_n: int) -> DataFrame:
    """(item, cls): the top_n items by frequency get classes 0…top_n−1; others fall to top_n."""
    return vocab.filter(F.col("idx") < top_n).select("item", F.col("idx").alias("cls"))


def pooled_features(hist_pairs: DataFrame, emb: DataFrame, dim: int = EMBED_DIM) -> DataFrame:
    """Adds ``features`` array<double>: mean embedding of each history (unknown items are skipped; none known → zeros).

    The embeddings (catalogue × dim numbers, half of an output layer) are looked up from a broadcast, so no
    history is exploded, shuffled and gathered again.
    """
    known = emb.select("item", "vector").toArrow().sort_by("item")
    ids = known["item"].to_numpy()
    vectors = pc.list_flatten(known["vector"]).to_numpy().reshape(-1, dim)
    table = hist_pairs.sparkSession.sparkContext.broadcast((ids, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = table.value
        for batch in batches:
            h = batch.column(batch.schema.get_field_index("history"))
            item = pc.list_flatten(h)
            owner = pc.list_parent_indices(h).to_numpy()
            valid = item.is_valid().to_numpy(zero_copy_only=False)
            item = item.fill_null(0).to_numpy()
            at = np.minimum(np.searchsorted(ids, item), max(len(ids) - 1, 0))
            found = np.flatnonzero(valid & (ids[at] == item)) if len(ids) else np.empty(0, np.int64)
            mean = np.zeros((len(batch), dim))
            if len(found):
                owners, first, n = np.unique(owner[found], return_index=True, return_counts=True)
                mean[owners] = np.add.reduceat(vectors[at[found]], first) / n[:, None]
            offsets = pa.array(np.arange(0, mean.size + 1, dim, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, mean.ravel())],
                                             names=[*batch.schema.names, "features"])

    schema = T.StructType([*hist_pairs.schema.fields, T.StructField("features", T.ArrayType(T.DoubleType()))])
    return hist_pairs.mapInArrow(run, schema)


def labelled(feats: DataFrame, classes: DataFrame, top_n: int) -> DataFrame:
    c = classes.select(F.col("item").alias("target"), "cls")
    return feats.join(c, "target", "left").withColumn(
        "label", F.coalesce(F.col("cls"), F.lit(top_n)).cast("double")).drop("cls")


def _mlp(spark, layers: list[int], seed: int, weights=None):
    """MLlib's model with the given weights, or with the initial ones of its seed: no step is taken."""
    mlp = MultilayerPerceptronClassifier(layers=layers, maxIter=0, seed=seed, featuresCol="features", labelCol="label")
    if weights is not None:
        mlp.setInitialWeights(Vectors.dense(weights))
    return mlp.fit(spark.createDataFrame([(Vectors.dense([0.0] * layers[0]), 0.0)], ["features", "label"]))


def _layers(w: np.ndarray, dim: int, hidden: int, out: int):
    """(W1, b1, W2, b2) as views of the flat weights; matrices are in×out."""
    cut = np.cumsum([dim * hidden, hidden, hidden * out])
    w1, b1, w2, b2 = np.split(w, cut)
    return w1.reshape(dim, hidden), b1, w2.reshape(hidden, out), b2


def mean_loss(rows: DataFrame, w: np.ndarray, dim: int, hidden: int, out: int) -> tuple[float, np.ndarray]:
    """Mean cross entropy of (features array<double>, label int) rows and its gradient at the flat weights ``w``.

    A task sends one number a weight, summed by Spark; the driver gets as many numbers as there are weights.
    """
    weights = rows.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w1, b1, w2, b2 = _layers(weights.value, dim, hidden, out)
        total = np.zeros(len(weights.value) + 2)
        g1, gb1, g2, gb2 = _layers(total[:-2], dim, hidden, out)
        for batch in batches:
            every = batch.column(0).flatten().to_numpy().reshape(-1, dim)
            labels = batch.column(1).to_numpy()
            step = max(1, (1 << 18) // out)
            for s in range(0, len(labels), step):
                x, y = every[s:s + step], labels[s:s + step]
                at = np.arange(len(y))
                h = 1 / (1 + np.exp(-(x @ w1 + b1)))
                d = h @ w2
                d += b2
                d -= d.max(axis=1, keepdims=True)
                own = d[at, y]
                np.exp(d, out=d)
                z = d.sum(axis=1, keepdims=True)
                total[-2] += (np.log(z[:, 0]) - own).sum()
                d /= z
                d[at, y] -= 1
                g2 += h.T @ d
                gb2 += d.sum(axis=0)
                e = d @ w2.T
                e *= h * (1 - h)
                g1 += x.T @ e
                gb1 += e.sum(axis=0)
            total[-1] += len(labels)
        for s in range(0, len(total), 1 << 16):
            part = total[s:s + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(s, s + len(part))), pa.array(part)], names=["i", "v"])

    sums = rows.mapInArrow(run, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow().sort_by("i")
    weights.destroy()
    v = sums["v"].to_numpy()
    return v[-2] / v[-1], v[:-2] / v[-1]


def fit_mlp(train: DataFrame, top_n: int, dim: int = EMBED_DIM, hidden: int = HIDDEN, max_iter: int = 20,
            seed: int = 42, initial_weights=None):
    """K2: the model fitted on (features, label); features may be vectors or arrays. Every row weighs the same."""
    spark, out = train.sparkSession, top_n + 1
    layers = [dim, hidden, out]
    array = isinstance(train.schema["features"].dataType, T.ArrayType)
    features = F.col("features") if array else vector_to_array("features")
    rows = materialize(train.select(features.alias("features"), F.col("label").cast("int").alias("label")), "mlp-train")
    w0 = np.asarray(initial_weights) if initial_weights is not None else _mlp(spark, layers, seed).weights.toArray()
    w = minimise(lambda w: mean_loss(rows, w, dim, hidden, out), w0, max_iter)
    discard(rows)
    return _mlp(spark, layers, seed, w)


def mlp_ranks(scored: DataFrame, top_n: int) -> DataFrame:
    """K3: rank of the label among item classes (NULL for the "other" class)."""
    t = F.col("label").cast("int")
    # columns of their own: inside the filter's function the conversion would be made again for every class
    p = scored.withColumn("_p", vector_to_array("probability")).withColumn("_own", F.element_at("_p", t + 1))
    rank = F.lit(1) + F.size(F.filter(F.slice("_p", 1, top_n), lambda x: x > F.col("_own")))
    return p.withColumn("rank", F.when(t < top_n, rank.cast("bigint"))).drop("_p", "_own")


def warm_start_weights(old_model, old_classes: DataFrame, new_classes: DataFrame, top_n_old: int, top_n_new: int,
                       dim: int = EMBED_DIM, hidden: int = HIDDEN) -> np.ndarray:
    """K4: a flat initial-weight vector for [dim, hidden, top_n_new+1] from an old model.

    The class maps are bounded by the class counts (top-N), so the alignment table
    is small by construction; it is brought to the driver only as that.
    """
    w = old_model.weights.toArray()
    n1 = dim * hidden + hidden
    first = w[:n1]
    out_old = top_n_old + 1
    W_old = w[n1:n1 + hidden * out_old].reshape(hidden, out_old)  # [i, o]: column-major out×in
    b_old = w[n1 + hidden * out_old:]
    j = old_classes.select("item", F.col("cls").alias("old")).join(
        new_classes.select("item", F.col("cls").alias("new")), "item", "inner")
    pairs = [(r["old"], r["new"]) for r in j.collect()]  # ≤ top_n rows
    out_new = top_n_new + 1
    W_new = np.zeros((hidden, out_new))
    b_new = np.zeros(out_new)
    for o, n in pairs:
        W_new[:, n] = W_old[:, o]
        b_new[n] = b_old[o]
    W_new[:, top_n_new] = W_old[:, top_n_old]  # "other" stays "other"
    b_new[top_n_new] = b_old[top_n_old]
    return np.concatenate([first, W_new.reshape(-1), b_new])
