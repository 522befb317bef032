"""Quality classifier: a sparse rule ensemble compiled into Spark column expressions.

A bounded sample of labelled documents trains a small random forest over text statistics; every
path from a root to a node becomes a conjunctive rule; a lasso-penalised logistic regression over
the rules keeps few of them with weights. The kept rules and weights are compiled into one Column
over the statistics, so scoring is a projection. Labels, language, source and id are no inputs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from seqdrift.config import materialize

from .common import read, text_chunks

#: Labelled documents that the ensemble is fitted on, the first by hash of their id.
SAMPLE = 20_000
TREES = 24
DEPTH = 3
LASSO = 0.001
SEED = 11

STATISTICS = ("words", "word_bytes", "lines", "words_a_line", "symbols", "bars", "exclaims", "upper", "digits",
              "other_bytes", "stops", "short_words", "distinct_words", "twins", "capital_words", "dup_lines", "longest")

SPACE = b" \t\n\r\x0b\x0c"


def _count(text: bytes, of: bytes) -> int:
    return len(text) - len(text.translate(None, of))


def statistics(text: bytes) -> list[float]:
    """The values of ``STATISTICS``: counts as logarithms, the rest as shares of words, bytes or lines."""
    words = text.split()
    n, size = max(len(words), 1), max(len(text), 1)
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    m = max(len(lines), 1)
    return [math.log1p(len(words)), sum(map(len, words)) / n, math.log1p(len(lines)), math.log1p(len(words) / m),
            _count(text, b"#*$%&<>") / n, text.count(b"|") / n, text.count(b"!") / n,
            _count(text, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / size, _count(text, b"0123456789") / size,
            _count(text, bytes(range(128, 256))) / size, _count(text, b".,;:?") / n,
            sum(len(w) < 4 for w in words) / n, len(set(words)) / n,
            sum(a == b for a, b in zip(words, words[1:])) / n, sum(w[:1].isupper() for w in words) / n,
            1 - len(set(lines)) / m if lines else 0.0, math.log1p(max(map(len, words), default=0))]


def with_statistics(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` and the statistics of its whole texts (null text: of the empty text)."""
    d = docs.select(*columns, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, "text"):
            values = np.array([statistics(t) for t in texts]).reshape(-1, len(STATISTICS))
            kept = [part.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, values.T)], names=[*columns, *STATISTICS])

    schema = ", ".join([f"`{c}` {d.schema[c].dataType.simpleString()}" for c in columns] +
                       [f"{s} double" for s in STATISTICS])
    return d.mapInArrow(run, schema)


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, whether at most, threshold) of each condition


def tree_rules(node, path: Rule = ()) -> list[Rule]:
    """Rules of a fitted tree: the conditions on the way to every node but the root."""
    rules = [tuple(sorted(path))] if path else []
    if node.subtreeDepth():
        split = node.split()
        at, value = split.featureIndex(), split.threshold()
        rules += tree_rules(node.leftChild(), (*path, (at, True, value)))
        rules += tree_rules(node.rightChild(), (*path, (at, False, value)))
    return rules


def compile_rule(rule: Rule) -> Column:
    out = F.lit(True)
    for at, below, value in rule:
        c = F.col(STATISTICS[at])
        out = out & (c <= value if below else c > value)
    return out.cast("double")


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(label, statistics) of at most ``sample`` documents whose crc32(doc_id) mod 3 is not 1.

    Of several labels of one id the largest counts; labels other than 0 and 1 do not.
    """
    known = (labels.where(F.col("quality").isin(0, 1) & (fold("doc_id") != 1)).groupBy("doc_id")
             .agg(F.max("quality").cast("double").alias("label"))
             .orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(sample)
             .withColumnRenamed("doc_id", "_id"))
    known = F.broadcast(materialize(known, "rules-labels"))  # at most ``sample`` rows
    rows = docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("_id")).select("label", "text")
    return materialize(with_statistics(rows, ["label"]), "rules-sample")


def fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 3


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[float, list[tuple[Rule, float]]]:
    """(intercept, rules with weights). Without both classes: the log odds of the labels, no rules."""
    rows = training_sample(docs, labels, sample)
    seen = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    good, bad = seen.get(1.0, 0), seen.get(0.0, 0)
    if not good or not bad:
        return math.log((good + 1) / (bad + 1)), []
    x = rows.select("label", array_to_vector(F.array(*STATISTICS)).alias("features"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", seed=SEED,
                                    subsamplingRate=0.7).fit(x)
    rules = sorted({r for t in forest.trees for r in tree_rules(t._java_obj.rootNode())})
    if not rules:
        return math.log(good / bad), []
    x = rows.select("label", array_to_vector(F.array(*map(compile_rule, rules))).alias("features"))
    model = LogisticRegression(regParam=LASSO, elasticNetParam=1.0, standardization=False, maxIter=60).fit(x)
    weights = model.coefficients.toArray()
    return float(model.intercept), [(r, float(w)) for r, w in zip(rules, weights) if w]


def score_column(model: tuple[float, list[tuple[Rule, float]]]) -> Column:
    intercept, rules = model
    z = F.lit(intercept)
    for rule, weight in rules:
        z = z + compile_rule(rule) * weight
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def classify(docs: DataFrame, model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text).

    Empty and null texts are scored by their statistics. A null id is not held out. Repeated rows
    give repeated results.
    """
    scored = with_statistics(docs, ["doc_id"]).select("doc_id", score_column(model).alias("score"))
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 1, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return classify(docs, fit(docs, read(spark, sf_dir, "labels")))
