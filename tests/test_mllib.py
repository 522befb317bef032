"""K4: the flat weight layout used for warm starts, checked by an exact forward pass."""

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array

from seqdrift.operators import mllib as K


def _forward(w, x, dim, hidden, out):
    n1 = dim * hidden
    W1 = w[:n1].reshape(dim, hidden).T          # column-major out×in
    b1 = w[n1:n1 + hidden]
    W2 = w[n1 + hidden:n1 + hidden + hidden * out].reshape(hidden, out).T
    b2 = w[n1 + hidden + hidden * out:]
    h = 1 / (1 + np.exp(-(W1 @ x + b1)))
    z = W2 @ h + b2
    e = np.exp(z - z.max())
    return e / e.sum()


def test_layout_and_item_aligned_warm_start(spark):
    rng = np.random.default_rng(0)
    dim, hidden, top_n = 4, 5, 3
    rows = [(rng.normal(size=dim).tolist(), float(rng.integers(0, top_n + 1))) for _ in range(60)]
    df = spark.createDataFrame(rows, "f array<double>, label double").select(
        array_to_vector("f").alias("features"), "label")
    m = K.fit_mlp(df, top_n, dim=dim, hidden=hidden, max_iter=5)
    w = m.weights.toArray()
    got = [(np.array(r.features.toArray()), np.array(r.p)) for r in
           m.transform(df).select("features", vector_to_array("probability").alias("p")).limit(5).collect()]
    for x, p in got:
        assert np.allclose(_forward(w, x, dim, hidden, top_n + 1), p, atol=1e-9)
    # classes of items 10, 11, 12 → reversed order in the new vocabulary
    old = spark.createDataFrame([(10, 0), (11, 1), (12, 2)], "item bigint, cls bigint")
    new = spark.createDataFrame([(10, 2), (11, 1), (12, 0)], "item bigint, cls bigint")
    w2 = K.warm_start_weights(m, old, new, top_n, top_n, dim=dim, hidden=hidden)
    for x, p in got:
        q = _forward(w2, x, dim, hidden, top_n + 1)
        assert np.allclose(q[[2, 1, 0, 3]], p, atol=1e-9)


def test_fit_takes_mllibs_steps(spark):
    """Whole blocks of one partition: MLlib's mean over blocks is then the mean over rows."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    rng = np.random.default_rng(1)
    dim, hidden, top_n = 4, 5, 3
    rows = [(x.tolist(), float(np.argmax(x)) if rng.random() < 0.8 else float(rng.integers(0, top_n + 1)))
            for x in rng.normal(size=(256, dim))]
    df = spark.createDataFrame(rows, "f array<double>, label double").select(
        array_to_vector("f").alias("features"), "label").coalesce(1)
    for steps in (1, 5, 30):
        want = MultilayerPerceptronClassifier(layers=[dim, hidden, top_n + 1], maxIter=steps, seed=42, blockSize=128).fit(df)
        got = K.fit_mlp(df, top_n, dim=dim, hidden=hidden, max_iter=steps)
        assert np.allclose(got.weights.toArray(), want.weights.toArray(), rtol=1e-5, atol=1e-6)


def test_fit_weighs_rows_alike_however_they_are_dealt(spark):
    """MLlib's mean over blocks gave a row of a short last block a greater weight."""
    rng = np.random.default_rng(2)
    rows = [(x.tolist(), float(rng.integers(0, 3))) for x in rng.normal(size=(131, 4))]
    df = spark.createDataFrame(rows, "features array<double>, label double")
    one, many = (K.fit_mlp(d, 2, dim=4, hidden=3, max_iter=5).weights.toArray() for d in (df.coalesce(1), df.repartition(7)))
    assert np.allclose(one, many, atol=1e-8)


def test_pooled_features_are_looked_up(spark):
    """Known items are averaged as often as they occur; unknown and null ones are skipped; nothing is shuffled."""
    emb = spark.createDataFrame([(7, [1.0, 2.0]), (3, [3.0, -2.0])], "item bigint, vector array<double>")
    h = spark.createDataFrame([(1, [3, 7, 7]), (2, [9, None, 3]), (3, [9]), (4, []), (5, [7]), (6, None)],
                              "row_num bigint, history array<bigint>")
    out = K.pooled_features(h, emb, dim=2)
    got = {r.row_num: r.features for r in out.collect()}
    assert np.allclose(got.pop(1), [5 / 3, 2 / 3])
    assert got == {2: [3.0, -2.0], 3: [0.0, 0.0], 4: [0.0, 0.0], 5: [1.0, 2.0], 6: [0.0, 0.0]}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_ranks_convert_a_row_once(spark):
    rows = [([0.5, 0.2, 0.3], 1.0), ([0.1, 0.2, 0.7], 1.0), ([0.4, 0.4, 0.2], 0.0), ([0.2, 0.3, 0.5], 2.0)]
    df = spark.createDataFrame(rows, "p array<double>, label double").select(array_to_vector("p").alias("probability"), "label")
    out = K.mlp_ranks(df, 2)
    assert [r["rank"] for r in out.collect()] == [2, 1, 1, None]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("UDF(") == 2  # the test's own and one conversion


def test_protocol_on_ordered_rows(spark):
    """The ordered log that the queries give equals the one that the protocol orders itself."""
    from conftest import SF001
    from seqdrift.plans.learned import MlpProtocol, histories, split_rows
    from seqdrift.sources import adapters as A
    own = histories(split_rows(A.clicks(spark, SF001)))
    given = histories(split_rows(A.click_rows(spark, SF001, with_size=True), ordered=True))
    assert sorted(map(str, own.collect())) == sorted(map(str, given.collect()))
    p = MlpProtocol(A.click_rows(spark, SF001, with_size=True), max_iter=2, ordered=True)
    tests = {(r.user_session, r.row_num): r.target for r in given.collect() if not r.is_train}
    assert {(r.user_session, r.row_num): r.target for r in p.predictions().collect()} == tests
