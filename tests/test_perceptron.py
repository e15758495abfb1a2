"""The weighted perceptron (E26) against Spark's own and against differences."""

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from cartwalk.operators import imputation as IM
from cartwalk.operators import perceptron as PC


def _features(spark, copies):
    """60 pairs of ids, many times: category c has the literal c; one row in five lacks it."""
    rows = [(k * 100 + i, i % 3, i, None if (k + i) % 5 == 0 else f"c{i % 3}") for k in range(copies) for i in range(60)]
    return spark.createDataFrame(rows, "item_id long, feature_category_id int, feature_value_id long, feature_category_literal string")


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(1)
    sizes, x = (7, 4, 3, 3), rng.normal(size=7 * 4 + 4 + 4 * 3 + 3 + 3 * 3 + 3)
    row, at, v = np.array([0, 0, 1, 2, 2]), np.array([1, 5, 6, 0, 5]), np.array([1.0, 1.0, 2.0, 1.0, 1.0])
    args = (sizes, row, at, v, np.array([0, 2, 1]), np.array([5.0, 1.0, 3.0]))
    _, g = PC.loss_and_gradient(x, *args)
    for k in range(len(x)):
        d = np.zeros_like(x)
        d[k] = 1e-6
        assert abs((PC.loss_and_gradient(x + d, *args)[0] - PC.loss_and_gradient(x - d, *args)[0]) / 2e-6 - g[k]) < 1e-6


def test_lbfgs_reaches_the_bottom():
    a = np.diag([1.0, 10.0, 100.0])
    got = PC.lbfgs(lambda x: (0.5 * x @ a @ x - x.sum(), a @ x - 1.0), np.ones(3), 50)
    assert np.allclose(got, [1.0, 0.1, 0.01], atol=1e-4)


def test_equal_rows_are_learnt_once(spark, monkeypatch):
    seen, fit = [], PC.fit
    monkeypatch.setattr(PC, "fit", lambda rows, *a: seen.append(PC.weighted_rows(rows).agg(F.count("n"), F.sum("n")).first()) or fit(rows, *a))
    for copies in (5, 40):
        f = _features(spark, copies)
        out = IM.impute(f, "mlp", maxIter=30)
        assert out.count() == 60 * copies
        assert out.filter(F.col(IM.LABEL) != F.concat(F.lit("c"), F.col("feature_category_id"))).count() == 0
        assert seen[-1][0] <= 60 and seen[-1][1] == f.filter(F.col(IM.LABEL).isNotNull()).count()


def test_as_sparks_own_on_all_rows(spark):
    f = _features(spark, 5)
    known, missing = IM.split_known(f)
    model, labels = IM.fit_classifier(known, "mlp", maxIter=30)
    clf = MultilayerPerceptronClassifier(layers=[IM.HASHED, 50, len(labels)], seed=IM.SEED, maxIter=30)
    own = Pipeline(stages=IM._features_stages() + [StringIndexer(inputCol=IM.LABEL, outputCol="label"), clf]).fit(IM._prep(known))
    predicted = lambda m: [r.prediction for r in IM._predict(m, missing).orderBy("item_id").select("prediction").collect()]
    assert predicted(model) == predicted(own)
    # starts from the same weights
    still = clf.copy({clf.maxIter: 0})
    x = Pipeline(stages=IM._features_stages() + [StringIndexer(inputCol=IM.LABEL, outputCol="label")]).fit(IM._prep(known)).transform(IM._prep(known))
    assert np.array_equal(still.fit(x).weights.toArray(), still.fit(x.limit(1)).weights.toArray())
