"""Forests of equal rows added up (E16) against brute force and Spark's own."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from cartwalk.operators import forest as FO
from cartwalk.operators import imputation as IM
from cartwalk.session import materialize


def _features(spark, copies):
    """60 pairs of ids, many times: category c has the literal c; one row in five lacks it."""
    return spark.range(copies * 60).select(
        F.col("id").alias("item_id"), (F.col("id") % 3).cast("int").alias("feature_category_id"), (F.col("id") % 60).alias("feature_value_id"),
        F.expr("IF((id div 60 + id) % 5 = 0, NULL, concat('c', id % 3))").alias(IM.LABEL))


def test_best_split_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(50):
        x, y, w = rng.integers(0, 3, (12, 4)).astype(float), rng.integers(0, 3, 12), rng.integers(1, 5, 12).astype(float)
        total = np.bincount(y, w, 3)
        row, at = np.nonzero(x)
        column, over, right = FO.best_split(total, at, x[row, at], y[row], w[row])

        def gain(c, t):
            parts = [np.bincount(y[m], w[m], 3) for m in (x[:, c] <= t, x[:, c] > t)]
            return sum((p * p).sum() / p.sum() for p in parts if p.sum()) - (total * total).sum() / total.sum()
        best = max(gain(c, t) for c in range(4) for t in (0.5, 1.0, 1.5))
        if column < 0:
            assert best < 1e-9
        else:
            assert gain(column, over) == pytest.approx(best)
            assert right.tolist() == np.bincount(y[x[:, column] > over], w[x[:, column] > over], 3).tolist()


def test_weights_are_those_of_all_rows():
    """A row with a count draws as often as so many single rows, and never for the forest that leaves its fold out."""
    f = FO.Forests(2, 4000, 1, 2, 4, 1)
    w = f.weights(77, 50, 0)
    assert (w[:4000] == 0).all() and (f.weights(77, 50, FO.HOLDOUT) == 0).all()
    assert abs(w[4000:].mean() - 50) < 0.5 and abs(w[4000:].var() - 50) < 4


def test_cross_validation_learns_equal_rows_once(spark, monkeypatch):
    seen, validate = [], FO.cross_validated
    monkeypatch.setattr(FO, "cross_validated", lambda rows, *a: seen.append(rows.agg(F.count("n"), F.sum("n")).first()) or validate(rows, *a))
    for copies in (20, 200):
        f = _features(spark, copies)
        got = {r.metric: r.value for r in IM.cv_accuracy(f, trees=40).collect()}
        assert got.keys() == {"cv_mean_accuracy", "holdout_accuracy"} and all(0.8 < v <= 1 for v in got.values()), got
        assert seen[-1][0] <= 60 * 6 and seen[-1][1] == f.filter(F.col(IM.LABEL).isNotNull()).count()


def test_trees_as_large_as_sparks_own(spark):
    known = _features(spark, 20).filter(F.col(IM.LABEL).isNotNull())
    [hasher] = IM._features_stages()
    label = StringIndexer(inputCol=IM.LABEL, outputCol="label").fit(known)
    rows = label.transform(hasher.transform(IM._prep(known))).withColumn("fold", F.lit(0))
    own = RandomForestClassifier(numTrees=100, seed=1).fit(rows)
    f = F.unwrap_udt("features")
    alike = rows.groupBy(f["indices"].alias("at"), f["values"].alias("v"), F.col("label").cast("int").alias("y"), "fold").agg(F.count(F.lit(1)).alias("n"))
    mine = FO.grow(materialize(alike.withColumn("key", F.xxhash64("at", "y"))), 1, 100, 5, 3, IM.HASHED, 1)
    nodes = (mine.weight[100:].sum(-1) > 0).sum() / 100
    assert 0.6 < nodes / (sum(t.numNodes for t in own.trees) / 100) < 1.6
    assert (mine.weight[:100].sum(-1) > 0).sum() == 0  # the forest that leaves fold 0 out has no rows here
