"""Spark's multilayer perceptron learnt from weighted rows.

The rows are sparse vectors with a label and a count (equal rows are added up first).
A step of L-BFGS is a pass over them: every task sends the sum of its rows' losses and
gradients, which are added up in Spark, so what reaches the driver depends on the layers
only.  The first layer is worked on where a row isn't zero, so a pass costs the entries of
the rows times the first hidden layer and not their width.  Start weights, layout (a
layer's matrix by input, then its biases), logistic hidden layers, softmax with log loss
and the model returned are those of ``MultilayerPerceptronClassifier``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwalk.operators.networks import _added, _layers
from cartwalk.session import bounded_batches, drop_stored, materialize

CORRECTIONS = 10       # pairs L-BFGS remembers
TOLERANCE = 1e-6       # gradient, of the loss, at which it is done
SLICE = 1 << 15        # rows worked on at once


def weighted_rows(rows: DataFrame) -> DataFrame:
    """(at, v, y, n): positions and values of a row's entries, its class and how many
    rows are alike; of ``rows`` (features, label[, n])."""
    n = F.col("n") if "n" in rows.columns else F.lit(1)
    f = F.unwrap_udt("features")
    return (rows.select(f["indices"].alias("at"), f["values"].alias("v"), F.col("label").cast("int").alias("y"), n.cast("long").alias("n"))
            .groupBy("at", "v", "y").agg(F.sum("n").alias("n")))


def loss_and_gradient(weights: np.ndarray, sizes: tuple, row: np.ndarray, at: np.ndarray, v: np.ndarray, y: np.ndarray,
                      n: np.ndarray) -> tuple[float, np.ndarray]:
    """Sums over rows with counts ``n``; entry k of the rows is ``v[k]``, in row ``row[k]`` at ``at[k]``."""
    (w, b), *layers = _layers(weights, sizes)
    z = np.zeros((len(y), sizes[1]))
    np.add.at(z, row, w[at] * v[:, None])
    z += b
    acts = []
    for w_next, b_next in layers:
        acts.append(1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))))
        z = acts[-1] @ w_next + b_next
    z -= z.max(1, keepdims=True)
    log_p = z - np.log(np.exp(z).sum(1, keepdims=True))
    mine = np.arange(len(y)), y
    loss = -(log_p[mine] * n).sum()
    delta = np.exp(log_p)
    delta[mine] -= 1.0
    delta *= n[:, None]
    out = []
    for a, (w_next, _) in zip(reversed(acts), reversed(layers)):
        out = [(a.T @ delta).ravel(), delta.sum(0), *out]
        delta = (delta @ w_next.T) * a * (1.0 - a)
    first = np.zeros_like(w)
    np.add.at(first, at, v[:, None] * delta[row])
    return loss, np.concatenate([first.ravel(), delta.sum(0), *out])


def _sums(shared, sizes: tuple):
    def run(batches):
        from pyspark import TaskContext
        weights, total = shared.value, 0.0
        for b in batches:
            col = lambda name: b.column(b.schema.get_field_index(name))
            ats, vs = col("at"), col("v")
            y, n = col("y").to_numpy(), col("n").to_numpy().astype(np.float64)
            for lo in range(0, b.num_rows, SLICE):
                part = ats.slice(lo, SLICE)
                row = np.repeat(np.arange(len(part)), part.value_lengths().to_numpy())
                loss, g = loss_and_gradient(weights, sizes, row, part.flatten().to_numpy(), vs.slice(lo, SLICE).flatten().to_numpy(),
                                            y[lo:lo + SLICE], n[lo:lo + SLICE])
                total = total + np.concatenate([g, [loss, n[lo:lo + SLICE].sum()]])
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary()),
                                              pa.array([TaskContext.get().partitionId()], pa.int32())], names=["net", "v", "part"])
    return run


def lbfgs(value: Callable, x: np.ndarray, steps: int) -> np.ndarray:
    """At most ``steps`` steps of L-BFGS down ``value`` (x -> loss, gradient)."""
    pairs: deque = deque(maxlen=CORRECTIONS)
    f, g = value(x)
    for _ in range(steps):
        if np.linalg.norm(g) <= max(TOLERANCE * abs(f), 1e-8):
            break
        d, left = -g, []
        for s, y in reversed(pairs):
            a = (s @ d) / (s @ y)
            left.append(a)
            d = d - a * y
        if pairs:
            s, y = pairs[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(pairs, reversed(left)):
            d = d + s * (a - (y @ d) / (s @ y))
        slope = g @ d
        t = 1.0 if pairs else 1.0 / np.linalg.norm(g)
        to, gt = value(x + t * d)
        while to > f + 1e-4 * t * slope:
            t /= 2
            if t < 1e-10:
                return x
            to, gt = value(x + t * d)
        s, y = t * d, gt - g
        if s @ y > 1e-12 * (y @ y):
            pairs.append((s, y))
        x, f, g = x + s, to, gt
    return x


def fit(rows: DataFrame, layers: list[int], seed: int, max_iter: int) -> MultilayerPerceptronClassificationModel:
    """The model of ``rows`` (features, label, n), in at most ``max_iter`` steps."""
    spark, sizes = rows.sparkSession, tuple(layers)
    bounded_batches(spark)
    sc = spark.sparkContext
    stored = materialize(weighted_rows(rows))
    tasks = stored.rdd.getNumPartitions()

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        shared = sc.broadcast(x)
        got = _added(stored.mapInArrow(_sums(shared, sizes), "net int, v binary, part int"), tasks).collect()
        shared.unpersist()
        total = sum(np.frombuffer(r["v"], np.float64) for r in got)
        return total[-2] / total[-1], total[:-2] / total[-1]

    # Without a step the classifier returns the weights it starts from.
    still = MultilayerPerceptronClassifier(layers=list(layers), seed=seed, maxIter=0, labelCol="label", featuresCol="features")
    one = rows.limit(1)
    weights = lbfgs(value, still.fit(one).weights.toArray(), max_iter)
    drop_stored(stored)
    return still.copy({still.initialWeights: DenseVector(weights)}).fit(one)
