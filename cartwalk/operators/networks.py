"""Feed-forward networks trained by synchronous minibatch gradient sums, a
whole grid under several validation schemes at once (E27).

Rows are standardised one-hot ids with a class and a weight (equal rows are
added up first).  A step takes one minibatch: its rows lie in many partitions,
each task sends the gradient sums of every network over its rows, the sums are
added up in Spark and the driver, which holds the networks, applies Adam or SGD
with Nesterov momentum.  So a step is the step on the whole minibatch however
the rows are partitioned, no task sees more than its rows, and what reaches the
driver depends on the grid and not on the data.  All networks of all folds share
the passes.

Schemes: shuffled k-fold; stratified k-fold (rows of a class numbered in hash
order and dealt in turn); forward-chaining time folds, where fold i trains on
the dates of the first i + 1 of k + 1 stretches and is tested on the next one, so
no date is trained on that isn't before all dates tested.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwalk.operators.ids import dense_index_within
from cartwalk.session import bounded_batches, materialize

# The grid, the schemes and the stopping rule of the reference.
HIDDEN = [(50,), (100,), (100, 50), (100, 100)]
ACTIVATIONS = ["relu", "tanh"]
SOLVERS = ["adam", "sgd"]
SCHEMES = ["kfold", "stratified", "time"]
FOLDS = 5
VALIDATION = 10        # one row in ten decides when to stop
PATIENCE = 10          # epochs without a better validation accuracy

BUCKETS = 32           # one-hot columns an id is hashed to
SLICE = 4096           # rows worked on at once
FAN_IN = 64            # gradient rows added up by one task
ALPHA = 1e-4           # weight decay
RATES = {"adam": 0.01, "sgd": 0.1}


@dataclass(frozen=True)
class Point:
    hidden: tuple
    activation: str
    solver: str


GRID = [Point(h, a, s) for h, a, s in product(HIDDEN, ACTIVATIONS, SOLVERS)]


@dataclass
class Network:
    """A network, the split it learns and its optimiser's state."""
    point: Point
    scheme: int
    fold: int
    sizes: tuple
    weights: np.ndarray
    one: np.ndarray = field(default=None)
    two: np.ndarray = field(default=None)
    steps: int = 0
    best: float = -1.0
    stale: int = 0
    live: bool = True

    def apply(self, gradient: np.ndarray) -> None:
        """One step of the solver with the mean gradient of a minibatch."""
        g, rate = gradient + ALPHA * self.weights, RATES[self.point.solver]
        if self.one is None:
            self.one, self.two = np.zeros_like(g), np.zeros_like(g)
        self.steps += 1
        if self.point.solver == "adam":
            self.one = 0.9 * self.one + 0.1 * g
            self.two = 0.999 * self.two + 0.001 * g * g
            self.weights = self.weights - rate * (self.one / (1 - 0.9 ** self.steps)) / (np.sqrt(self.two / (1 - 0.999 ** self.steps)) + 1e-8)
        else:
            self.one = 0.9 * self.one - rate * g
            self.weights = self.weights + 0.9 * self.one - rate * g


def initial(sizes: tuple, activation: str, seed: int) -> np.ndarray:
    """Uniform weights by fan-in and fan-out, all layers in one array."""
    rng, out = np.random.default_rng(seed), []
    for a, b in zip(sizes, sizes[1:]):
        bound = np.sqrt((6.0 if activation == "relu" else 2.0) / (a + b))
        out += [rng.uniform(-bound, bound, a * b), np.zeros(b)]
    return np.concatenate(out)


def _layers(weights: np.ndarray, sizes: tuple):
    at = 0
    for a, b in zip(sizes, sizes[1:]):
        yield weights[at:at + a * b].reshape(a, b), weights[at + a * b:at + a * b + b]
        at += a * b + b


def forward(weights: np.ndarray, sizes: tuple, activation: str, x: np.ndarray) -> list[np.ndarray]:
    """Activations of every layer, class probabilities last."""
    out, layers = [x], list(_layers(weights, sizes))
    for k, (w, b) in enumerate(layers):
        z = out[-1] @ w + b
        if k + 1 < len(layers):
            out.append(np.maximum(z, 0.0) if activation == "relu" else np.tanh(z))
        else:
            z = np.exp(z - z.max(1, keepdims=True))
            out.append(z / z.sum(1, keepdims=True))
    return out


def gradient(weights: np.ndarray, sizes: tuple, activation: str, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sum over the rows (weights ``n``) of the gradient of the log loss."""
    acts, layers = forward(weights, sizes, activation, x), list(_layers(weights, sizes))
    delta = acts[-1].copy()
    delta[np.arange(len(y)), y] -= 1.0
    delta *= n[:, None]
    out = []
    for k in range(len(layers) - 1, -1, -1):
        out = [(acts[k].T @ delta).ravel(), delta.sum(0), *out]
        if k:
            delta = (delta @ layers[k][0].T) * ((acts[k] > 0) if activation == "relu" else 1.0 - acts[k] ** 2)
    return np.concatenate(out)


# -- rows ------------------------------------------------------------------------

def assign_folds(rows: DataFrame, label: str, key: list[str], date: str, folds: int = FOLDS, seed: int = 42) -> DataFrame:
    """``rows`` with ``kfold``, ``stratified`` (0 to folds - 1) and ``time``
    (stretch 0 to folds; a date is in one stretch only, rows without a date are
    in the first).  ``key`` columns tell rows apart."""
    h = F.xxhash64(*key, F.lit(seed))
    rows = rows.withColumn("_h", h)
    dealt = dense_index_within(rows, [label], ["_h", *key], "_nth")
    cuts = rows.agg(F.percentile_approx(F.col(date).cast("timestamp_ltz").cast("double"), [k / (folds + 1) for k in range(1, folds + 1)], 10_000)).first()[0] or []
    at = F.col(date).cast("timestamp_ltz").cast("double")
    stretch = sum((F.when(at > c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    return dealt.select(*[c for c in rows.columns if c != "_h"], F.pmod(F.col("_h"), F.lit(folds)).cast("int").alias("kfold"),
                        F.pmod(F.col("_nth") - 1, F.lit(folds)).cast("int").alias("stratified"), stretch.cast("int").alias("time"))


def _split(scheme: int, fold: int, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows a split trains on and is tested on."""
    p = parts[:, scheme]
    return (p <= fold, p == fold + 1) if SCHEMES[scheme] == "time" else (p != fold, p == fold)


def _read(batch: pa.RecordBatch):
    get = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
    for lo in range(0, batch.num_rows, SLICE):
        s = slice(lo, lo + SLICE)
        ids = np.stack([get("a")[s], BUCKETS + get("b")[s]], 1)
        x = np.zeros((len(ids), 2 * BUCKETS))
        x[np.arange(len(ids))[:, None], ids] = 1.0
        yield x, get("y")[s], get("n")[s].astype(np.float64), np.stack([get(k)[s] for k in SCHEMES], 1), get("held")[s]


def _added(rows: DataFrame, tasks: int) -> DataFrame:
    """(net, v binary): arrays of equal nets added up, ``FAN_IN`` at a time."""
    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, np.float64) for v in t.column("v").to_pylist())
        return pa.table({"net": t.column("net")[:1], "v": pa.array([total.tobytes()], pa.binary()), "part": t.column("part")[:1]})
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        rows = rows.withColumn("part", F.pmod("part", F.lit(tasks)).cast("int")).groupBy("net", "part").applyInArrow(add, "net int, v binary, part int")
    return rows.select("net", "v")


class Trainer:
    """Trains every point of ``grid`` under every scheme on ``rows`` (a, b:
    hashed ids, y: class, n: weight, kfold, stratified, time, batch, held)."""

    def __init__(self, rows: DataFrame, classes: int, grid: list[Point], folds: int, batches: int, seed: int = 42):
        self.spark, self.batches = rows.sparkSession, batches
        bounded_batches(self.spark)
        self.rows = materialize(rows, "batch")  # a step reads its minibatch's files only
        sums = self._run(self.rows, _moments(folds))
        self.scale = {}
        for s, f in product(range(len(SCHEMES)), range(folds)):
            total = sums.get(s * folds + f)
            mean = total[:-1] / max(1.0, total[-1]) if total is not None else np.zeros(2 * BUCKETS)
            spread = np.sqrt(mean * (1 - mean))
            self.scale[s, f] = (mean, np.where(spread > 0, spread, 1.0))
        self.nets = []
        for p, s, f in product(grid, range(len(SCHEMES)), range(folds)):
            sizes = (2 * BUCKETS, *p.hidden, max(2, classes))
            self.nets.append(Network(p, s, f, sizes, initial(sizes, p.activation, seed)))

    def _run(self, rows: DataFrame, work) -> dict[int, np.ndarray]:
        """``work`` over all partitions; its arrays by net, added up."""
        def run(batches):
            from pyspark import TaskContext
            part = TaskContext.get().partitionId()
            out = work(batches)
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([v.tobytes() for v in out.values()], pa.binary()),
                                              pa.array([part] * len(out), pa.int32())], names=["net", "v", "part"])
        got = _added(rows.mapInArrow(run, "net int, v binary, part int"), rows.rdd.getNumPartitions()).collect()
        return {r["net"]: np.frombuffer(r["v"], np.float64) for r in got}

    def train(self, epochs: int) -> None:
        for _ in range(epochs):
            right = {}
            for b in range(self.batches):
                live = [(k, n.point.activation, n.scheme, n.fold, n.sizes, n.weights) for k, n in enumerate(self.nets) if n.live]
                if not live:
                    return
                shared = self.spark.sparkContext.broadcast((live, self.scale))
                for k, v in self._run(self.rows.filter(F.col("batch") == b), _gradients(shared)).items():
                    right[k] = right.get(k, 0) + v[-2:]
                    if v[-3] > 0:
                        self.nets[k].apply(v[:-3] / v[-3])
                shared.unpersist()
            for k, (hits, total) in right.items():
                net, score = self.nets[k], hits / max(1.0, total)
                net.stale = 0 if score > net.best + 1e-4 else net.stale + 1
                net.best = max(net.best, score)
                net.live = net.stale < PATIENCE

    def scores(self) -> list[tuple]:
        """(scheme, hidden, activation, solver, fold, rows tested, accuracy)."""
        shared = self.spark.sparkContext.broadcast(([(k, n.point.activation, n.scheme, n.fold, n.sizes, n.weights) for k, n in enumerate(self.nets)], self.scale))
        got = self._run(self.rows, _tests(shared))
        out = []
        for k, n in enumerate(self.nets):
            hits, total = got.get(k, (0.0, 0.0))
            out.append((SCHEMES[n.scheme], "-".join(map(str, n.point.hidden)), n.point.activation, n.point.solver, n.fold, int(total), float(hits / total) if total else None))
        return out


def _moments(folds: int):
    def work(batches):
        out: dict[int, np.ndarray] = {}
        for b in batches:
            for x, _, n, parts, _ in _read(b):
                for s, f in product(range(len(SCHEMES)), range(folds)):
                    at, _ = _split(s, f, parts)
                    v = np.append((x[at] * n[at, None]).sum(0), n[at].sum())
                    out[s * folds + f] = out.get(s * folds + f, 0) + v
        return out
    return work


def _gradients(shared):
    """Per network: gradient sums, weight of the rows they are over, and hits
    and weight of its validation rows."""
    def work(batches):
        nets, scale = shared.value
        out: dict[int, np.ndarray] = {}
        for b in batches:
            for x, y, n, parts, held in _read(b):
                ready: dict = {}
                for k, activation, s, f, sizes, weights in nets:
                    if (s, f) not in ready:
                        at, _ = _split(s, f, parts)
                        mean, spread = scale[s, f]
                        z = (x - mean) / spread
                        ready[s, f] = [(z[m], y[m], n[m]) for m in (at & ~held, at & held)]
                    (zx, zy, zn), (vx, vy, vn) = ready[s, f]
                    g = gradient(weights, sizes, activation, zx, zy, zn) if len(zy) else np.zeros(len(weights))
                    hits = vn[forward(weights, sizes, activation, vx)[-1].argmax(1) == vy].sum() if len(vy) else 0.0
                    out[k] = out.get(k, 0) + np.concatenate([g, [zn.sum(), hits, vn.sum()]])
        return out
    return work


def _tests(shared):
    def work(batches):
        nets, scale = shared.value
        out: dict[int, np.ndarray] = {}
        for b in batches:
            for x, y, n, parts, _ in _read(b):
                for k, activation, s, f, sizes, weights in nets:
                    _, at = _split(s, f, parts)
                    if at.any():
                        mean, spread = scale[s, f]
                        p = forward(weights, sizes, activation, (x[at] - mean) / spread)[-1]
                        out[k] = out.get(k, 0) + np.array([n[at][p.argmax(1) == y[at]].sum(), n[at].sum()])
        return out
    return work


def network_rows(features: DataFrame, label: str, dates: DataFrame, folds: int, batches: int, seed: int = 42) -> tuple[DataFrame, int]:
    """Rows of :class:`Trainer` from item features with a label, and the
    number of classes.  ``dates`` is (item_id, date)."""
    key = ["item_id", "feature_category_id", "feature_value_id"]
    known = features.filter(F.col(label).isNotNull()).select(*key, label).distinct().join(dates.select("item_id", "date"), "item_id", "left")
    names = sorted(r[0] for r in known.select(label).distinct().collect())  # classes
    index = F.create_map(*[F.lit(x) for k, name in enumerate(names) for x in (name, k)]) if names else F.create_map(F.lit(""), F.lit(0))
    folded = assign_folds(known, label, key, "date", folds, seed)
    h = F.xxhash64(*key, F.lit(seed + 1))
    rows = folded.select(
        F.pmod(F.hash(F.lit("c"), "feature_category_id"), F.lit(BUCKETS)).cast("int").alias("a"), F.pmod(F.hash(F.lit("v"), "feature_value_id"), F.lit(BUCKETS)).cast("int").alias("b"),
        index[F.col(label)].cast("int").alias("y"), *SCHEMES, F.pmod(h, F.lit(batches)).cast("int").alias("batch"),
        (F.pmod(F.xxhash64(*key, F.lit(seed + 2)), F.lit(VALIDATION)) == 0).alias("held"))
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")), len(names)


def grid_search(features: DataFrame, label: str, dates: DataFrame, grid: list[Point] | None = None, folds: int = FOLDS, epochs: int = 8,
                batches: int = 4, seed: int = 42) -> DataFrame:
    """(scheme, hidden, activation, solver, folds, tested, accuracy,
    is_best): the mean test accuracy of every grid point under every scheme, and
    the best point of each scheme (ties: the first in grid order).  Folds
    without a row to test or to train on have no accuracy and don't count."""
    rows, classes = network_rows(features, label, dates, folds, batches, seed)
    trainer = Trainer(rows, classes, GRID if grid is None else grid, folds, batches, seed)
    trainer.train(epochs)
    by: dict[tuple, list] = {}
    for scheme, hidden, activation, solver, _, tested, accuracy in trainer.scores():
        by.setdefault((scheme, hidden, activation, solver), []).append((tested, accuracy))
    out = []
    for at, folds_of in by.items():
        scored = [a for _, a in folds_of if a is not None]
        out.append((*at, len(scored), sum(t for t, _ in folds_of), sum(scored) / len(scored) if scored else None))
    best = {s: max((r for r in out if r[0] == s), key=lambda r: r[-1] if r[-1] is not None else -1.0)[:4] for s in {r[0] for r in out}}
    return features.sparkSession.createDataFrame([(*r, best[r[0]] == r[:4]) for r in out],
                                                 "scheme STRING, hidden STRING, activation STRING, solver STRING, folds INT, tested LONG, accuracy DOUBLE, is_best BOOLEAN")
