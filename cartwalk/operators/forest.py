"""Random forests learnt from equal rows added up.

The rows are sparse vectors with a class, a fold and a count (equal rows are one).  Several
forests are grown together, one for each fold, which learns from the other folds, and one for all
of them.  A level of all trees is one pass over the rows: a task follows its rows to the nodes
that they reach and adds up weights by tree, node, column, value and class; the sums are added up in
Spark and each node's split is chosen where its sums lie, so what reaches the driver follows the trees
and not the rows.

As in Spark's ``RandomForestClassifier``: bootstrap by Poisson weights (those of n equal rows add
up to a Poisson number of mean n, drawn from the seed, the row and the tree), Gini impurity, the square root of
all columns drawn for a node, splits half-way between neighbouring values, leaves where nothing is gained, and the
class with the largest sum of the trees' shares.  Values are positive or absent (zero), as hashed ids have them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwalk.session import bounded_batches, drop_stored, materialize

HOLDOUT = -1  # the fold of rows that no forest learns from


class Forests:
    """Trees of ``folds + 1`` forests of ``size`` trees: columns and thresholds by heap position (a node's
    children are 2k + 1 and 2k + 2), and class weights."""

    def __init__(self, folds: int, size: int, depth: int, classes: int, columns: int, seed: int):
        self.folds, self.size, self.depth, self.classes, self.seed = folds, size, depth, classes, seed
        self.of = np.repeat(np.arange(folds + 1), size)  # a tree's forest
        trees, nodes = len(self.of), 2 ** (depth + 1) - 1
        self.column = np.full((trees, nodes), -1, np.int32)
        self.over = np.zeros((trees, nodes))
        self.weight = np.zeros((trees, nodes, classes))
        self.open = np.zeros((trees, nodes), bool)  # nodes that may be split
        self.open[:, 0] = True
        rng, inner = np.random.default_rng(seed), 2 ** depth - 1
        drawn = np.zeros((size, inner, columns), bool)  # the same for every forest, as one seed gives
        for tree in drawn:
            # The columns with the smallest random numbers.
            at = np.argpartition(rng.random((inner, columns), np.float32), (n := int(np.ceil(np.sqrt(columns)))) - 1, axis=1)[:, :n]
            np.put_along_axis(tree, at, True, axis=1)
        self.drawn = np.packbits(drawn, axis=-1)

    def weights(self, key: int, n: int, fold: int) -> np.ndarray:
        """How often each tree drew the ``n`` rows that are alike under ``key``."""
        w = np.random.default_rng([self.seed, key & ((1 << 64) - 1)]).poisson(n, len(self.of)).astype(np.float64)
        return np.where((self.of == fold) | (fold == HOLDOUT), 0.0, w)

    def reached(self, at: np.ndarray, v: np.ndarray, levels: int) -> np.ndarray:
        """The node at most ``levels`` below the root where each tree sends a row."""
        trees, node = np.arange(len(self.of)), np.zeros(len(self.of), np.int64)
        for _ in range(levels):
            column = self.column[trees, node]
            x = (v[:, None] * (column == at[:, None])).sum(0)
            node = np.where(column >= 0, 2 * node + 1 + (x > self.over[trees, node]), node)
        return node


def _rows(b: pa.RecordBatch):
    col = {name: b.column(k) for k, name in enumerate(b.schema.names)}
    for k, (y, fold, n, key) in enumerate(zip(*(col[c].to_pylist() for c in ("y", "fold", "n", "key")))):
        yield col["at"][k].values.to_numpy(), col["v"][k].values.to_numpy(), y, fold, n, key


STATS = "tree int, node int, at int, v double, y int, w double"


def _level(shared, level: int):
    """Weights of a level's open nodes, by column and value of the drawn ones (column -1: all rows)."""
    names = ["tree", "node", "at", "v", "y", "w"]

    def run(batches):
        forests: Forests = shared.value
        trees = np.arange(len(forests.of))
        for b in batches:
            parts = []
            for at, v, y, fold, n, key in _rows(b):
                if fold == HOLDOUT:
                    continue
                w, node = forests.weights(key, n, fold), forests.reached(at, v, level)
                here = np.flatnonzero((w > 0) & (node >= 2 ** level - 1) & forests.open[trees, node])
                parts.append((here, node[here], np.full(len(here), -1), np.zeros(len(here)), np.full(len(here), y), w[here]))
                for a, x in zip(at.tolist(), v.tolist()):
                    mine = here[(forests.drawn[here % forests.size, node[here], a >> 3] >> (7 - (a & 7)) & 1).astype(bool)]
                    parts.append((mine, node[mine], np.full(len(mine), a), np.full(len(mine), x), np.full(len(mine), y), w[mine]))
            if parts:
                sums = pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*parts))))).groupby(names[:-1], as_index=False).w.sum()
                yield pa.RecordBatch.from_arrays([pa.array(sums[c].to_numpy(), pa.float64() if c in "vw" else pa.int32()) for c in names], names=names)
    return run


def _gini(w: np.ndarray) -> np.ndarray:
    """Impurity times weight."""
    total = w.sum(-1)
    return total - (w * w).sum(-1) / np.where(total > 0, total, 1.0)


def best_split(total: np.ndarray, at: np.ndarray, v: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[int, float, np.ndarray]:
    """Column, threshold and class weights beyond it of a node's best split; column -1 if nothing is gained.
    Entry k: rows of class ``y[k]`` with ``v[k]`` in column ``at[k]`` weigh ``w[k]``."""
    found = -1, 0.0, np.zeros_like(total)
    most = 1e-12 * total.sum()
    for column in np.unique(at):
        mine = at == column
        values, which = np.unique(v[mine], return_inverse=True)
        right = np.zeros((len(values), len(total)))
        np.add.at(right, (which, y[mine]), w[mine])
        right = right[::-1].cumsum(0)[::-1]  # weights of this value and larger ones
        left = total - right
        gain = np.where((left.sum(1) > 0) & (right.sum(1) > 0), _gini(total) - _gini(left) - _gini(right), 0.0)
        k = int(gain.argmax())
        if gain[k] > most:
            most, found = gain[k], (int(column), float((values[k] + (values[k - 1] if k else 0.0)) / 2), right[k])
    return found


def _chosen(classes: int):
    def run(batches):
        tables = [pa.Table.from_batches([b]) for b in batches]
        rows = []
        if tables:
            for (tree, node), g in pa.concat_tables(tables).to_pandas().groupby(["tree", "node"]):
                every = (g["at"] < 0).to_numpy()
                at, v, y, w = (g[c].to_numpy() for c in ("at", "v", "y", "w"))
                total = np.bincount(y[every], w[every], classes)
                column, over, right = best_split(total, *(x[~every] for x in (at, v, y, w)))
                rows.append((tree, node, column, over, total.tolist(), right.tolist()))
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)],
                                         names=["tree", "node", "at", "over", "total", "beyond"])
    return run


def grow(rows: DataFrame, folds: int, size: int, depth: int, classes: int, columns: int, seed: int) -> Forests:
    """The forests of stored ``rows`` (at, v, y, fold, n, key), level by level."""
    sc, forests = rows.sparkSession.sparkContext, Forests(folds, size, depth, classes, columns, seed)
    for level in range(depth):
        shared = sc.broadcast(forests)
        stats = rows.mapInArrow(_level(shared, level), STATS).groupBy("tree", "node", "at", "v", "y").agg(F.sum("w").alias("w"))
        got = stats.repartition("tree", "node").mapInArrow(_chosen(classes), "tree int, node int, at int, over double, total array<double>, beyond array<double>").collect()
        shared.unpersist()
        for r in got:
            total, right = np.array(r.total), np.array(r.beyond)
            forests.weight[r.tree, r.node] = total
            if r["at"] >= 0:
                forests.column[r.tree, r.node], forests.over[r.tree, r.node] = r["at"], r.over
                for child, w in ((2 * r.node + 1, total - right), (2 * r.node + 2, right)):
                    forests.weight[r.tree, child] = w
                    forests.open[r.tree, child] = level + 1 < depth and np.count_nonzero(w) > 1
    return forests


def _judged(shared):
    """(fold, right, all): how many of a fold's rows its forest classifies right; the forest of all folds judges the rows held out."""
    def run(batches):
        forests: Forests = shared.value
        sums = np.zeros((forests.folds + 1, 2), np.int64)
        share = forests.weight / np.maximum(forests.weight.sum(-1, keepdims=True), 1e-300)
        for b in batches:
            for at, v, y, fold, n, _ in _rows(b):
                fold = forests.folds if fold == HOLDOUT else fold
                trees = np.flatnonzero(forests.of == fold)
                said = share[trees, forests.reached(at, v, forests.depth)[trees]].sum(0).argmax()
                sums[fold] += n * int(said == y), n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums[:, 0]), pa.array(sums[:, 1])], names=["fold", "good", "n"])
    return run


def cross_validated(rows: DataFrame, folds: int, size: int, depth: int, classes: int, columns: int, seed: int) -> list[float]:
    """Accuracies of ``rows`` (features, label, fold, n): of each fold by the forest of the other folds, and of the
    rows held out by the forest of all folds."""
    f = F.unwrap_udt("features")
    bounded_batches(rows.sparkSession)
    x = (rows.select(f["indices"].alias("at"), f["values"].alias("v"), F.col("label").cast("int").alias("y"), F.col("fold").cast("int").alias("fold"), "n")
         .groupBy("at", "v", "y", "fold").agg(F.sum("n").cast("long").alias("n")).withColumn("key", F.xxhash64("at", "v", "y", "fold")))
    stored = materialize(x)
    forests = grow(stored, folds, size, depth, classes, columns, seed)
    shared = stored.sparkSession.sparkContext.broadcast(forests)
    told = stored.mapInArrow(_judged(shared), "fold int, good long, n long").groupBy("fold").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).orderBy("fold").collect()
    shared.unpersist()
    drop_stored(stored)
    return [r.good / r.n if r.n else float("nan") for r in told]
