"""Hard-negative mining with a multiway hyperplane tree (GNAT).

For an anchor and each of its positives the best-scoring rows of other labels
are wanted whose score lies in a window below the positive's score.  Scores are
integer inner products.  With one coordinate more, ``sqrt(M - |v|^2)`` for a row
and 0 for an anchor (M: the largest square norm), ``|q - v|^2 = |q|^2 + M - 2 *
score``, so a window of scores is an annulus around the anchor.

The tree.  Split points are fitted on at most ``SAMPLE`` rows; every row goes
down to the nearest split point of each node until it reaches a leaf.  For each
split point the least and greatest distance to the rows below each sibling are
taken over *all* rows.  A query at distance D of a split point leaves out a
child with range [lo, hi] when the annulus [r1, r2] can't meet it: ``lo > D +
r2``, ``hi < D - r2`` or ``D + hi < r1``.  Leaves are searched exactly.

How it runs.  The tree has at most a few hundred leaves, so it is broadcast.
Queries are sent to the leaves that are left, rows stand there in blocks of at
most ``BLOCK`` rows, and one task multiplies a block of queries with a block of
rows.  Each search is made twice: first in the leaf the query itself belongs
to, then, with the bound found there, in the others that can hold something
better.  Anchors of equal vector and label are one query, and of rows of equal
vector and label only as many as can be returned (those of the smallest ids)
stand in the leaves; all others score the same and come after them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartwalk.llm.common import quoted, ready, stored

SAMPLE = 32_768
FANOUT = 8
LEAF = 256         # sample rows of a leaf
BLOCK = 4096       # rows, and queries, that one task holds at once
SLICE = 256
LARGEST = 1 << 26  # of a scaled component: products of 2,048 of them fit 64 bits
_FAR = np.iinfo(np.int64).max


class Tree:
    """Nodes of split points.  ``child[node][j]`` is a node if positive, else
    the leaf ``-child - 1``; ``lo``/``hi``[node][i, j] is the range of the
    distances of split point i to the rows below child j."""

    def __init__(self, points: np.ndarray, top: float):
        self.top, self.splits, self.child, self.leaves = top, [], [], 0
        self.root = self._grow(self.raised(points))

    def raised(self, v: np.ndarray) -> np.ndarray:
        v = v.astype(np.float64)
        return np.hstack([v, np.sqrt(np.maximum(self.top - np.einsum("ij,ij->i", v, v), 0.0))[:, None]])

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, x: np.ndarray) -> int:
        picks = _spread(x, FANOUT) if len(x) > LEAF else []
        if len(picks) < 2:
            return self._leaf()
        node = len(self.splits)
        self.splits.append(x[picks])
        self.child.append([])
        near = _distances(x, x[picks]).argmin(1)
        self.child[node] = [self._grow(x[near == j]) for j in range(len(picks))]
        return node

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each raised vector."""
        out = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -node - 1
                continue
            near = _distances(x[rows], self.splits[node]).argmin(1)
            todo += [(c, rows[near == j]) for j, c in enumerate(self.child[node]) if (near == j).any()]
        return out

    def ranges(self, x: np.ndarray):
        """(node, i, j, lo, hi) over the raised rows ``x``."""
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0 or not len(rows):
                continue
            d = _distances(x[rows], self.splits[node])
            near = d.argmin(1)
            for j, c in enumerate(self.child[node]):
                mine = near == j
                if mine.any():
                    for i, (lo, hi) in enumerate(zip(d[mine].min(0).tolist(), d[mine].max(0).tolist())):
                        yield node, i, j, lo, hi
                    todo.append((c, rows[mine]))

    def set_ranges(self, rows) -> None:
        self.lo = [np.full((len(s), len(s)), np.inf) for s in self.splits]
        self.hi = [np.full((len(s), len(s)), -np.inf) for s in self.splits]
        for node, i, j, lo, hi in rows:
            self.lo[node][i, j], self.hi[node][i, j] = lo, hi

    def open_leaves(self, q: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """For queries ``q`` with annuli ``near``..``far`` (query by window;
        near > far: none) whether each leaf can hold a row of any of them."""
        out = np.zeros((len(q), self.leaves), bool)
        slack = 1e-6 * (1.0 + np.sqrt(self.top))
        todo = [(self.root, np.arange(len(q)), near <= far)]
        while todo:
            node, rows, live = todo.pop()
            rows, live = rows[live.any(1)], live[live.any(1)]
            if not len(rows):
                continue
            if node < 0:
                out[rows, -node - 1] = True
                continue
            d = _distances(q[rows], self.splits[node]) + 0.0
            r1, r2 = near[rows] - slack, far[rows] + slack
            for j, c in enumerate(self.child[node]):
                ok = live.copy()
                for i in range(d.shape[1]):
                    lo, hi, at = self.lo[node][i, j], self.hi[node][i, j], d[:, i:i + 1]
                    ok &= (lo <= at + r2) & (hi >= at - r2) & (at + hi >= r1)
                todo.append((c, rows, ok))
        return out


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(np.einsum("ij,ij->i", d, d)) for d in (x - p for p in y)], 1)


def _spread(x: np.ndarray, n: int) -> list[int]:
    """Up to ``n`` rows far from one another: the first, then again and again
    the one farthest from those chosen; fewer if the rest are copies."""
    picks, far = [0], np.full(len(x), np.inf)
    while len(picks) < n:
        d = x - x[picks[-1]]
        far = np.minimum(far, np.einsum("ij,ij->i", d, d))
        if far.max() <= 0:
            break
        picks.append(int(far.argmax()))
    return picks


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
    if len(n) and (n == dim).all():
        return flat.reshape(len(n), dim).astype(np.int64)
    out = np.zeros((len(n), dim), np.int64)
    rows = np.repeat(np.arange(len(n)), n)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _scores(q: np.ndarray, v: np.ndarray, small: bool) -> np.ndarray:
    return np.rint(q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64) if small else q @ v.T


def _annuli(q: np.ndarray, top: float, lows: np.ndarray, highs: np.ndarray):
    """Distances of the windows lows..highs of scores (lows of -_FAR: any)."""
    size = np.einsum("ij,ij->i", q.astype(np.float64), q.astype(np.float64))[:, None] + top
    near = np.where(highs >= _FAR, 0.0, np.sqrt(np.maximum(size - 2.0 * highs, 0.0)))
    far = np.where(lows <= -_FAR, np.inf, np.sqrt(np.maximum(size - 2.0 * lows, 0.0)))
    return np.where(lows > highs, 1.0, near), np.where(lows > highs, 0.0, far)


def _search(q, labels, same: bool, lows, highs, ids, rows_label, v, k: int, small: bool):
    """(query, window, row, score): the ``k`` best rows of each query and
    window by score, then id; rows are sorted by id."""
    for lo in range(0, len(q), SLICE):
        s = _scores(q[lo:lo + SLICE], v, small)
        ok = (labels[lo:lo + SLICE, None] == rows_label[None, :]) == same
        s[~ok] = -_FAR
        for w in range(lows.shape[1]):
            a, b = lows[lo:lo + SLICE, w:w + 1], highs[lo:lo + SLICE, w:w + 1]
            left = np.where((s >= np.maximum(a, -_FAR + 1)) & (s <= b), s, -_FAR)
            for _ in range(min(k, len(ids))):
                best = left.argmax(1)
                score = left[np.arange(len(left)), best]
                hit = np.flatnonzero(score > -_FAR)
                if not len(hit):
                    break
                yield lo + hit, w, best[hit], score[hit]
                left[hit, best[hit]] = -_FAR


class Index:
    """The rows in their leaves.

    ``rows`` (id long, label int, v array<long>) are the rows to be searched,
    stored; ``copies`` is how many rows of equal label and vector stand in it."""

    def __init__(self, rows: DataFrame, dim: int, most: int, top: float):
        spark = rows.sparkSession
        self.dim, self.small = dim, dim * most * most < 1 << 53
        sample = rows.orderBy(F.xxhash64("id", "v"), "id", "label", "v").limit(SAMPLE).select("v").toArrow()
        tree = Tree(_matrix(sample.column("v"), dim), top)
        sent = spark.sparkContext.broadcast(tree)

        def deal(batches):
            for b in batches:
                leaf = sent.value.leaf_of(sent.value.raised(_matrix(b.column(2), dim)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int32())], names=["id", "label", "v", "leaf"])

        def measure(batches):
            got: dict[tuple, tuple] = {}
            for b in batches:
                for node, i, j, lo, hi in sent.value.ranges(sent.value.raised(_matrix(b.column(2), dim))):
                    old = got.get((node, i, j), (lo, hi))
                    got[node, i, j] = min(lo, old[0]), max(hi, old[1])
            yield pa.RecordBatch.from_pylist([dict(node=k[0], i=k[1], j=k[2], lo=x[0], hi=x[1]) for k, x in got.items()], pa.schema(
                [("node", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64())]))

        self.rows = stored(rows.select("id", "label", "v").mapInArrow(deal, "id long, label int, v array<long>, leaf int"))
        ranges = self.rows.mapInArrow(measure, "node int, i int, j int, lo double, hi double").groupBy("node", "i", "j").agg(F.min("lo"), F.max("hi"))
        tree.set_ranges(tuple(r) for r in ranges.collect())  # at most FANOUT^2 rows a node
        self.tree = spark.sparkContext.broadcast(tree)
        self.n_rows = {r[0]: r[1] for r in self.rows.groupBy("leaf").count().collect()}

    def find(self, queries: DataFrame, k: int, same: bool, home: bool) -> DataFrame:
        """``queries`` (qid, label, v, lows, highs: windows of scores) -> (qid,
        win, id, score), of every leaf visited the ``k`` best rows of the
        window with the query's label (``same``) or another.  ``home``: only the
        leaf the query belongs to, else only the other leaves that are open."""
        dim, tree, small = self.dim, self.tree, self.small

        def route(batches):
            for b in batches:
                v = _matrix(b.column(2), dim)
                t = tree.value
                own = t.leaf_of(t.raised(v))
                if home:
                    row, leaf = np.arange(len(v)), own
                else:
                    lows, highs = (_matrix(b.column(c), b.column(c).value_lengths()[0].as_py() if len(v) else 1) for c in (3, 4))
                    q = np.hstack([v.astype(np.float64), np.zeros((len(v), 1))])
                    opened = t.open_leaves(q, *_annuli(v, t.top, lows, highs))
                    opened[np.arange(len(v)), own] = False
                    row, leaf = np.nonzero(opened)
                for lo in range(0, len(row), 10_000):
                    part = b.take(pa.array(row[lo:lo + 10_000], pa.int64()))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaf[lo:lo + 10_000], pa.int32())], names=[*b.schema.names, "leaf"])

        sent = queries.select("qid", "label", "v", "lows", "highs").mapInArrow(
            route, "qid long, label int, v array<long>, lows array<long>, highs array<long>, leaf int")
        sent = stored(sent)
        n_queries = {r[0]: r[1] for r in sent.groupBy("leaf").count().collect()}
        blocks = lambda n: -(-n // BLOCK)

        def per_leaf(counts):  # a leaf's number of blocks, of the bounded number of leaves
            some = {x: blocks(n) for x, n in counts.items() if n > BLOCK}
            return F.coalesce(F.create_map(*[F.lit(y) for x in some.items() for y in x])[F.col("leaf")], F.lit(1)) if some else F.lit(1)

        rows = self.rows.withColumn("part", F.pmod(F.xxhash64("id", "label", "v"), per_leaf(self.n_rows)).cast("int"))
        rows = rows.withColumn("qpart", F.explode(F.sequence(F.lit(0), per_leaf(n_queries) - 1)))
        sent = sent.withColumn("qpart", F.pmod(F.xxhash64("qid"), per_leaf(n_queries)).cast("int"))
        sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0), per_leaf(self.n_rows) - 1)))

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            if left.num_rows and right.num_rows:
                order = np.argsort(left.column("id").to_numpy(), kind="stable")
                ids, label = left.column("id").to_numpy()[order], left.column("label").to_numpy()[order]
                lows, highs = (_matrix(right.column(c), right.column(c).combine_chunks().value_lengths()[0].as_py()) for c in ("lows", "highs"))
                qid = right.column("qid").to_numpy()
                for q, w, row, score in _search(_matrix(right.column("v"), dim), right.column("label").to_numpy(), same, lows, highs,
                                                ids, label, _matrix(left.column("v"), dim)[order], k, small):
                    out.append((qid[q], np.full(len(q), w), ids[row], score))
            cols = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out) if out else [[]] * 4)]
            return pa.table({n: pa.array(c, t) for n, c, t in zip(("qid", "win", "id", "score"), cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))})

        return rows.groupBy("leaf", "part", "qpart").cogroup(sent.groupBy("leaf", "part", "qpart")).applyInArrow(
            meet, "qid long, win int, id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query and window as ``hits``, best first."""
    w = Window.partitionBy("qid", "win").orderBy(F.col("score").desc(), "id")
    top = found.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k)
    return top.groupBy("qid", "win").agg(F.sort_array(F.collect_list(F.struct(F.col("_n").alias("rank"), "id", "score"))).alias("hits"))


def scaled(rows: DataFrame, id_col: str, vec_col: str, label_col: str, scale: float) -> DataFrame:
    """(id, label, v): components as floor(scale * x).  Rows with a null id,
    label, vector or component or a component that isn't finite are left out;
    equal rows count once; a vector without components is a zero vector."""
    x = F.transform(quoted(vec_col), lambda c: c.cast("double"))
    ok = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))))
    fits = F.forall(x, lambda c: F.abs(c * F.lit(float(scale))) < F.lit(float(LARGEST)))
    v = F.when(fits, v).otherwise(F.raise_error(F.lit("a scaled component is too large for exact 64-bit scores")))
    kept = rows.filter(quoted(id_col).isNotNull() & quoted(label_col).isNotNull() & quoted(vec_col).isNotNull()).filter(ok)
    return kept.select(quoted(id_col).cast("long").alias("id"), quoted(label_col).cast("int").alias("label"), v.cast("array<long>").alias("v")).distinct()


def hard_negatives(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", anchor_every: int = 50,
                   n_positives: int = 5, n_negatives: int = 3, least: int = 50, most: int = 95, scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score): for each anchor (ids divisible by ``anchor_every``) and
    each of its ``n_positives`` best other rows of its label the
    ``n_negatives`` best rows of other labels with ``least * positive_score <=
    100 * negative_score <= most * positive_score``; scores are inner products
    of the scaled integer vectors, ties go to the smaller id, rank is from 1.

    Rows that can't be scored are left out and equal rows count once (see
    :func:`scaled`); shorter vectors are as if filled with zeros; pairs without
    a negative give no row; an empty table gives an empty one; columns beside
    the three named are not looked at.  Components of 2^26 or more after
    scaling raise an error."""
    spark = ready(rows.sparkSession)
    base = stored(scaled(rows, id_col, vec_col, label_col, scale))
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c)
    size = base.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs))), F.max(norm)).first()
    dim, largest, top = max(1, size[0] or 0), size[1] or 0, size[2] or 0.0
    anchors = base.filter(F.col("id") % anchor_every == 0)
    queries = stored(anchors.select("label", "v").distinct().withColumn("qid", F.monotonically_increasing_id()))
    # Of equal vectors of a label the anchor itself and the best n can be returned.
    copies = Window.partitionBy("label", "v").orderBy("id")
    index = Index(stored(base.withColumn("_n", F.row_number().over(copies)).filter(F.col("_n") <= max(n_positives + 1, n_negatives)).drop("_n")),
                  dim, largest, top)

    def searched(ask: DataFrame, k: int, same: bool) -> DataFrame:
        """Both passes; the second with the lows raised to the k-th best."""
        first = stored(index.find(ask, k, same, True))
        bound = _best(first, k).filter(F.size("hits") >= k).select("qid", "win", F.element_at("hits", k)["score"].alias("low"))
        low = bound.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("win", "low"))).alias("_low"))
        raised = ask.join(low, "qid", "left").withColumn("lows", F.transform("lows", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at(F.col("_low"), i), x))))
        return _best(first.unionByName(index.find(raised.drop("_low"), k, same, False)), k)

    any_score = lambda x: F.array(F.lit(int(x)))
    positives = stored(searched(queries.withColumn("lows", any_score(-_FAR)).withColumn("highs", any_score(_FAR)), n_positives + 1, True))
    windows = positives.select("qid", F.array_sort(F.array_distinct(F.col("hits.score"))).alias("of"))
    # Up to n_positives + 1 windows, missing ones empty; whole hundredths: floor(x / 100), and up by floor((x + 99) / 100).
    def bounds(factor: int, up: int, missing: int):
        def one(i):
            x = F.try_element_at(F.col("of"), i) * F.lit(factor) + F.lit(up)
            return F.coalesce(F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100)), F.lit(missing).cast("long"))
        return F.transform(F.sequence(F.lit(1), F.lit(n_positives + 1)), one)
    asked = queries.join(windows, "qid").select("qid", "label", "v", "of", bounds(least, 99, 1).alias("lows"), bounds(most, 0, 0).alias("highs"))
    asked = stored(asked)
    found = searched(asked.drop("of"), n_negatives, False)
    negatives = found.join(asked.select("qid", "of"), "qid").select("qid", F.struct(F.element_at("of", F.col("win") + 1).alias("of"), "hits").alias("w")) \
        .groupBy("qid").agg(F.collect_list("w").alias("wins"))
    answers = positives.select("qid", "hits").join(negatives, "qid").join(queries, "qid").select("label", "v", "hits", "wins")
    mine = anchors.join(answers, ["label", "v"]).select(
        F.col("id").alias("anchor_id"), "wins",
        F.explode(F.slice(F.filter("hits", lambda h: h["id"] != F.col("id")), 1, n_positives)).alias("p"))
    pairs = mine.select("anchor_id", "p", F.explode(F.flatten(F.transform(F.filter("wins", lambda w: w["of"] == F.col("p")["score"]), lambda w: w["hits"]))).alias("n"))
    return pairs.select("anchor_id", F.col("p")["id"].alias("positive_id"), F.col("n")["rank"].cast("int").alias("rank"), F.col("n")["id"].alias("negative_id"),
                        F.col("p")["score"].alias("positive_score"), F.col("n")["score"].alias("negative_score"))


def relabelled(rows: DataFrame) -> DataFrame:
    """The query's input: rows whose id is divisible by 7 carry the next of
    ten labels."""
    return rows.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))


NEGATIVES_SQL = """
WITH r AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
