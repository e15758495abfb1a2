"""Hard negatives against brute force, and the tree's bounds."""
import random

import numpy as np
import pytest

from cartwalk.llm import negatives


def _by_force(rows, every=50, n_pos=5, n_neg=3, least=50, most=95):
    rows = sorted({(i, l, tuple(int(np.floor(256 * float(x))) for x in v)) for i, v, l in rows
                   if i is not None and l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)})
    def score(a, b):
        return sum(x * y for x, y in zip(a, b))
    out = set()
    for a in rows:
        if a[0] % every:
            continue
        others = [(score(a[2], r[2]), r) for r in rows if r[0] != a[0]]
        pos = sorted((-s, r[0]) for s, r in others if r[1] == a[1])[:n_pos]
        for p, pid in pos:
            neg = sorted((-s, r[0]) for s, r in others if r[1] != a[1] and least * -p <= 100 * s <= most * -p)[:n_neg]
            out |= {(a[0], pid, k + 1, nid, -p, -s) for k, (s, nid) in enumerate(neg)}
    return out


def _got(df, **kw):
    rows = list(map(tuple, negatives.hard_negatives(df, **kw).collect()))
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("leaf,fan", [(4, 3), (64, 8)])
def test_brute_force(spark, monkeypatch, leaf, fan):
    monkeypatch.setattr(negatives, "LEAF", leaf)
    monkeypatch.setattr(negatives, "FANOUT", fan)
    monkeypatch.setattr(negatives, "BLOCK", 50)  # several blocks a leaf
    rnd = random.Random(leaf)
    hot = [0.5, 0.25, -0.125, 0.0]
    rows = []
    for i in range(400):
        v = hot if rnd.random() < 0.3 else [rnd.choice([-1.0, -0.5, 0.0, 0.00390625, 0.5, 1.0, 2.5]) for _ in range(rnd.choice([4, 4, 4, 2]))]
        rows.append((i, v, rnd.randint(0, 3)))
    rows += rows[:40]  # equal rows
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = _by_force(rows, every=5)
    assert want and _got(df, anchor_every=5) == want


def test_tree_loses_nothing(monkeypatch):
    monkeypatch.setattr(negatives, "LEAF", 5)
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 200, (12, 6))
    v = np.floor(centres[rng.integers(0, 12, 2000)] + rng.normal(0, 10, (2000, 6))).astype(np.int64)
    top = float((v * v).sum(1).max())
    tree = negatives.Tree(v[:500], top)
    x = tree.raised(v)
    tree.set_ranges(tree.ranges(x))
    leaf, q = tree.leaf_of(x), v[:100]
    s = q @ v.T
    lows = np.sort(s, 1)[:, -20:-19]
    opened = tree.open_leaves(np.hstack([q.astype(float), np.zeros((100, 1))]), *negatives._annuli(q, top, lows, np.full_like(lows, negatives._FAR)))
    assert tree.leaves > 20
    for k in range(100):
        assert opened[k, leaf[s[k] >= lows[k]]].all()
    assert opened.mean() < 0.7  # clustered rows: many leaves are left out


def test_edges(spark):
    schema = "vec_id long, embedding array<float>, label int, id long, v string, qid int, `a.b` int"
    def row(i, v, l):
        return (i, v, l, 1, "x", 2, 3)
    nan, inf = float("nan"), float("inf")
    rows = [row(0, [1.0, 0.0], 1), row(1, [1.0, 0.5], 1), row(2, [0.75, 0.0], 2), row(2, [0.75, 0.0], 2), row(3, [0.5, 9.0], 2), row(4, [0.75, 1.0], 2),
            row(5, None, 2), row(6, [1.0, nan], 2), row(8, [inf, 1.0], 2), row(9, [1.0, None], 2), row(10, [0.8, 0.0], None), row(None, [0.8, 0.0], 2),
            row(50, [], 1), row(100, [-1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, schema)
    want = _by_force([r[:3] for r in rows])
    assert {(0, 1, 1, 2), (0, 1, 2, 4)} <= {r[:4] for r in want} and _got(df) == want
    assert _got(df.limit(0)) == set() and _got(df.filter("vec_id = 0")) == set() and _got(df.filter("vec_id = 3")) == set()
    with pytest.raises(Exception, match="too large"):
        _got(spark.createDataFrame([(0, [1e30], 1)], "vec_id long, embedding array<float>, label int"))
