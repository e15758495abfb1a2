"""The network trainer against plain numpy, its folds, and the grid."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from cartwalk.operators import networks as NW

SIZES = (2 * NW.BUCKETS, 7, 5, 3)


@pytest.mark.parametrize("activation", ["relu", "tanh"])
def test_gradient_by_differences(activation):
    rng = np.random.default_rng(0)
    w, x, y, n = NW.initial(SIZES, activation, 1), rng.normal(size=(9, SIZES[0])), rng.integers(0, 3, 9), rng.integers(1, 4, 9).astype(float)
    def loss(v):
        return -(n * np.log(NW.forward(v, SIZES, activation, x)[-1][np.arange(9), y])).sum()
    g = NW.gradient(w, SIZES, activation, x, y, n)
    for k in rng.choice(len(w), 60, replace=False):
        step = np.zeros_like(w)
        step[k] = 1e-6
        assert g[k] == pytest.approx((loss(w + step) - loss(w - step)) / 2e-6, abs=1e-4)


def _rows(spark, n=900, parts=5):
    """Class 2 where both ids agree in parity, else 0 or 1 by one of them: no
    single id tells it."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        a, b = (int(v) for v in rng.integers(0, 6, 2))
        y = 2 if a % 2 == b % 2 else a % 2
        rows.append((a, b, y, int(rng.integers(1, 3)), i % 5, (i // 5) % 5, i * 6 // n, i % 2, i % 10 == 0))
    return spark.createDataFrame(rows, "a int, b int, y int, n long, kfold int, stratified int, time int, batch int, held boolean").repartition(parts), rows


@pytest.mark.parametrize("fan", [2, 64])
def test_steps_are_those_of_the_whole_minibatch(spark, monkeypatch, fan):
    monkeypatch.setattr(NW, "FAN_IN", fan)
    df, rows = _rows(spark)
    grid = [NW.Point((7, 5), "tanh", "adam"), NW.Point((7, 5), "relu", "sgd")]
    trainer = NW.Trainer(df, 3, grid, 5, 2)
    trainer.train(2)
    arr = np.array([[*r[:8], int(r[8])] for r in rows])
    x = np.zeros((len(rows), 2 * NW.BUCKETS))
    x[np.arange(len(rows))[:, None], np.stack([arr[:, 0], NW.BUCKETS + arr[:, 1]], 1)] = 1
    for net in [trainer.nets[0], trainer.nets[7], trainer.nets[-1]]:
        s, f, p = net.scheme, net.fold, net.point
        part = arr[:, 4 + s]
        train = part <= f if NW.SCHEMES[s] == "time" else part != f
        mean = np.average(x[train], axis=0, weights=arr[train, 3])
        z = (x - mean) / np.where(mean * (1 - mean) > 0, np.sqrt(mean * (1 - mean)), 1)
        twin = NW.Network(p, s, f, SIZES, NW.initial(SIZES, p.activation, 42))
        for _ in range(2):
            for b in (0, 1):
                at = train & (arr[:, 7] == b) & (arr[:, 8] == 0)
                n = arr[at, 3].astype(float)
                twin.apply(NW.gradient(twin.weights, SIZES, p.activation, z[at], arr[at, 2], n) / n.sum())
        assert np.allclose(net.weights, twin.weights, atol=1e-9)


def test_a_network_learns_what_no_single_id_tells(spark):
    df, _ = _rows(spark)
    trainer = NW.Trainer(df, 3, [NW.Point((50,), "relu", "adam"), NW.Point((50,), "tanh", "sgd")], 5, 2)
    before = [r[-1] for r in trainer.scores()]
    trainer.train(25)
    after = trainer.scores()
    assert np.mean(before) < 0.6 and np.mean([r[-1] for r in after]) > 0.97
    tested = {(r[0], r[4]): r[5] for r in after}
    assert len(after) == 2 * 3 * 5 and all(v > 0 for v in tested.values())
    assert not all(n.live for n in trainer.nets)  # some had no better validation accuracy for ten epochs


def test_folds(spark):
    rows = [(i, i % 3, "abc"[min(2, i % 7)], None if i % 50 == 0 else f"2024-01-{1 + (i * i) % 28:02d}") for i in range(700)]
    df = spark.createDataFrame(rows, "item_id long, v int, label string, d string").select("item_id", "v", "label", F.col("d").cast("timestamp_ntz").alias("date"))
    got = NW.assign_folds(df, "label", ["item_id", "v"], "date").collect()
    assert len(got) == 700
    by = {}
    for r in got:
        by.setdefault((r.label, r.stratified), []).append(r)
    for label in "abc":
        sizes = [len(by[label, k]) for k in range(5)]
        assert max(sizes) - min(sizes) <= 1
    assert {r.kfold for r in got} == set(range(5)) and {r.time for r in got} == set(range(6))
    dated = [r for r in got if r.date is not None]
    for fold in range(5):
        train, test = ([r.date for r in dated if keep(r.time)] for keep in (lambda t: t <= fold, lambda t: t == fold + 1))
        assert max(train) < min(test)
    assert all(r.time == 0 for r in got if r.date is None)


def test_grid_over_item_features(spark):
    from cartwalk.plans.registry import Ctx
    ctx = Ctx(spark, "/root/testdata/sf0.001")
    dates = ctx.r.train_views().groupBy("item_id").agg(F.min("date").alias("date"))
    grid = [NW.Point((50,), "relu", "adam"), NW.Point((100, 50), "tanh", "sgd")]
    got = NW.grid_search(ctx.r.item_features(), "feature_category_literal", dates, grid, epochs=3).collect()
    assert {(r.scheme, r.hidden, r.activation, r.solver) for r in got} == {(s, "-".join(map(str, p.hidden)), p.activation, p.solver) for s in NW.SCHEMES for p in grid}
    assert len(NW.GRID) == 16 and all(0.5 < r.accuracy <= 1 for r in got)
    assert sum(r.is_best for r in got) == 3 and all(r.folds == 5 for r in got if r.scheme != "time")
    assert NW.grid_search(ctx.r.item_features().limit(0), "feature_category_literal", dates, grid[:1], epochs=1).count() == 3
