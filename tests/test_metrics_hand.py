"""Metric values on the hand lists (expected values follow the formulas)."""

import pytest
from pyspark.sql import functions as F

from cartwalk.operators import evaluation as EV

REL = {2: 5.0, 4: 4.0, 5: 3.0, 10: 2.0}
CASES = [
    ([1, 2, 3, 4, 5], dict(recall=0.75, precision=0.6, rr=0.5, ap_min_den=0.4, ap=0.32, arhr=0.95, ndcg=0.634766)),
    ([10, 5, 2, 4, 3], dict(recall=1.0, precision=0.8, rr=1.0, ap_min_den=1.0, ap=0.8, arhr=2.083333, ndcg=0.649122)),
    ([1, 3, 6, 7, 8], dict(recall=0.0, precision=0.0, rr=0.0, ap_min_den=0.0, ap=0.0, arhr=0.0, ndcg=0.0)),
    ([11, 12, 13, 14, 15, 16, 2, 4, 5, 10], dict(recall=1.0, precision=0.4, rr=0.142857, ap_min_den=0.281548, ap=0.112619)),
    ([2, 11, 12, 13, 14, 15, 4, 5, 10, 16], dict(recall=1.0, precision=0.4, rr=1.0, ap_min_den=0.526290, ap=0.210516)),
]


def _metrics(spark, items, cutoffs):
    ranking = spark.createDataFrame([(1, it, r + 1) for r, it in enumerate(items)], "session_id long, item_id long, rank long")
    test = spark.createDataFrame([(1, k, v) for k, v in REL.items()], "session_id long, item_id long, score double")
    users = spark.createDataFrame([(1,)], "session_id long")
    rel = EV.eval_relevance(ranking, test, users, cutoffs)
    return {r["cutoff"]: r.asDict() for r in EV.user_metrics(rel, test, users, cutoffs).collect()}


@pytest.mark.parametrize("items,expected", CASES)
def test_hand_lists(spark, items, expected):
    got = _metrics(spark, items, [len(items)])[len(items)]
    for k, v in expected.items():
        assert got[k] == pytest.approx(v, abs=1e-6), k


def test_first_list_by_cutoff(spark):
    got = _metrics(spark, [1, 2, 3, 4, 5], [1, 2, 3, 4, 5])
    assert [got[k]["recall"] for k in range(1, 6)] == pytest.approx([0, .25, .25, .5, .75])
    assert [got[k]["precision"] for k in range(1, 6)] == pytest.approx([0, 1 / 2, 1 / 3, 2 / 4, 3 / 5])
    assert [got[k]["rr"] for k in range(1, 6)] == pytest.approx([0, .5, .5, .5, .5])


def test_distribution_metrics(spark):
    # counts 1, 2, 3 over 5 items (two zero-count items)
    counts = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3)], "k int, item_id long, c long")
    n_eff = spark.createDataFrame([(5,)], "n_eff long")
    r = EV.distribution(counts, n_eff, ["k"]).first()
    import numpy as np
    c = np.sort(np.array([0, 0, 1, 2, 3], dtype=float))
    n = len(c)
    gini = 2 * np.sum((n + 1 - np.arange(1, n + 1)) / (n + 1) * c / c.sum())
    p = c[c > 0] / c.sum()
    assert r["gini"] == pytest.approx(gini)
    assert r["herfindahl"] == pytest.approx(1 - np.sum(p ** 2))
    assert r["shannon"] == pytest.approx(-np.sum(p * np.log2(p)))


def test_mrr_frame(spark):
    pred = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (2, 1, 0), (2, 2, 0)], "session_id long, rank long, target int")
    assert EV.mrr_frame(pred).first()["mrr"] == pytest.approx(0.25)
