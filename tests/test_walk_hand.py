"""The hand matrix of the walk model and the ranking on top of it."""

import pytest

from cartwalk.operators import ranking as RK
from cartwalk.operators import walk as WK

URM = [(1, 0, 1.0), (1, 1, 1.0), (2, 1, 1.0), (2, 2, 1.0), (2, 3, 1.0), (3, 0, 1.0), (3, 2, 1.0), (4, 3, 1.0), (4, 4, 2.0)]
S = {(0, 1): 0.164938, (0, 2): 0.164938, (1, 0): 0.164938, (1, 2): 0.109959, (1, 3): 0.109959, (2, 0): 0.164938,
     (2, 1): 0.109959, (2, 3): 0.109959, (3, 1): 0.109959, (3, 2): 0.109959, (3, 4): 0.333333, (4, 3): 0.219918}
W = {(0, 1): 0.5, (0, 2): 0.5, (1, 0): 0.6, (1, 2): 0.4, (2, 0): 0.6, (2, 1): 0.4, (3, 4): 0.751949, (4, 3): 1.0}


@pytest.fixture(scope="module")
def urm(spark):
    return spark.createDataFrame(URM, "session_id long, item_id long, score double")


def test_similarity(urm):
    got = {(r.item_i, r.item_j): r.sim for r in WK.rp3_similarity(urm).collect()}
    assert set(got) == set(S)
    for k, v in S.items():
        assert got[k] == pytest.approx(v, abs=1e-6)


def test_similarity_salted(urm):
    # forcing every profile into salt buckets of one row gives the same S
    got = {(r.item_i, r.item_j): r.sim for r in WK.rp3_similarity(urm, salt_rows=1).collect()}
    for k, v in S.items():
        assert got[k] == pytest.approx(v, abs=1e-6)


def test_fit(urm):
    got = {(r.item_i, r.item_j): r.sim for r in WK.rp3_fit(urm, topK=2).collect()}
    assert set(got) == set(W)
    for k, v in W.items():
        assert got[k] == pytest.approx(v, abs=1e-6)


def test_recommend_with_zero_fill(spark, urm):
    Wdf = WK.rp3_fit(urm, topK=2)
    prof = spark.createDataFrame([(9, 1, 1.0)], "session_id long, item_id long, score double")
    items = spark.createDataFrame([(i,) for i in range(5)], "item_id long")
    rows = RK.rec_topk(prof, Wdf, items, cutoff=3).orderBy("rank").collect()
    assert [r.item_id for r in rows] == [0, 2, 3]
    assert [r.score for r in rows][:2] == pytest.approx([0.6, 0.4])
    assert [r["rank"] for r in rows] == [1, 2, 3]


def test_cutoff_capped_and_exclusions(spark, urm):
    Wdf = WK.rp3_fit(urm, topK=2)
    prof = spark.createDataFrame([(9, 1, 1.0)], "session_id long, item_id long, score double")
    items = spark.createDataFrame([(i,) for i in range(5)], "item_id long")
    excl = spark.createDataFrame([(0,)], "item_id long")
    rows = RK.rec_topk(prof, Wdf, items, cutoff=10, exclude=excl).orderBy("rank").collect()
    # cutoff capped at n_items - 1 = 4; item 1 seen, item 0 excluded -> 3 items
    assert [r.item_id for r in rows] == [2, 3, 4]
