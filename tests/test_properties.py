"""Properties of the model and the lists on the smallest test tables."""

import pytest
from pyspark.sql import functions as F

from cartwalk.operators import walk as WK
from cartwalk.plans import recommend as P
from cartwalk.plans.registry import Ctx, load_all
from conftest import SF001


@pytest.fixture(scope="module")
def ctx(spark):
    load_all()
    return Ctx(spark, SF001)


def test_w_properties(ctx):
    urm = P.train_urm(ctx)
    row_cut = WK.rp3_normalized(WK.rp3_topk_row(WK.rp3_similarity(urm), 5))
    sums = row_cut.groupBy("item_i").agg(F.sum("sim").alias("s")).agg(F.min("s"), F.max("s")).first()
    assert sums[0] == pytest.approx(1.0) and sums[1] == pytest.approx(1.0)
    W = WK.rp3_fit(urm, topK=5)
    assert W.groupBy("item_i").count().agg(F.max("count")).first()[0] <= 5
    assert W.groupBy("item_j").count().agg(F.max("count")).first()[0] <= 5
    assert W.filter(F.col("item_i") == F.col("item_j")).count() == 0


def test_list_properties(ctx):
    prof = P.test_profile(ctx)
    rec = P.recommend(ctx, prof, P.fit_w(ctx), 10)
    # no seen or excluded item
    assert rec.join(prof, ["session_id", "item_id"], "left_semi").count() == 0
    assert rec.join(P.excluded(ctx), "item_id", "left_semi").count() == 0
    # ranks contiguous 1..n and lists full
    per = rec.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("lo"),
                                        F.max("rank").alias("hi"), F.countDistinct("item_id").alias("d"))
    bad = per.filter((F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("d") != F.col("n")) | (F.col("n") != 10))
    assert bad.count() == 0
    assert per.count() == prof.select("session_id").distinct().count()


def test_eval_bounds(ctx):
    from cartwalk.operators import evaluation as EV
    from cartwalk.plans.queries_eval import eval_inputs
    wide = EV.evaluate(eval_inputs(ctx, div=False)).collect()
    for r in wide:
        for m in ["COVERAGE_ITEM", "COVERAGE_USER", "COVERAGE_USER_CORRECT", "PRECISION", "RECALL", "MAP", "NDCG"]:
            assert 0.0 <= r[m] <= 1.0, m
        # every evaluated user gets a list: HR = COVERAGE_USER_CORRECT / COVERAGE_USER
        assert r["HIT_RATE"] == pytest.approx(r["COVERAGE_USER_CORRECT"] / r["COVERAGE_USER"] * 1.0, rel=1e-9) \
            or r["COVERAGE_USER"] != 1.0
