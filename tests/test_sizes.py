"""Plans and amounts that must not grow with a large side."""

import re

from cartwalk.operators import ranking as RK
from cartwalk.operators import retrieval as RT
from cartwalk.operators import text as TX
from cartwalk.operators import walk as WK
from cartwalk.operators.ids import BROADCAST_ROWS, join_small
from cartwalk.plans import queries_rec as QR
from cartwalk.plans import queries_text as QT
from cartwalk.plans import recommend as P
from cartwalk.plans.registry import Ctx
from cartwalk import session
from cartwalk.session import materialize
from cartwalk.sources import roles


def broadcast_parts(df):
    """Explained lines of what is broadcast, one text for each exchange."""
    out, lines = [], df._jdf.queryExecution().executedPlan().toString().splitlines()
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            depth = line.index("BroadcastExchange")
            below = []
            for x in lines[i + 1:]:
                if len(x) - len(x.lstrip(" :+-*()0123456789")) <= depth:
                    break
                below.append(x)
            out.append("\n".join(below))
    return out


def test_feature_rows_are_not_broadcast(spark):
    f = Ctx(spark, "/root/testdata/sf0.1").r.item_features()
    parts = broadcast_parts(f)
    assert parts and not any("stack(" in p for p in parts), parts


def test_join_small_both_ways(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    for n in (5, BROADCAST_ROWS + 1):
        small = materialize(spark.range(n).selectExpr("id AS k", "id * 2 AS v"))
        got = join_small(df, small, "k", "left")
        assert bool(broadcast_parts(got)) == (n <= BROADCAST_ROWS)
        assert sorted(map(tuple, got.collect())) == [(k, 2 * k if k < n else None) for k in range(10)]


def shuffled_by(df):
    """Names of the keys of every hash exchange in the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [tuple(re.findall(r"([a-z_]+)#", keys)) for keys in re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", plan)]


def test_pairs_and_scores_are_shuffled_once(spark):
    urm = spark.createDataFrame([(u, i, 1.0 + (u * i) % 3) for u in range(30) for i in range(u % 5 + 8)],
                                "session_id LONG, item_id LONG, score DOUBLE")
    W = WK.rp3_fit(urm, topK=4)
    keys = shuffled_by(W)
    assert ("item_i",) in keys and not any({"item_i", "item_j"} <= set(k) for k in keys)
    # the column cut against a window over the stored rows
    rows = WK.rp3_normalized(WK.rp3_topk_row(WK.rp3_similarity(urm), 4))
    want = WK.topk_by(rows, "item_j", "item_i", 4)
    assert want.count() < rows.count()
    assert sorted(W.select("item_i", "item_j").collect()) == sorted(want.select("item_i", "item_j").collect())

    profile = urm.filter("session_id % 3 = 0").unionByName(spark.createDataFrame([(99, 10 ** 6, 1.0)], urm.schema))
    got = RK.rec_scores(profile, W, remove_seen=True)
    keys = shuffled_by(got)
    assert ("session_id",) in keys and not any("session_id" in k and len(k) > 1 and "_k" not in k for k in keys)
    want = RK.rec_scores(profile, W).join(profile, ["session_id", "item_id"], "left_anti")
    a = {(r.session_id, r.item_id): round(r.score, 9) for r in got.collect()}
    assert a and a == {(r.session_id, r.item_id): round(r.score, 9) for r in want.collect()}


def test_search_shuffles_no_copies(spark, monkeypatch):
    """Shards meet blocks of queries without being shuffled for each other."""
    monkeypatch.setattr(RT, "QUERY_BLOCK", 3)
    v = [(i, (i * k) % 17, 1 + k) for i in range(40) for k in (1, 3, 7)]
    d = spark.createDataFrame(v, "item_id long, term_id long, tf long").groupBy("item_id", "term_id").agg({"tf": "sum"}).toDF("item_id", "term_id", "tf")
    q = d.filter("item_id % 2 = 0").withColumnRenamed("item_id", "query_id")
    got = RT.block_max_search(q, d, "query_id", "item_id", 0.1, shard_docs=7)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    want = TX.query_item_cosine(q.withColumnRenamed("term_id", "term"), d.withColumnRenamed("term_id", "term"))
    assert {(r[0], r[1]): round(r[2], 9) for r in got.collect()} == {(r[0], r[1]): round(r[2], 9) for r in want.collect()}


def test_found_pairs_are_not_joined_to_the_queries(spark):
    got = QT.sim_query_items(Ctx(spark, "/root/testdata/sf0.001"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "HashJoin" not in plan and "SortMergeJoin" not in plan


def test_profiles_are_shuffled_once(spark):
    """Short and long profiles read the same shuffle of the interactions by session."""
    urm = materialize(spark.createDataFrame([(u, i, 1.0) for u in range(9) for i in range(4)], "session_id LONG, item_id LONG, score DOUBLE"))
    sim = WK.rp3_similarity(urm, salt_rows=3)
    assert sim.count() == 12
    sim.collect()
    final = sim._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    by_session = [x for x in final.splitlines() if re.search(r"Exchange hashpartitioning\(session_id#\d+L, \d+\)", x)]
    assert any("ReusedExchange" in x for x in final.splitlines()) and sum("Reused" not in x for x in by_session) == 1, final


def test_lines_are_shuffled_once(spark):
    """Finding an order's last line and tagging its lines read one shuffle of the lines."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = Ctx(spark, "/root/testdata/sf0.001").r.train_lines()
        lines.collect()
        final = lines._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    by_session = [x for x in final.splitlines() if re.search(r"Exchange hashpartitioning\(session_id#\d+L, \d+\)", x)]
    assert any("ReusedExchange" in x for x in final.splitlines()) and sum("Reused" not in x for x in by_session) == 1, final


def test_blocked_columns_leave_at_the_column_cut(spark, monkeypatch):
    """A list of blocked items too long to broadcast costs W no further shuffle."""
    urm = materialize(spark.createDataFrame([(u, i, 1.0 + (u * i) % 3) for u in range(30) for i in range(u % 5 + 8)],
                                            "session_id LONG, item_id LONG, score DOUBLE"))
    blocked = materialize(spark.range(3).withColumnRenamed("id", "item_id"))
    rows = lambda df: sorted((r.item_i, r.item_j, round(r.sim, 12)) for r in df.collect())
    want = [r for r in rows(WK.rp3_fit(urm, topK=4)) if r[1] > 2]
    assert rows(WK.rp3_fit(urm, topK=4, without=blocked)) == want
    monkeypatch.setattr(WK, "BLOCKED_ROWS", 0)
    monkeypatch.setattr(RK, "BLOCKED_ROWS", 0)
    W = WK.rp3_fit(urm, topK=4, without=blocked)
    assert rows(W) == want
    uncut = [r for r in rows(WK.rp3_fit(urm, topK=None)) if r[1] > 2]
    assert rows(WK.rp3_fit(urm, topK=None, without=blocked)) == uncut

    catalogue = spark.range(14).withColumnRenamed("id", "item_id")
    args = dict(universe=catalogue, cutoff=5, exclude=blocked, zero_fill=False)
    got = RK.rec_topk(urm, lambda b: WK.rp3_fit(urm, topK=4, without=b), remove_seen=False, **args)
    ranks = lambda df: sorted((r.session_id, r["rank"], r.item_id) for r in df.collect())
    assert ranks(got) == ranks(RK.rec_topk(urm, WK.rp3_fit(urm, topK=4), remove_seen=False, **args))
    w_by_column = [k for k in shuffled_by(W.select("item_i", "item_j", "sim")) if k == ("item_j",)]
    assert len(w_by_column) <= 2  # W for the cut, and the list itself


def test_model_rows_travel_as_two_arrays(spark):
    urm = spark.createDataFrame([(u, i, 1.0) for u in range(9) for i in range(4)], "session_id LONG, item_id LONG, score DOUBLE")
    plan = RK.rec_scores(urm, WK.rp3_fit(urm, topK=4), remove_seen=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_zip(_j#" in plan, plan


def test_long_profiles_are_scored_by_more_tasks(spark, monkeypatch):
    urm = materialize(spark.createDataFrame([(u, i, 1.0) for u in range(9) for i in range(4)], "session_id LONG, item_id LONG, score DOUBLE"))
    W = materialize(WK.rp3_fit(urm, topK=4))
    want = sorted(map(tuple, RK.rec_scores(urm, W).collect()))
    monkeypatch.setattr(RK, "PROFILE_ROWS", 2)
    got = RK.rec_scores(urm, W)
    assert re.search(r"hashpartitioning\(session_id#\d+L, 18\)", got._jdf.queryExecution().executedPlan().toString())
    assert sorted(map(tuple, got.collect())) == want


def test_long_matrices_are_fitted_by_more_tasks(spark, monkeypatch):
    """Lines, profiles, pairs and the column cut have tasks by their rows, not a fixed number; W meets no further shuffle."""
    urm = materialize(spark.createDataFrame([(u, i, 1.0 + (u * i) % 3) for u in range(30) for i in range(u % 5 + 8)],
                                            "session_id LONG, item_id LONG, score DOUBLE"))
    rows = lambda df: sorted((r.item_i, r.item_j, round(r.sim, 12)) for r in df.collect())
    want, by_item = rows(WK.rp3_fit(urm, topK=4)), shuffled_by(WK.rp3_fit(urm, topK=4)).count(("item_i",))
    monkeypatch.setattr(WK, "URM_ROWS", 10)
    tasks = -(-urm.count() // 10)
    assert rows(WK.rp3_fit(urm, topK=4)) == want
    W = WK.rp3_fit(urm, topK=4)
    plan = W._jdf.queryExecution().executedPlan().toString()
    for key in ("session_id", "item_i", "item_j"):
        assert re.search(rf"Exchange hashpartitioning\({key}#\d+L, {tasks}\)", plan), key
    assert shuffled_by(W).count(("item_i",)) == by_item
    monkeypatch.setattr(roles, "LINE_ROWS", 100)
    lines = Ctx(spark, "/root/testdata/sf0.001").r
    n = -(-lines.t.lineitem.count() // 100)
    assert re.search(rf"Exchange hashpartitioning\(session_id#\d+L, {n}\)", lines.train_lines()._jdf.queryExecution().executedPlan().toString())


def test_ranked_output_numbers_items_before_the_fit(spark, monkeypatch):
    """The model isn't stored and mapped entry by entry."""
    kept = []

    def spy(df, *by):
        kept.append(set(df.columns))
        return materialize(df, *by)
    monkeypatch.setattr(session, "materialize", spy)
    monkeypatch.setattr(P, "materialize", spy)
    ctx = Ctx(spark, "/root/testdata/sf0.001")
    got = sorted(map(tuple, QR.rec_ranked_output(ctx).collect()))
    assert kept and not any("sim" in c for c in kept)
    assert got == sorted((r.session_id, r.item_id, r["rank"]) for r in P.recommend(ctx, P.test_profile(ctx), P.fit_w(ctx), 10).collect())


def test_candidates_are_scored_in_the_shuffle_of_the_scores(spark):
    """Candidates, seen items and scores of a session meet in one shuffle, not in one of all scores by session and item."""
    urm = spark.createDataFrame([(u, i, 1.0 + (u * i) % 3) for u in range(30) for i in range(u % 5 + 8)],
                                "session_id LONG, item_id LONG, score DOUBLE")
    W = materialize(WK.rp3_fit(urm, topK=4))
    profile = materialize(urm.filter("session_id % 3 = 0"))
    cand = spark.createDataFrame([(u, i) for u in range(0, 33, 3) for i in (3, 9, 11, 11, 99)], "session_id LONG, item_id LONG")
    got = RK.rec_scores(profile, W, remove_seen=True, candidates=cand)
    keys = shuffled_by(got)
    assert keys.count(("session_id",)) == 1 and not any(len(k) > 1 for k in keys), keys
    seen = {(r.session_id, r.item_id) for r in profile.collect()}
    scores = {(r.session_id, r.item_id): r.score for r in RK.rec_scores(profile, W).collect()}
    want = {k: scores.get(k, 0.0) for k in {tuple(r) for r in cand.collect()} - seen}
    assert sorted((r.session_id, r.item_id, round(r.score, 9)) for r in got.collect()) == sorted((*k, round(v, 9)) for k, v in want.items())


def test_models_without_blocked_columns_and_freed_shuffles(spark, monkeypatch):
    """Several models are functions of what is blocked, and a model's shuffle files go before the next one's come."""
    urm = materialize(spark.createDataFrame([(u, i, 1.0 + (u * i) % 3) for u in range(30) for i in range(u % 5 + 8)],
                                            "session_id LONG, item_id LONG, score DOUBLE"))
    seen, freed = [], []
    monkeypatch.setattr(RK, "free_shuffles", lambda s: freed.append(len(seen)))
    fits = {k: (lambda b, k=k: seen.append(sorted(r.item_id for r in b.collect())) or WK.rp3_fit(urm, topK=k, without=b)) for k in (4, 2)}
    catalogue, blocked = spark.range(14).withColumnRenamed("id", "item_id"), spark.range(3).withColumnRenamed("id", "item_id")
    got = RK.rec_ranking_frame({str(k): f for k, f in fits.items()}, urm, catalogue, 5, exclude=blocked)
    assert seen == [[0, 1, 2]] * 2 and freed == [1, 2]
    want = RK.rec_ranking_frame({str(k): WK.rp3_fit(urm, topK=k) for k in (4, 2)}, urm, catalogue, 5, exclude=blocked)
    rows = lambda df: sorted((r.model, r.session_id, r["rank"], r.item_id, round(r.score, 9)) for r in df.collect())
    assert rows(got) == rows(want)


def test_stored_model_rows_are_not_shuffled_to_be_put_together(spark):
    urm = materialize(spark.createDataFrame([(u, i, 1.0 + (u * i) % 3) for u in range(30) for i in range(u % 5 + 8)],
                                            "session_id LONG, item_id LONG, score DOUBLE"))
    W = materialize(WK.rp3_fit(urm, topK=4))
    rows = materialize(RK.model_rows(W))
    got = RK.rec_scores(urm, rows, remove_seen=True)
    scores = lambda df: sorted((r.session_id, r.item_id, round(r.score, 9)) for r in df.collect())
    assert scores(got) == scores(RK.rec_scores(urm, W, remove_seen=True))
    assert "collect_list" not in got._jdf.queryExecution().executedPlan().toString()
