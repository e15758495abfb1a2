"""Scoring and top-k recommendation from an item-item table W.

``score(u, j) = sum_i r(u, i) * W(i, j)`` is a join of the profile to W on
the item followed by a partial aggregation on (user, j).  Exclusions (seen,
global list, popular list, items outside ``items_to_compute``) are
anti-joins.  The list is the ``cutoff`` best by (score desc, item asc);
non-excluded items of score zero fill short lists in ascending id order.

Zero fill never crosses users with items: for a user that needs ``m`` more
items and has ``b`` blocked items in the filler order, the first ``m`` free
fillers lie among positions ``1..m+b`` of that order, so the job explodes
exactly those positions, joins them to the numbered filler table on the
position (an equi-join) and removes the blocked ones.  Work is linear in
profile size plus cutoff.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartwalk.functions.exprs import rank_key
from cartwalk.operators.ids import dense_index, join_small, with_scalar
from cartwalk.operators.walk import BLOCKED_ROWS
from cartwalk.session import free_shuffles, materialize, tasks_for


# Rows of a stored profile that one task scores (each brings a row of W).
PROFILE_ROWS = 20_000


def model_rows(W: DataFrame) -> DataFrame:
    """W's rows as two arrays, (item_i, _j array, _s array); stored, they spare each scoring a shuffle of W by item."""
    return (W.groupBy("item_i").agg(F.collect_list(F.struct("item_j", "sim")).alias("_w"))
            .select("item_i", F.col("_w.item_j").alias("_j"), F.col("_w.sim").alias("_s")))


def rec_scores(profile: DataFrame, W: DataFrame, items_to_compute: DataFrame | None = None,
               remove_seen: bool = False, candidates: DataFrame | None = None) -> DataFrame:
    """(session_id, item_id, score) for every item reachable through W;
    ``remove_seen`` (R13) leaves out the profile's own items.  With ``candidates`` (session_id, item_id; may
    repeat) these instead, each once, zero where W doesn't reach.

    W's rows travel as two arrays, items and values, once by their item and once to the sessions that
    have it.  A session's scores, its own items (an entry without a value), its candidates and a later cut by session meet in
    that one shuffle.  ``W`` may be those of :func:`model_rows` already, without ``items_to_compute``."""
    if "_j" in W.columns:
        rows = W
    else:
        W = W.select("item_i", "item_j", "sim")
        if items_to_compute is not None:
            W = W.join(items_to_compute.select(F.col("item_id").alias("item_j")).distinct(), "item_j", "left_semi")
        rows = model_rows(W)
    mine = profile.select("session_id", F.col("item_id").alias("item_i"), F.col("score").alias("_r"))
    # A task adds up all scores of its sessions, so there are more tasks where the profile is long.
    by = [*tasks_for(profile, PROFILE_ROWS), "session_id"]
    if remove_seen:
        met = mine.join(rows, "item_i", "left")
        met = met if candidates is not None else met.repartition(*by)
        met = met.withColumn("_j", F.concat(F.coalesce("_j", F.array().cast("array<bigint>")), F.array("item_i"))).withColumn(
            "_s", F.concat(F.coalesce("_s", F.array().cast("array<double>")), F.array(F.lit(None).cast("double"))))
    else:
        met = mine.join(rows, "item_i").select("session_id", "_r", "_j", "_s")
        met = met if candidates is not None else met.repartition(*by)
    if candidates is not None:
        asked = candidates.select("session_id", F.lit(None).cast("double").alias("_r"), F.array("item_id").alias("_j"), F.array(F.lit(0.0)).alias("_s"))
        met = met.select("session_id", F.col("_r").cast("double").alias("_r"), "_j", "_s").withColumn("_c", F.lit(False)).unionByName(
            asked.withColumn("_c", F.lit(True))).repartition(*by)
        return (met.select("session_id", "_r", "_c", F.explode(F.arrays_zip("_j", "_s")).alias("e"))
                .groupBy("session_id", F.col("e._j").alias("item_id"))
                .agg(F.coalesce(F.sum(F.col("_r") * F.col("e._s")), F.lit(0.0)).alias("score"), F.max("_c").alias("_c"), F.max(F.col("e._s").isNull()).alias("_own"))
                .filter(F.col("_c") & ~F.col("_own")).select("session_id", "item_id", "score"))
    s = (met.select("session_id", "_r", F.explode(F.arrays_zip("_j", "_s")).alias("e"))
         .groupBy("session_id", F.col("e._j").alias("item_id"))
         .agg(F.sum(F.col("_r") * F.col("e._s")).alias("score"), F.max(F.col("e._s").isNull()).alias("_own")))
    return s.filter(~F.col("_own")).drop("_own") if remove_seen else s.drop("_own")


def rec_remove_seen(scores: DataFrame, profile: DataFrame) -> DataFrame:
    """Drop items of the user's own profile."""
    return scores.join(profile.select("session_id", "item_id"), ["session_id", "item_id"], "left_anti")


def rec_remove_custom(scores: DataFrame, items: DataFrame | None) -> DataFrame:
    """Drop a global list of items."""
    if items is None:
        return scores
    return scores.join(items.select("item_id").distinct(), "item_id", "left_anti")


FILL_SALTS = 16


def fill_from_order(need: DataFrame, blocked: DataFrame, order: DataFrame) -> DataFrame:
    """First free items of a global order per user.

    need:    (session_id, need)       how many more items each user takes
    blocked: (session_id, item_id)    items the user may not get
    order:   (item_id, pos)           global order, pos = 1..n
    returns: (session_id, item_id, fill_rank) with fill_rank = 1..need
    """
    blk = blocked.join(order, "item_id").select("session_id", "item_id", "pos")
    nblk = blk.groupBy("session_id").agg(F.count(F.lit(1)).alias("_b"))
    upto = need.filter(F.col("need") > 0).join(nblk, "session_id", "left").select(
        "session_id", "need", (F.col("need") + F.coalesce(F.col("_b"), F.lit(0))).cast("long").alias("_upto"))
    # The first positions are wanted by every user: only the prefix somebody
    # wants takes part, each position FILL_SALTS times.
    prefix = with_scalar(order, upto.agg(F.coalesce(F.max("_upto"), F.lit(0)).alias("_most"))).filter(
        F.col("pos") <= F.col("_most")).select("item_id", "pos", F.explode(F.sequence(F.lit(0), F.lit(FILL_SALTS - 1))).alias("_salt"))
    cand = (
        upto.select("session_id", "need", F.pmod(F.xxhash64("session_id"), F.lit(FILL_SALTS)).cast("int").alias("_salt"),
                    F.explode(F.sequence(F.lit(1).cast("long"), F.col("_upto"))).alias("pos"))
        .join(prefix, ["pos", "_salt"])
        .join(blk.select("session_id", "item_id"), ["session_id", "item_id"], "left_anti")
    )
    w = Window.partitionBy("session_id").orderBy("pos")
    return (
        cand.withColumn("fill_rank", F.row_number().over(w))
        .filter(F.col("fill_rank") <= F.col("need"))
        .select("session_id", "item_id", F.col("fill_rank").cast("long"))
    )


def rec_topk(profile: DataFrame, W: DataFrame | Callable[[DataFrame | None], DataFrame], universe: DataFrame, cutoff: int = 10,
             remove_seen: bool = True, exclude: DataFrame | None = None,
             toppop: DataFrame | None = None, items_to_compute: DataFrame | None = None,
             users: DataFrame | None = None, zero_fill: bool = True) -> DataFrame:
    """(session_id, item_id, rank, score), ``rank`` 1..cutoff.

    ``cutoff`` is capped at ``n_items - 1`` like the reference; excluded items
    are never returned, so a list is shorter only when fewer eligible items
    exist.  ``W`` may be a function of the blocked items (item_id) that gives the
    model without their columns, where they can leave before W is complete.
    """
    universe = universe.select("item_id").distinct()
    all_users = users is None
    users = (profile if all_users else users).select("session_id").distinct()
    blocked_items = [x for x in (exclude, toppop) if x is not None]
    if items_to_compute is not None:
        blocked_items.append(universe.join(items_to_compute.select("item_id"), "item_id", "left_anti"))
    blocked_global = (reduce(lambda a, b: a.unionByName(b), [b.select("item_id") for b in blocked_items])
                      if blocked_items else None)

    if blocked_global is not None:
        blocked_global = materialize(blocked_global.distinct())
    if callable(W):
        W = W(blocked_global)
    elif blocked_global is not None:
        W = join_small(W, blocked_global.select(F.col("item_id").alias("item_j")), "item_j", "left_anti", BLOCKED_ROWS)
    s = rec_scores(profile if all_users else profile.join(users, "session_id", "left_semi"), W, remove_seen=remove_seen)
    w = Window.partitionBy("session_id").orderBy(rank_key("score").desc(), F.col("item_id").asc())
    pos = s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cutoff)
    n_items = universe.agg(F.count(F.lit(1)).alias("_n"))
    pos = with_scalar(pos, n_items).filter(F.col("rank") <= F.col("_n") - 1).drop("_n")
    pos = pos.select("session_id", "item_id", F.col("rank").cast("long"), "score")
    if not zero_fill:
        return pos

    # The positive lists are stored once: they are the output and the input
    # of the fill.  One scalar read decides whether any list is short; when
    # none is, the fill plan is not run at all.
    pos = materialize(pos)
    npos = pos.groupBy("session_id").agg(F.count(F.lit(1)).alias("_np"))
    need = with_scalar(users.join(npos, "session_id", "left"), n_items).select(
        "session_id",
        F.coalesce("_np", F.lit(0)).alias("_np"),
        (F.least(F.lit(cutoff), F.col("_n") - 1) - F.coalesce("_np", F.lit(0))).alias("need"),
    ).filter(F.col("need") > 0)
    if need.limit(1).count() == 0:
        return pos
    filler = universe if blocked_global is None else universe.join(blocked_global, "item_id", "left_anti")
    order = dense_index(filler, ["item_id"], "pos", start=1)
    blocked = pos.select("session_id", "item_id")
    if remove_seen:
        blocked = blocked.unionByName(profile.select("session_id", "item_id"))
    fill = fill_from_order(need.select("session_id", "need"), blocked, order)
    fill = fill.join(need.select("session_id", "_np"), "session_id").select(
        "session_id", "item_id", (F.col("_np") + F.col("fill_rank")).cast("long").alias("rank"),
        F.lit(0.0).alias("score"))
    return pos.unionByName(fill)


def rec_item_scores(profile: DataFrame, W: DataFrame, items: DataFrame) -> DataFrame:
    """Scores of a listed item set by user (long form; zeros implicit)."""
    return rec_scores(profile, W, items_to_compute=items)


def rec_length_check(ranking: DataFrame, cutoff: int) -> DataFrame:
    """The reference asserts every list has exactly ``cutoff`` items;
    here the check is an aggregate: sessions and sessions of wrong length."""
    lens = ranking.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    return lens.agg(
        F.count(F.lit(1)).alias("n_sessions"),
        F.coalesce(F.sum((F.col("n") != cutoff).cast("long")), F.lit(0)).cast("long").alias("n_wrong_length"),
    )


def rec_ranking_frame(models: dict[str, DataFrame | Callable[[DataFrame | None], DataFrame]], profile: DataFrame, universe: DataFrame,
                      cutoff: int = 100, add_item_score: bool = True,
                      exclude: DataFrame | None = None) -> DataFrame:
    """One ranking per model, tagged with the model name.  Models as in :func:`rec_topk`."""
    frames = []
    for name, W in models.items():
        r = rec_topk(profile, W, universe, cutoff=cutoff, exclude=exclude).withColumn("model", F.lit(name))
        cols = ["model", "session_id", "item_id", "rank"] + (["score"] if add_item_score else [])
        frames.append(r.select(*cols))
        # The lists are stored; what they were made from needn't lie beside the next model's.
        free_shuffles(profile.sparkSession)
    return reduce(lambda a, b: a.unionByName(b), frames)


def rec_concat(frames: list[DataFrame]) -> DataFrame:
    """Union of prediction frames; order is (session, rank) on read."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def top_popular(profile: DataFrame, train: DataFrame, universe: DataFrame, cutoff: int,
                exclude: DataFrame | None = None, users: DataFrame | None = None) -> DataFrame:
    """Popularity recommender for cold sessions: items by train interaction
    count (desc, then id), seen and excluded items removed, zero-count items
    after them by id.  Same no-cross-join fill as the zero fill."""
    pop = train.groupBy("item_id").agg(F.count(F.lit(1)).alias("pop"))
    items = universe.select("item_id").distinct()
    if exclude is not None:
        items = items.join(exclude.select("item_id"), "item_id", "left_anti")
    ranked = items.join(pop, "item_id", "left").fillna(0, ["pop"]).withColumn("_neg", -F.col("pop"))
    order = dense_index(ranked, ["_neg", "item_id"], "pos", start=1).select("item_id", "pos", "pop")
    users = (users if users is not None else profile).select("session_id").distinct()
    n_items = universe.select("item_id").distinct().agg(F.count(F.lit(1)).alias("_n"))
    need = with_scalar(users, n_items).select(
        "session_id", F.least(F.lit(cutoff), F.col("_n") - 1).alias("need"))
    fill = fill_from_order(need, profile.select("session_id", "item_id"), order.select("item_id", "pos"))
    return fill.join(order.select("item_id", "pop"), "item_id").select(
        "session_id", "item_id", F.col("fill_rank").alias("rank"),
        F.col("pop").cast("double").alias("score"))


def rec_hybrid(profile: DataFrame, W: DataFrame | Callable[[DataFrame | None], DataFrame], train: DataFrame, universe: DataFrame,
               cold_flags: DataFrame, cutoff: int = 100, exclude: DataFrame | None = None) -> DataFrame:
    """Cold sessions by popularity, the others by W, then R22."""
    cold = cold_flags.filter("is_cold").select("session_id")
    warm = cold_flags.filter(~F.col("is_cold")).select("session_id")
    a = rec_topk(profile, W, universe, cutoff=cutoff, exclude=exclude, users=warm).withColumn(
        "model", F.lit("rp3beta"))
    free_shuffles(profile.sparkSession)  # the lists are stored
    b = top_popular(profile, train, universe, cutoff, exclude=exclude, users=cold).withColumn(
        "model", F.lit("top_pop"))
    return rec_concat([a, b])
