"""Popularity-penalised three-step random walk (item-to-item model).

With r(u,i) the interaction score and pop(i) the number of stored
interactions of item i:

    Pui(u,j) = (r(u,j) / sum_j |r(u,j)|) ^ alpha
    Piu(i,u) = (1 / pop(i)) ^ alpha
    S(i,j)   = sum_u Piu(i,u) * Pui(u,j) * pop(j) ^ -beta,   S(i,i) = 0

then the ``topK`` largest of each row, optional L1 row normalisation, then the
``topK`` largest of each column.  The output W is a long table
``(item_i, item_j, sim)``.

Plan: the interactions get their item's popularity by a join and meet by
session, where the pairs of a profile are made from its array; the pairs are
shuffled once, by item_i, which serves the sum over users, the row cut and
the normalisation.  A user with a very long profile contributes |profile|^2
pairs; such profiles are cut into slices whose pairs are made by many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwalk.functions.exprs import rank_key
from cartwalk.operators.ids import join_small
from cartwalk.session import tasks_for

# Model defaults.
DEFAULT_ALPHA = 1.0
DEFAULT_BETA = 0.6
DEFAULT_TOPK = 100

# Profiles longer than this are split over several tasks in the self-join.
SALT_PROFILE_ROWS = 2000

# Interactions of a stored matrix whose pairs one task adds up.
URM_ROWS = 500_000


def rp3_min_rating(urm: DataFrame, min_rating: float = 0, implicit: bool = False) -> DataFrame:
    """Drop ratings below ``min_rating``; ``implicit`` sets the rest to 1.
    As in the reference, both act only when ``min_rating > 0``."""
    if min_rating and min_rating > 0:
        urm = urm.filter(F.col("score") >= F.lit(float(min_rating)))
        if implicit:
            urm = urm.withColumn("score", F.lit(1.0))
    return urm


def user_stats(urm: DataFrame) -> DataFrame:
    return urm.groupBy("session_id").agg(
        F.sum(F.abs("score")).alias("l1"), F.count(F.lit(1)).alias("profile_len"))


def item_stats(urm: DataFrame) -> DataFrame:
    return urm.groupBy("item_id").agg(F.count(F.lit(1)).alias("pop"))


def rp3_pui(urm: DataFrame, alpha: float = DEFAULT_ALPHA, stats: DataFrame | None = None) -> DataFrame:
    """Row-wise L1 normalisation, to the power alpha."""
    stats = stats if stats is not None else user_stats(urm)
    p = urm.join(stats.select("session_id", "l1"), "session_id").withColumn(
        "pui", F.col("score") / F.col("l1"))
    if alpha != 1.0:
        p = p.withColumn("pui", F.pow("pui", F.lit(float(alpha))))
    return p.select("session_id", "item_id", "pui")


def rp3_piu(urm: DataFrame, alpha: float = DEFAULT_ALPHA, stats: DataFrame | None = None) -> DataFrame:
    """1/popularity of the item per stored interaction, to the power alpha."""
    stats = stats if stats is not None else item_stats(urm)
    p = urm.select("session_id", "item_id").join(stats, "item_id").withColumn(
        "piu", F.lit(1.0) / F.col("pop"))
    if alpha != 1.0:
        p = p.withColumn("piu", F.pow("piu", F.lit(float(alpha))))
    return p.select("session_id", "item_id", "piu")


def rp3_degree(urm: DataFrame, beta: float = DEFAULT_BETA, stats: DataFrame | None = None) -> DataFrame:
    """pop(j)^-beta for items with interactions (others never appear)."""
    stats = stats if stats is not None else item_stats(urm)
    return stats.select("item_id", F.pow(F.col("pop").cast("double"), F.lit(-float(beta))).alias("degree"))


def rp3_similarity(urm: DataFrame, alpha: float = DEFAULT_ALPHA, beta: float = DEFAULT_BETA,
                   salt_rows: int = SALT_PROFILE_ROWS) -> DataFrame:
    """S(i, j) as a long table (item_i, item_j, sim), diagonal removed."""
    by = tasks_for(urm, URM_ROWS)
    pair = F.sum("pui") * F.pow(F.col("pop_i").cast("double"), F.lit(-float(alpha))) * F.pow(
        F.col("pop_j").cast("double"), F.lit(-float(beta)))
    return (_profile_pairs(urm, alpha, salt_rows).repartition(*by, "item_i")
            .groupBy("item_i", "pop_i", "item_j", "pop_j").agg(pair.alias("sim")).select("item_i", "item_j", "sim"))


def _profile_pairs(urm: DataFrame, alpha: float, salt_rows: int) -> DataFrame:
    """(item_i, pop_i, item_j, pop_j, pui) for every pair of different items of a profile.

    The interactions are shuffled by item (popularity) and by session; a profile is
    then one array, and its pairs are made where it lies.  Profiles longer than ``salt_rows``
    are cut into slices, and the pairs of slices are dealt out over the tasks."""
    by = tasks_for(urm, URM_ROWS)
    # A cast of a double would leave the two branches below with different plans, and shuffled twice.
    score = F.col("score") if urm.schema["score"].dataType == T.DoubleType() else F.col("score").cast("double").alias("score")
    urm = urm.select("session_id", "item_id", score)
    profiles = (urm.join(item_stats(urm), "item_id").repartition(*by, "session_id").groupBy("session_id")
                .agg(F.collect_list(F.struct("item_id", "pop", "score")).alias("_a"), F.sum(F.abs("score")).alias("l1")))
    short = profiles.filter(F.size("_a") <= salt_rows).select("l1", "_a", F.col("_a").alias("_b"))
    slices = F.expr(f"transform(sequence(0, (size(_a) - 1) div {int(salt_rows)}), k -> slice(_a, int(k) * {int(salt_rows)} + 1, {int(salt_rows)}))")
    long = (profiles.filter(F.size("_a") > salt_rows).select("session_id", "l1", "_a", F.posexplode(slices).alias("_k", "_b"))
            .select("session_id", "l1", "_b", "_k", F.posexplode(slices).alias("_m", "_x"))
            .repartition("session_id", "_k", "_m").select("l1", F.col("_x").alias("_a"), "_b"))
    pui = F.col("j.score") / F.col("l1")
    return (short.unionByName(long).select("l1", F.explode("_a").alias("i"), "_b").select("l1", "i", F.explode("_b").alias("j"))
            .filter(F.col("i.item_id") != F.col("j.item_id"))
            .select(F.col("i.item_id").alias("item_i"), F.col("i.pop").alias("pop_i"), F.col("j.item_id").alias("item_j"),
                    F.col("j.pop").alias("pop_j"), (F.pow(pui, F.lit(float(alpha))) if alpha != 1.0 else pui).alias("pui")))


def topk_by(df: DataFrame, part_col: str, other_col: str, k: int | None,
            value_col: str = "sim") -> DataFrame:
    """Keep the ``k`` largest non-zero values per ``part_col`` (ties: smaller
    ``other_col`` first).  ``row_number() <= k`` is planned with a window
    group limit, so each task keeps only k rows per key before the sort."""
    df = df.filter(F.col(value_col) != 0)
    if k is None:
        return df
    w = Window.partitionBy(part_col).orderBy(rank_key(value_col).desc(), F.col(other_col).asc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def rp3_topk_row(sim: DataFrame, k: int | None = DEFAULT_TOPK) -> DataFrame:
    """K largest per source item, zeros dropped."""
    return topk_by(sim, "item_i", "item_j", k)


def rp3_normalized(sim: DataFrame) -> DataFrame:
    """L1 normalisation of each row.  After the row cut a row holds at
    most topK entries and the data is already partitioned by ``item_i``, so
    a window sum adds no shuffle and no group can be large."""
    w = Window.partitionBy("item_i")
    return sim.select("item_i", "item_j", (F.col("sim") / F.sum(F.abs("sim")).over(w)).alias("sim"))


# Ids of left out columns (one long each) up to which their list is broadcast.
BLOCKED_ROWS = 1_000_000


def rp3_topk_col(sim: DataFrame, k: int | None = DEFAULT_TOPK, without: DataFrame | None = None,
                 tasks: list[int] | None = None) -> DataFrame:
    """K largest non-zero per target item.  What a column's cut takes away
    goes back to its row, so the entries kept stay where their row is and are not
    shuffled again by a reader that joins on ``item_i``.

    ``without`` (item_id; stored, distinct) names columns that the reader blocks.  No other column
    depends on them, so up to ``BLOCKED_ROWS`` they leave before the cut; beyond, they go
    back to the rows with what is cut, from where the columns lie for it.  ``tasks``: see :func:`tasks_for`."""
    sim = sim.filter(F.col("sim") != 0)
    cut, taken = sim, []
    if without is not None:
        out = without.select(F.col("item_id").alias("item_j"))
        if out.count() <= BLOCKED_ROWS:
            cut = sim = join_small(sim, out, "item_j", "left_anti", BLOCKED_ROWS)
        else:
            cut = sim.join(out.withColumn("_out", F.lit(True)).hint("merge"), "item_j", "left")
            taken.append(F.col("_out").isNotNull())
    if k is not None:
        w = Window.partitionBy("item_j").orderBy(rank_key("sim").desc(), F.col("item_i").asc())
        cut = (cut.repartition(*tasks, "item_j") if tasks else cut).withColumn("_rn", F.row_number().over(w))
        taken.append(F.col("_rn") > k)
    if not taken:
        return sim
    lost = cut.filter(reduce(lambda a, b: a | b, taken)).select("item_i", "item_j")
    lost = (lost.repartition(*tasks, "item_i") if tasks else lost).groupBy("item_i").agg(F.collect_list("item_j").alias("_lost"))
    return (sim.join(lost, "item_i", "left")
            .filter(F.col("_lost").isNull() | ~F.array_contains("_lost", F.col("item_j"))).drop("_lost"))


def rp3_fit(urm: DataFrame, alpha: float = DEFAULT_ALPHA, beta: float = DEFAULT_BETA,
            min_rating: float = 0, topK: int | None = DEFAULT_TOPK, implicit: bool = False,
            normalize_similarity: bool = True, without: DataFrame | None = None) -> DataFrame:
    """W = column-top-k(normalise(row-top-k(S))).  ``topK=None`` means
    no cut anywhere; ``without`` see R10."""
    urm = rp3_min_rating(urm, min_rating, implicit)
    w = rp3_topk_row(rp3_similarity(urm, alpha, beta), topK)
    if normalize_similarity:
        w = rp3_normalized(w)
    return rp3_topk_col(w, topK, without, tasks_for(urm, URM_ROWS))
