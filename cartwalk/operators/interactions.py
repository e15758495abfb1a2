"""Session and interaction preparation (merging, weighting, de-duplication,
id mapping, exclusion lists, the long-form interaction matrix)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartwalk.functions.exprs import rank_key
from cartwalk.operators.ids import dense_index, with_scalar

# Default implicit weights of the inference path.
DEFAULT_VIEW_WEIGHT = 1.0
FALLBACK_VIEW_WEIGHT = 0.2
DEFAULT_PURCHASE_WEIGHT = 1.0


def merge_interactions(views: DataFrame, purchases: DataFrame) -> DataFrame:
    """Views and purchases in one table with an ``is_purchase`` flag.

    The reference sorts the concatenation by (session, date); order is not a
    property of a distributed table, so consumers rank explicitly instead.
    """
    cols = ["session_id", "item_id", "date"]
    return views.select(*cols, F.lit(False).alias("is_purchase")).unionByName(
        purchases.select(*cols, F.lit(True).alias("is_purchase")))


def interaction_score(df: DataFrame, view_weight: float | None = DEFAULT_VIEW_WEIGHT,
                      purchase_weight: float | None = DEFAULT_PURCHASE_WEIGHT) -> DataFrame:
    """Implicit score by interaction type (view weight falls back to 0.2
    when the model carries none, purchases to 1)."""
    vw = FALLBACK_VIEW_WEIGHT if view_weight is None else view_weight
    pw = DEFAULT_PURCHASE_WEIGHT if purchase_weight is None else purchase_weight
    flag = F.col("is_purchase") if "is_purchase" in df.columns else F.lit(False)
    return df.withColumn("score", F.when(flag, F.lit(float(pw))).otherwise(F.lit(float(vw))))


def dedup_last(df: DataFrame) -> DataFrame:
    """S3: one row per (session, item), the latest; purchases win date ties.

    ``max_by`` over a struct key is a partial aggregate, so a session with a
    huge number of rows is combined map-side instead of sorted in one task.
    """
    flag = F.col("is_purchase") if "is_purchase" in df.columns else F.lit(False)
    payload_cols = [c for c in df.columns if c not in ("session_id", "item_id")]
    key = F.struct(F.col("date"), flag.cast("int"), *(
        [F.col("score")] if "score" in df.columns else []))
    agg = df.groupBy("session_id", "item_id").agg(
        F.max_by(F.struct(*payload_cols), key).alias("_last"))
    return agg.select("session_id", "item_id", "_last.*")


def dense_mapping(values: DataFrame, col: str, out_col: str = "idx") -> DataFrame:
    """Sorted distinct values numbered 0..n-1 (the inverse is the same
    table read the other way)."""
    d = values.select(col).distinct()
    return dense_index(d, [col], out_col, start=0)


def candidate_set(test_df: DataFrame) -> DataFrame:
    """Distinct items of a table."""
    return test_df.select("item_id").distinct()


def items_to_exclude(featured: DataFrame, candidates: DataFrame) -> DataFrame:
    """Featured items that are not candidates (anti-join; the candidate
    side is broadcast by AQE when its measured size allows)."""
    return featured.select("item_id").distinct().join(
        candidates.select("item_id"), "item_id", "left_anti")


def sessions_to_rec(test_df: DataFrame) -> DataFrame:
    """Distinct test sessions with their dense index."""
    return dense_mapping(test_df, "session_id", "session_idx")


def urm_build(df: DataFrame, score_col: str = "score") -> DataFrame:
    """S8 + R1: long-form interaction matrix, duplicates added, zeros dropped."""
    return (
        df.groupBy("session_id", "item_id")
        .agg(F.sum(F.col(score_col).cast("double")).alias("score"))
        .filter(F.col("score") != 0)
    )


def prepare_profile(interactions: DataFrame, view_weight: float | None = DEFAULT_VIEW_WEIGHT,
                    purchase_weight: float | None = DEFAULT_PURCHASE_WEIGHT,
                    unique_interactions: bool = True) -> DataFrame:
    """S2 + S3 + S8: raw interactions to a (session, item, score) profile."""
    scored = interaction_score(interactions, view_weight, purchase_weight)
    if unique_interactions:
        scored = dedup_last(scored)
    return urm_build(scored)


def item_hot_flag(train: DataFrame, items: DataFrame) -> DataFrame:
    """For each listed item, ``is_hot`` (occurs in train) and
    ``is_cold`` (the reference's name, which is inverted, as its negation)."""
    seen = train.select("item_id").distinct().withColumn("_hit", F.lit(True))
    return (
        items.select("item_id").join(seen, "item_id", "left")
        .select("item_id", F.coalesce("_hit", F.lit(False)).alias("is_hot"))
        .withColumn("is_cold", ~F.col("is_hot"))
    )


def cold_sessions(train: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per session, cold when no viewed item occurs in train."""
    hot = train.select("item_id").distinct().withColumn("_hot", F.lit(True))
    return (
        sessions.select("session_id", "item_id").join(hot, "item_id", "left")
        .groupBy("session_id")
        .agg(F.bool_and(F.col("_hot").isNull()).alias("is_cold"))
    )


def one_view_sessions(train: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions with at most one interaction that are not cold."""
    counts = sessions.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    cold = cold_sessions(train, sessions).filter("is_cold")
    return counts.filter(F.col("n") <= 1).join(cold, "session_id", "left_anti").select("session_id")


def minmax_group(df: DataFrame, group_col: str = "session_id") -> DataFrame:
    """Per-group min-max scaling of every ``*_score`` column except
    TopPop ones; a zero range gives null.  Min and max are partial
    aggregates joined back, so a huge group is not sorted in one task."""
    cols = [c for c in df.columns if "_score" in c and "TopPop" not in c]
    if not cols:
        return df
    stats = df.groupBy(group_col).agg(
        *[F.min(c).alias(f"_min_{c}") for c in cols],
        *[F.max(c).alias(f"_max_{c}") for c in cols],
    )
    out = df.join(stats, group_col)
    for c in cols:
        rng = F.col(f"_max_{c}") - F.col(f"_min_{c}")
        out = out.withColumn(c, (F.col(c) - F.col(f"_min_{c}")) / F.when(rng != 0, rng))
    return out.drop(*[f"_min_{c}" for c in cols], *[f"_max_{c}" for c in cols])


def icm_filter(icm: DataFrame, mapping: DataFrame, key: str = "item_id",
               idx_col: str = "idx") -> DataFrame:
    """Keep rows of known items and swap the id for the mapped index."""
    return icm.join(mapping, key).drop(key).withColumnRenamed(idx_col, key)


def rank_explode(lists: DataFrame, list_col: str = "items") -> DataFrame:
    """Flatten per-session lists to (session, pos, item)."""
    return lists.select("session_id", F.posexplode(list_col).alias("pos", "item_id")).withColumn(
        "pos", (F.col("pos") + 1).cast("long"))


def remove_top_pop(urm: DataFrame, pct: float = 0.2, urm2: DataFrame | None = None,
                   n_items: DataFrame | None = None):
    """Drop the given share of items with the largest summed score.

    Returns (filtered urm, kept items, removed items).  The share is taken of
    the item universe (all items of ``n_items`` when given, else of the urm).
    """
    sums = urm.select("item_id", "score")
    if urm2 is not None:
        sums = sums.unionByName(urm2.select("item_id", "score"))
    pop = sums.groupBy("item_id").agg(F.sum("score").alias("pop"))
    universe = (n_items.select("item_id").distinct() if n_items is not None
                else urm.select("item_id").distinct())
    pop = universe.join(pop, "item_id", "left").fillna(0.0, ["pop"])
    ranked = dense_index(pop.withColumn("_neg", -rank_key("pop")), ["_neg", "item_id"], "_r", start=1)
    removed = with_scalar(ranked, universe.agg(F.count(F.lit(1)).alias("n"))).filter(
        F.col("_r") <= F.floor(F.col("n") * F.lit(pct))).select("item_id")
    kept = universe.join(removed, "item_id", "left_anti")
    return urm.join(removed, "item_id", "left_anti"), kept, removed


def remove_items(urm: DataFrame, items: DataFrame) -> DataFrame:
    """Drop all interactions of the listed items."""
    return urm.join(items.select("item_id").distinct(), "item_id", "left_anti")


def urm_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, ``equal`` when no coordinate differs (full outer join)."""
    j = a.select("session_id", "item_id", F.col("score").alias("a")).join(
        b.select("session_id", "item_id", F.col("score").alias("b")),
        ["session_id", "item_id"], "full_outer")
    diff = F.coalesce(F.col("a"), F.lit(0.0)) != F.coalesce(F.col("b"), F.lit(0.0))
    return j.agg(F.sum(diff.cast("long")).alias("n_diff")).select(
        F.coalesce("n_diff", F.lit(0)).cast("long").alias("n_diff"),
        (F.coalesce("n_diff", F.lit(0)) == 0).alias("equal"))


def session_accumulate(session: DataFrame, candidates: DataFrame) -> DataFrame:
    """Add to each session only its best-ranked candidate that is not
    already in the session.  ``session`` (session_id, item_id, ...),
    ``candidates`` (session_id, item_id, rank[, date]).  Returns the new
    session rows (session_id, item_id, rank) - at most one per session."""
    from pyspark.sql import Window as _W
    fresh = candidates.join(session.select("session_id", "item_id"), ["session_id", "item_id"], "left_anti")
    w = _W.partitionBy("session_id").orderBy("rank", "item_id")
    return fresh.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def session_fallback(queries: DataFrame, added: DataFrame, message: str) -> DataFrame:
    """Per query session, the added item or the fallback message when
    nothing new could be added."""
    return queries.select("session_id").distinct().join(
        added.select("session_id", F.col("item_id").alias("added_item")), "session_id", "left"
    ).select("session_id", "added_item",
             F.when(F.col("added_item").isNull(), F.lit(message)).alias("answer"))


def session_walk(candidates: DataFrame, idle_turns: int | None = None) -> DataFrame:
    """S9 for whole conversations: turn by turn, each session takes the best
    candidate of the turn that it does not hold yet.  ``candidates``
    (session_id, turn, item_id, rank) -> session_id, turn, added_item (null when
    every candidate is held), session_size.  With ``idle_turns``, a turn more than
    that many after the last one finds the session empty.  Turns depend on the ones before, so a
    session is walked in one place: its rows are shuffled there and sorted, and a task goes through them once,
    holding the items of one session."""
    import pyarrow as pa
    names = ["session_id", "turn", "added_item", "session_size"]

    def walk(batches):
        held: set = set()
        at = added = None
        rows: list[tuple] = []

        def ready() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(col, pa.int64()) for col in (zip(*rows) if rows else [()] * 4)], names=names)
        for b in batches:
            for session, turn, item in zip(*(b.column(k).to_pylist() for k in range(3))):
                if (session, turn) != at:
                    if at is not None:
                        rows.append((*at, added, len(held)))
                        if session != at[0] or idle_turns is not None and turn - at[1] > idle_turns:
                            held.clear()
                    at, added = (session, turn), None
                if added is None and item not in held:
                    held.add(item)
                    added = item
            yield ready()
            rows.clear()
        if at is not None:
            rows.append((*at, added, len(held)))
        yield ready()

    by = [F.col(c).cast("long") for c in ("session_id", "turn")]
    return (candidates.select(*by, F.col("item_id").cast("long"), "rank").filter("session_id IS NOT NULL AND turn IS NOT NULL").repartition("session_id")
            .sortWithinPartitions("session_id", "turn", "rank", "item_id").select("session_id", "turn", "item_id")
            .mapInArrow(walk, "session_id long, turn long, added_item long, session_size long"))
