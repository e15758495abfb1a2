"""One literal for each seeker, no literal twice.

``prefs`` holds (seeker, literal, rank, claim): a seeker wants its literals by
ascending ``rank``, a literal prefers the seeker of the larger ``claim``, then the
smaller seeker.  Deferred acceptance in parallel rounds gives the matching that is best
for the seekers among all stable ones.  When ``claim`` is the seeker's place in a fixed order, that
matching is what walking the seekers one by one gives, each taking its
first literal not used before (the reference's loop); when claims are the
candidates' probabilities, it is the only stable matching.

A round is three hash joins and two partial aggregates over the stored candidates; a literal that
everybody wants is combined map-side.  The driver reads one number a round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwalk.session import drop_stored, materialize


def preferences(cands: DataFrame, seeker: str, order: str = "probability", walk: str = "best", n: int | None = None) -> DataFrame:
    """Preference table of candidates (``seeker``, literal, prob, rank from 1 for the likeliest).

    ``order``: "probability" (a literal goes to whom it is likeliest for) or
    "listed" (seekers come in ascending order).  ``walk``: "best" takes candidates from
    the likeliest on, "reference" the ``n`` likeliest from the least likely on.  ``n``
    keeps the ``n`` likeliest."""
    if order not in ("probability", "listed") or walk not in ("best", "reference"):
        raise ValueError(f"order {order!r}, walk {walk!r}")
    top = cands if n is None else cands.filter(F.col("rank") <= n)
    claim = F.col("prob") if order == "probability" else -F.col(seeker)
    rank = F.col("rank") if walk == "best" else -F.col("rank")
    return top.select(F.col(seeker).cast("long").alias("seeker"), "literal", rank.cast("long").alias("rank"),
                      claim.cast("double").alias("claim"))


def _claim() -> Column:
    return F.struct(F.col("claim").alias("claim"), (-F.col("seeker")).alias("minus"))


def deferred_acceptance(prefs: DataFrame, used: DataFrame | None = None) -> tuple[DataFrame, int]:
    """(matches, rounds): matches (seeker, literal, rank, claim), one row per matched
    seeker.  Literals of ``used`` (literal) are not given away; rows with a null seeker or literal
    don't count.  Each round every free seeker asks for the first literal it would be given now; the
    literal keeps the better claim.  A holder only ever gets better, so a literal that refuses a
    seeker once always would, and skipping it asks nothing twice.  At most one round for each row of
    ``prefs``; one for each seeker where all want the same."""
    spark = prefs.sparkSession
    p = prefs.filter("seeker IS NOT NULL AND literal IS NOT NULL")
    if used is not None:
        p = p.join(used.select("literal"), "literal", "left_anti")
    # a repeated (seeker, literal) counts once, by its first rank
    p = materialize(p.groupBy("seeker", "literal").agg(F.min_by(F.struct("rank", "claim"), F.struct("rank", -F.col("claim"))).alias("_w"))
                    .select("seeker", "literal", "_w.*").withColumn("_c", _claim()))
    held = spark.createDataFrame([], "literal STRING, seeker LONG, rank LONG, claim DOUBLE, _since INT")
    rounds = 0
    while True:
        now = held.select("literal", "seeker", _claim().alias("_held"))
        ask = (p.join(now.select("seeker"), "seeker", "left_anti")
               .join(now.select("literal", "_held"), "literal", "left")
               .filter(F.col("_held").isNull() | (F.col("_c") > F.col("_held")))
               .groupBy("seeker").agg(F.min_by(F.struct("literal", "rank", "claim"), F.struct("rank", "literal")).alias("_a"))
               .select("_a.literal", "seeker", "_a.rank", "_a.claim", F.lit(rounds + 1).alias("_since")))
        row = F.struct("seeker", "rank", "claim", "_since")
        best = materialize(held.unionByName(ask).groupBy("literal").agg(F.max_by(row, _claim()).alias("_h")).select("literal", "_h.*"))
        asked = best.filter(F.col("_since") == rounds + 1).limit(1).count()
        if rounds:
            drop_stored(held)
        held = best
        if not asked:
            return held.select("seeker", "literal", "rank", "claim"), rounds
        rounds += 1


def blocking_pairs(prefs: DataFrame, matches: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """Pairs (seeker, literal) that would rather have each other than what
    ``matches`` gives them; none for a stable matching."""
    p = prefs if used is None else prefs.join(used.select("literal"), "literal", "left_anti")
    mine = matches.select("seeker", F.col("rank").alias("_mine"), F.col("literal").alias("_own"))
    theirs = matches.select("literal", _claim().alias("_held"))
    return (p.withColumn("_c", _claim()).join(mine, "seeker", "left").join(theirs, "literal", "left")
            .filter((F.col("_own").isNull() | ((F.col("rank") < F.col("_mine")) & (F.col("literal") != F.col("_own"))))
                    & (F.col("_held").isNull() | (F.col("_c") > F.col("_held"))))
            .select("seeker", "literal").distinct())


def shared_item_candidates(features: DataFrame, literals: DataFrame, n: int = 5) -> DataFrame:
    """Candidates of every value id: prob is the share of its items that also carry
    the literal; the ``n`` best (feature_value_id, literal, prob, rank), ties by literal.

    ``features`` (item_id, feature_value_id), ``literals`` (item_id, literal)."""
    f = features.select("item_id", "feature_value_id").distinct()
    total = f.groupBy("feature_value_id").agg(F.count(F.lit(1)).alias("_n"))
    both = (f.join(literals.select("item_id", "literal").filter("literal IS NOT NULL").distinct(), "item_id")
            .groupBy("feature_value_id", "literal").agg(F.count(F.lit(1)).alias("_both")))
    best_first = Window.partitionBy("feature_value_id").orderBy(F.col("prob").desc(), F.col("literal"))
    return (both.join(total, "feature_value_id").withColumn("prob", F.col("_both") / F.col("_n"))
            .withColumn("rank", F.row_number().over(best_first).cast("long")).filter(F.col("rank") <= n)
            .select("feature_value_id", "literal", "prob", "rank"))
