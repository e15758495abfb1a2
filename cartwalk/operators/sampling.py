"""Uniform samples of the pairs that a matrix does not hold.

The pairs (a, b) of N items stand in one line, a * N + b.  Pairs that are in W
and pairs of an item with itself are left out; the M others are numbered 0..M-1
without being listed: the t-th one stands at t plus the number of left-out
places whose own place, less the left-out ones before it, is at most t.  Those numbers come
from one global sort of left-out places and sampled ranks, so neither a dense
row of W nor a dense W makes a difference, and no row is one task.

Distinct ranks come from a keyed permutation of 0..M-1 (a Feistel network over
two factors of about the square root of M; what falls outside is permuted again), of
which the first n images are taken: one pass, whatever share of all pairs W holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwalk.operators.ids import dense_index

ROUNDS = 6
# Images outside 0..M-1 are permuted again.  At most sqrt(M) of the
# sqrt(M) * ceil(M / sqrt(M)) places lie outside, so a walk of this many steps ends
# for certain below M = 4,096 and fails with probability under 2^-384 above.
WALK = 64


def factors(m: int) -> tuple[int, int]:
    """a, b with a * b >= m, as close to m as a square allows."""
    from math import isqrt
    a = max(1, isqrt(m))
    return a, -(-m // a)


def _mix(seed: int, i: Column, x: Column) -> Column:
    """48 bits of the MD5 of seed, round and value."""
    text = F.concat_ws(":", F.lit(seed), i, x)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")


def permuted(x: Column, m: int, seed: int) -> Column:
    """Image of ``x`` under a permutation of 0..m-1 fixed by ``seed``."""
    a, b = factors(m)

    def once(v: Column) -> Column:
        start = F.struct((v % a).alias("l"), F.rint((v - v % a) / a).cast("long").alias("r"))
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(ROUNDS)), start,
            lambda s, i: F.when(i % 2 == 1, F.struct(((s["l"] + _mix(seed, i, s["r"])) % a).alias("l"), s["r"].alias("r")))
            .otherwise(F.struct(s["l"].alias("l"), ((s["r"] + _mix(seed, i, s["l"])) % b).alias("r"))),
            lambda s: s["r"] * a + s["l"])
    first = once(x)
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda v, _: F.when(v < m, v).otherwise(once(v)))


def absent_pairs(W: DataFrame, items: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` distinct ordered pairs (item_a, item_b) of different ``items`` that
    have no row in ``W`` (item_i, item_j), each set of n as likely as the hash allows, value 0.  Raises
    ValueError when there are fewer.  Null items, repeated rows of W and rows of W
    with unknown items count for nothing."""
    spark = W.sparkSession
    idx = dense_index(items.select("item_id").filter("item_id IS NOT NULL").distinct(), ["item_id"], "_i")
    size = idx.count()
    side_a = idx.select(F.col("item_id").alias("item_a"), F.col("_i").alias("_a"))
    side_b = idx.select(F.col("item_id").alias("item_b"), F.col("_i").alias("_b"))
    held = (W.select(F.col("item_i").alias("item_a"), F.col("item_j").alias("item_b")).join(side_a, "item_a").join(side_b, "item_b")
            .filter("_a != _b").select((F.col("_a") * size + F.col("_b")).alias("_at")).distinct())
    out = dense_index(held.unionByName(idx.select((F.col("_i") * size + F.col("_i")).alias("_at"))), ["_at"], "_k")
    m = size * size - out.count()
    if m < n:
        raise ValueError(f"only {m} pairs are absent from W, {n} wanted")
    ranks = dense_index(spark.range(n).select(permuted(F.col("id"), max(m, 1), seed).alias("_t")), ["_t"], "_s")
    both = out.select((F.col("_at") - F.col("_k")).alias("_t"), F.lit(-1).cast("long").alias("_s"), "_at").unionByName(
        ranks.select("_t", "_s", F.lit(0).cast("long").alias("_at")))
    # left-out places first among equals: their _s is negative
    place = (dense_index(both, ["_t", "_s", "_at"], "_g").filter("_s >= 0")
             .select((F.col("_t") + F.col("_g") - F.col("_s")).alias("_p")))
    return (place.select(F.expr(f"_p div {max(size, 1)}").alias("_a"), (F.col("_p") % max(size, 1)).alias("_b"))
            .join(side_a, "_a").join(side_b, "_b").select("item_a", "item_b", F.lit(0.0).alias("value")))
