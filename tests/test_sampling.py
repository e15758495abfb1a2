"""Absent pairs: rank selection against a plain list, dense and empty W."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from cartwalk.operators.sampling import absent_pairs, permuted


@pytest.mark.parametrize("m", [1, 2, 3, 7, 100, 1001])
def test_permutation(spark, m):
    got = [r[0] for r in spark.range(m).select(permuted(F.col("id"), m, 5)).collect()]
    assert sorted(got) == list(range(m))


def test_permutation_of_a_large_range(spark):
    m = 3_000_000_000 ** 2
    got = [r[0] for r in spark.range(2000).select(permuted(F.col("id"), m, 5)).collect()]
    assert len(set(got)) == 2000 and min(got) >= 0 and max(got) < m
    assert 0.4 < sum(got) / 2000 / m < 0.6


def _w(spark, pairs):
    return spark.createDataFrame(list(pairs), "item_i long, item_j long")


def test_every_absent_pair_of_a_nearly_full_matrix(spark):
    n = 100
    every = [(a, b) for a in range(n) for b in range(n) if a != b]
    absent = set(every[::99])  # W holds 99 % of all pairs
    W = _w(spark, [p for p in every if p not in absent] + [(3, 3), (0, 999), (1, 2), (1, 2)])
    items = spark.createDataFrame([(i,) for i in range(n)] + [(None,), (5,)], "item_id long")
    got = [(r.item_a, r.item_b) for r in absent_pairs(W, items, len(absent)).collect()]
    assert len(got) == len(absent) and set(got) == absent
    some = [(r.item_a, r.item_b) for r in absent_pairs(W, items, 30, seed=1).collect()]
    assert len(set(some)) == 30 and set(some) <= absent
    with pytest.raises(ValueError):
        absent_pairs(W, items, len(absent) + 1)


def test_uniform_over_the_ranks(spark):
    seeds = range(150)
    rows = spark.range(10).select(*[permuted(F.col("id"), 25, s).alias(f"s{s}") for s in seeds]).collect()
    hits = Counter(v for r in rows for v in r)
    # 60 expected for each rank, standard deviation 6
    assert len(hits) == 25 and sum(hits.values()) == 1500
    assert sum((h - 60) ** 2 for h in hits.values()) / (60 * 0.6) < 50


def test_empty(spark):
    none = spark.createDataFrame([], "item_id long")
    assert absent_pairs(_w(spark, []), none, 0).collect() == []
    one = spark.createDataFrame([(1,), (2,)], "item_id long")
    assert {(r.item_a, r.item_b) for r in absent_pairs(_w(spark, []), one, 2).collect()} == {(1, 2), (2, 1)}
