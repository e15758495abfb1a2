"""Deferred acceptance against the textbook loop and the one-by-one walk."""

import random

import pytest

from cartwalk.operators import assignment as AS

SCHEMA = "seeker LONG, literal STRING, rank LONG, claim DOUBLE"


def textbook(rows):
    lists, claims = {}, {}
    for s, lit, r, c in rows:
        lists.setdefault(s, []).append((r, lit))
        claims[s, lit] = (c, -s)
    todo, at, held = [(s, sorted(v)) for s, v in lists.items()], dict.fromkeys(lists, 0), {}
    lists = dict(todo)
    free = list(lists)
    while free:
        s = free.pop()
        if at[s] == len(lists[s]):
            continue
        lit = lists[s][at[s]][1]
        at[s] += 1
        if lit not in held:
            held[lit] = s
        elif claims[s, lit] > claims[held[lit], lit]:
            free.append(held[lit])
            held[lit] = s
        else:
            free.append(s)
    return {(s, lit) for lit, s in held.items()}


def made(matches):
    return {(r.seeker, r.literal) for r in matches.collect()}


def test_random_preferences(spark):
    rng = random.Random(3)
    rows = []
    for s in range(25):
        lits = rng.sample([f"l{i}" for i in range(20)], 9)
        rows += [(s, lit, r, float(rng.randrange(4))) for r, lit in enumerate(lits, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    m, rounds = AS.deferred_acceptance(df)
    assert made(m) == textbook(rows) and 1 <= rounds <= len(rows)
    assert AS.blocking_pairs(df, m).count() == 0
    # an instable matching is seen
    worse = m.filter(m.seeker != m.first().seeker)
    assert AS.blocking_pairs(df, worse).count() > 0
    used = spark.createDataFrame([("l1",), ("l2",), (None,)], "literal STRING")
    m, _ = AS.deferred_acceptance(df, used)
    assert made(m) == textbook([r for r in rows if r[1] not in ("l1", "l2")])
    assert AS.blocking_pairs(df, m, used).count() == 0


@pytest.mark.parametrize("walk", ["best", "reference"])
def test_listed_order_is_the_walk_one_by_one(spark, walk):
    rng = random.Random(8)
    cands = [(s, lit, 1.0 / r, r) for s in range(12) for r, lit in enumerate(rng.sample("abcdefghijk", 6), 1)]
    df = spark.createDataFrame(cands, "id INT, literal STRING, prob DOUBLE, rank LONG")
    m, _ = AS.deferred_acceptance(AS.preferences(df, "id", "listed", walk, 4))
    taken, want = set(), set()
    for s in range(12):
        mine = [lit for i, lit, _, r in cands if i == s and r <= 4]
        for lit in mine if walk == "best" else mine[::-1]:
            if lit not in taken:
                taken.add(lit)
                want.add((s, lit))
                break
    assert made(m) == want


def test_same_wishes_ties_and_odd_rows(spark):
    rows = [(s, lit, r, 0.5) for s in (3, 1, 2) for r, lit in enumerate("xyz", 1)]
    rows += [(1, "x", 7, 0.5), (1, "x", 1, 0.5), (None, "x", 1, 9.0), (4, None, 1, 9.0)]
    m, rounds = AS.deferred_acceptance(spark.createDataFrame(rows, SCHEMA))
    assert made(m) == {(1, "x"), (2, "y"), (3, "z")} and rounds == 3
    m, rounds = AS.deferred_acceptance(spark.createDataFrame([], SCHEMA))
    assert made(m) == set() and rounds == 0
    with pytest.raises(ValueError):
        AS.preferences(m, "seeker", order="other")
