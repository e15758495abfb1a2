"""Zero fill (first free items of a global order) against brute force."""

import random

from cartwalk.operators.ranking import fill_from_order


def test_fill_matches_brute_force(spark):
    rnd = random.Random(7)
    items = sorted(rnd.sample(range(1000), 60))
    order = [(it, p + 1) for p, it in enumerate(items)]
    need, blocked = [], []
    for s in range(40):
        need.append((s, rnd.randint(0, 8)))
        for it in rnd.sample(items, rnd.randint(0, 30)):
            blocked.append((s, it))
    got = {}
    for r in fill_from_order(spark.createDataFrame(need, "session_id long, need long"),
                             spark.createDataFrame(blocked, "session_id long, item_id long"),
                             spark.createDataFrame(order, "item_id long, pos long")).collect():
        got.setdefault(r.session_id, []).append((r.fill_rank, r.item_id))
    for s, m in need:
        blk = {it for ss, it in blocked if ss == s}
        want = [it for it in items if it not in blk][:m]
        assert [it for _, it in sorted(got.get(s, []))] == want, s
