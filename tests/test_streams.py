"""Streams against their batch twins on small fixtures."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cartwalk.operators import interactions as I
from cartwalk.streaming import sessions as ST


def test_stream_session_matches_sequential(spark):
    cands = [(1, 0, 10, 1), (1, 0, 11, 2), (1, 1, 10, 1), (1, 1, 12, 2), (1, 2, 10, 1), (1, 2, 12, 2),
             (2, 0, 5, 1), (2, 1, 5, 1)]
    df = spark.createDataFrame(cands, "session_id long, turn long, item_id long, rank long")
    got = {(r.session_id, r.turn): r.added_item for r in ST.stream_session(spark, df).collect()}
    # sequential reference
    want = {}
    pdf = pd.DataFrame(cands, columns=["s", "t", "i", "r"]).sort_values(["s", "t", "r"])
    for s, g in pdf.groupby("s"):
        seen = set()
        for t, h in g.groupby("t"):
            add = next((i for i in h.i if i not in seen), None)
            if add is not None:
                seen.add(add)
            want[(s, t)] = add
    assert got == want


def test_silent_sessions_are_let_go(spark):
    # Session 1 pauses for 5 turns, 2 for 3; 3 speaks once, late.
    turns = {1: [0, 1, 6, 7], 2: [0, 3, 6], 3: [9], 4: [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]}
    cands = [(s, t, i, r) for s, ts in turns.items() for t in ts for r, i in enumerate((10, 11, 12))]
    df = spark.createDataFrame(cands, "session_id long, turn long, item_id long, rank long")
    before = spark.conf.get(ST.STATE_STORE[0])
    got = sorted(map(tuple, ST.stream_session(spark, df, idle_ms=3 * 60_000).collect()), key=lambda r: r[:2])
    assert spark.conf.get(ST.STATE_STORE[0]) == before
    assert got == sorted(map(tuple, I.session_walk(df, idle_turns=3).collect()), key=lambda r: r[:2])
    assert [r[2:] for r in got if r[0] == 1] == [(10, 1), (11, 2), (10, 1), (11, 2)]
    assert [r[2:] for r in got if r[0] == 2] == [(10, 1), (11, 2), (12, 3)]


def test_model_follows_the_interactions(spark):
    import random

    from cartwalk.operators import walk as WK
    rng = random.Random(8)
    rows = [(rng.randrange(25), int(18 * rng.random() ** 2), f"2024-01-{rng.randrange(1, 29):02d} {rng.randrange(24):02d}:{rng.randrange(60):02d}:00",
             rng.random() < 0.3) for _ in range(400)]
    lines = spark.createDataFrame(rows, "session_id long, item_id long, d string, is_purchase boolean").select(
        "session_id", "item_id", F.col("d").cast("timestamp_ntz").alias("date"), "is_purchase")
    models = ST.stream_model(spark, lines, lambda df: I.prepare_profile(df, 0.2, 1.0), topK=6).collect()
    last = max(r["batch_id"] for r in models)
    want = {(r["item_i"], r["item_j"]): r["sim"] for r in WK.rp3_fit(I.prepare_profile(lines, 0.2, 1.0), topK=6).collect()}
    got = {(r["item_i"], r["item_j"]): r["sim"] for r in models if r["batch_id"] == last}
    assert last >= 2 and set(got) == set(want)
    assert all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())


def test_stream_dedup_matches_batch(spark):
    rows = [(1, 7, "2024-01-01 10:00:00", 1), (1, 7, "2024-01-01 11:00:00", 2), (2, 7, "2024-01-02 09:00:00", 3),
            (1, 8, "2024-01-01 12:00:00", 4), (2, 7, "2024-01-02 08:00:00", 5)]
    df = spark.createDataFrame(rows, "session_id long, item_id long, d string, event_id long").select(
        "session_id", "item_id", F.col("d").cast("timestamp_ntz").alias("date"), "event_id")
    got = sorted(tuple(r) for r in ST.stream_dedup_last(spark, df).select("session_id", "item_id", "event_id").collect())
    batch = I.dedup_last(df).select("session_id", "item_id", "event_id")
    assert got == sorted(tuple(r) for r in batch.collect())


def _purchases(spark):
    from conftest import SF001
    from cartwalk.sources.roles import Roles
    from cartwalk.sources.tables import Tables
    return Roles(Tables(spark, SF001)).event_interactions()


def test_stream_windows_equal_their_batch_twin(spark):
    ev = _purchases(spark).filter(F.col("event_type") == "purchase")
    got = sorted(map(tuple, ST.stream_window_4h(spark, ev).select("window_start", "n_sessions").collect()))
    twin = ev.groupBy(F.window(F.col("date").cast("timestamp"), "4 hours").alias("w")).agg(
        F.approx_count_distinct("session_id").alias("n"))
    assert got == sorted(map(tuple, twin.select(F.col("w.start").cast("timestamp_ntz"), "n").collect())) and got


def test_stream_dedup_equals_batch_on_the_table(spark):
    ev = _purchases(spark)
    got = sorted(map(tuple, ST.stream_dedup_last(spark, ev).select("session_id", "item_id", "event_id").collect()))
    last = ev.groupBy("session_id", "item_id").agg(F.max(F.struct("date", "event_id")).alias("v"))
    assert got == sorted(map(tuple, last.select("session_id", "item_id", "v.event_id").collect()))


def test_repeated_batch_changes_nothing(spark):
    from cartwalk.sources.io import new_dir
    sink = new_dir(spark, "repeat")
    write = ST.batch_writer(sink)
    for b in (0, 1, 1, 0):
        write(spark.range(5).withColumn("x", F.lit(b)), b)
    assert spark.read.parquet(sink).count() == 10


def test_sessions_are_walked_in_one_pass(spark):
    """Sessions that lie over several batches, against one after the other."""
    rnd = random.Random(4)
    rows = [(s, t, rnd.randint(1, 9), r) for s in range(40) for t in sorted(rnd.sample(range(30), 7)) for r in range(1, 4)]
    df = spark.createDataFrame(rows + [(5, None, 1, 1), (None, 1, 1, 1)], "session_id long, turn int, item_id long, rank long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        walked = I.session_walk(df, idle_turns=4)
        assert "FlatMapGroupsInPandas" not in walked._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, walked.collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = []
    for s in range(40):
        held, last = set(), None
        for t in sorted({x[1] for x in rows if x[0] == s}):
            if last is not None and t - last > 4:
                held = set()
            last = t
            added = next((i for _, i in sorted((x[3], x[2]) for x in rows if x[:2] == (s, t)) if i not in held), None)
            held |= {added} - {None}
            want.append((s, t, added, len(held)))
    assert got == want
