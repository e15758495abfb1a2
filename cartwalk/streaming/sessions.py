"""Structured Streaming versions of the session operators.

* X1 ``stream_session``   keyed state per session (``transformWithStateInPandas``, a
                           map of held items): each message adds its best candidate not
                           yet in the session; a session silent for ``IDLE_MS`` is let go
* X2 ``stream_recommend``  ``foreachBatch``: new interactions of a micro-batch
                           joined to the static model W and ranked
* X2 ``stream_model``      ``foreachBatch``: the walk's pair sums follow the interactions,
                           each batch leaves a new W
* X3 ``stream_window_4h``  watermark + 4-hour tumbling window,
                           ``approx_count_distinct`` of sessions
* X4 ``stream_dedup_last`` watermark + keep-last per (day, session, item); the
                           days are merged by a maximum when read

A replay arrives in time order: the input is staged as range-partitioned files
whose modification times follow the range, which is the order in which the file
source takes them, so a watermark finds no row late.  Sinks are one folder per
batch id, overwritten when a batch is repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cartwalk.operators import pairsums as PS
from cartwalk.operators import walk as WK
from cartwalk.session import materialize
from cartwalk.sources.io import new_dir


# A session without messages for this long, in event time, gives up its state.
IDLE_MS = 3_600_000
# Micro-batches of a replay, whatever its size.
BATCHES = 4


def stage_input(df: DataFrame, spark: SparkSession, kind: str, order: str | None = None, key: str | None = None) -> tuple[str, int]:
    """Write a batch table as the Parquet files a stream will read; gives the
    path and the files to take per trigger.  With ``order``, files hold
    ascending ranges of it and arrive in that order; with ``key``, all rows of a
    key land in one file, i.e. one micro-batch."""
    path = new_dir(spark, f"stream-in-{kind}")
    n = max(BATCHES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(n, order) if order else df.repartition(n, key)
    dealt.write.mode("error").parquet(path)
    return path, max(1, _arrive_in_order(spark, path) // BATCHES)


def _arrive_in_order(spark: SparkSession, path: str) -> int:
    """Give the files of a folder modification times in the order of their
    part numbers (one metadata call per file); returns their number."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((str(f.getPath()), f.getPath(), f.getModificationTime()) for f in fs.listStatus(folder)
                   if f.getPath().getName().startswith("part-"))
    first = min((t for _, _, t in files), default=0) // 1000 * 1000 - 1000 * len(files)
    for i, (_, p, _) in enumerate(files):
        fs.setTimes(p, first + 1000 * i, -1)
    return len(files)


def read_stream(spark: SparkSession, staged: tuple[str, int], schema) -> DataFrame:
    path, per_trigger = staged
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def batch_writer(sink: str):
    """``foreachBatch`` function that makes each batch one folder of ``sink``;
    a repeated batch replaces its folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
    return write


def run_available(writer, name: str):
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(f"stream {name} failed: {q.exception()}")
    return q


# -- X1 -----------------------------------------------------------------------

X1_OUT = "session_id long, turn long, added_item long, session_size long"
# Keyed state in maps and timers needs this store; set for the start of X1 only.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class SessionProcessor(StatefulProcessor):
    """State of a session: ``held`` (item -> turn it came in) and ``last``
    (items held, event time of the last message, its timer).  A message later than ``idle_ms``
    after the last one finds the session empty, whether or not the timer has
    fired, so results don't depend on how messages are cut into batches; the
    timer only frees the state."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "item_id long", "turn long")
        self.last = handle.getValueState("last", "size long, at long, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["turn", "rank", "item_id"])
        size, at, timer = self.last.get() if self.last.exists() else (0, None, None)
        out = []
        for turn, g in pdf.groupby("turn", sort=True):
            now = int(g["at"].iloc[0])
            if at is not None and now - at > self.idle_ms:
                self.held.clear()
                size = 0
            at = now if at is None else max(at, now)
            added = next((int(i) for i in g["item_id"].tolist() if not self.held.containsKey((int(i),))), None)
            if added is not None:
                self.held.updateValue((added,), (int(turn),))
                size += 1
            out.append((int(key[0]), int(turn), added, size))
        if timer is not None:
            self.handle.deleteTimer(timer)
        # The first millisecond at which the session counts as silent.
        timer = at + self.idle_ms + 1
        self.handle.registerTimer(timer)
        self.last.update((size, at, timer))
        yield pd.DataFrame(out, columns=["session_id", "turn", "added_item", "session_size"]).astype({"added_item": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_session(spark: SparkSession, candidates: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """Run the keyed-state accumulation over candidate messages
    (session_id, turn, item_id, rank) and return its output table.  The batch
    twin is ``interactions.session_walk`` with the same idle time."""
    src = stage_input(candidates.select("session_id", "turn", "item_id", "rank"), spark, "x1", order="turn")
    # Turns stand for the time of a message, a minute apart.
    s = read_stream(spark, src, "session_id long, turn long, item_id long, rank long").withColumn(
        "ts", F.timestamp_seconds(86_400 + F.col("turn") * 60)).withWatermark("ts", "1 minute").withColumn(
        "at", F.unix_millis("ts"))
    out = s.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=SessionProcessor(idle_ms), outputStructType=X1_OUT, outputMode="Append", timeMode="eventTime")
    sink = new_dir(spark, "x1-out")
    name, store = STATE_STORE
    before = spark.conf.get(name)
    spark.conf.set(name, store)
    try:
        run_available(out.writeStream.format("parquet").option("path", sink)
                      .option("checkpointLocation", new_dir(spark, "x1-ckpt")).outputMode("append"), "x1")
    finally:
        spark.conf.set(name, before)
    return spark.read.parquet(sink)


# -- X2 -----------------------------------------------------------------------

def stream_recommend(spark: SparkSession, interactions: DataFrame, recommend_batch) -> DataFrame:
    """Every micro-batch of new interactions is scored against the
    static model by ``recommend_batch(df) -> DataFrame``; the result carries its
    ``batch_id``."""
    src = stage_input(interactions.select("session_id", "item_id", "date"), spark, "x2", key="session_id")
    s = read_stream(spark, src, "session_id long, item_id long, date timestamp_ntz")
    sink = new_dir(spark, "x2-out")
    write = batch_writer(sink)
    run_available(s.writeStream.foreachBatch(lambda batch, batch_id: write(recommend_batch(batch), batch_id))
                  .option("checkpointLocation", new_dir(spark, "x2-ckpt")), "x2")
    return spark.read.parquet(sink)


def stream_model(spark: SparkSession, lines: DataFrame, profile, alpha: float = WK.DEFAULT_ALPHA, beta: float = WK.DEFAULT_BETA,
                 topK: int | None = WK.DEFAULT_TOPK) -> DataFrame:
    """X2, the model's side: ``lines`` (session_id, item_id, date, ...) arrive in
    time order and W follows them.  ``profile(lines)`` makes the interaction
    matrix (session_id, item_id, score) of whole sessions.  Gives the tables
    of W, one for each ``batch_id``; the last equals a fit on all lines.

    Kept are three logs with a folder for each batch: the lines, the changes
    of the pair sums and the changes of the items' popularity.  A batch reads
    the lines of the sessions it touches, forms pairs for these only, and
    adds up the logs for W.  Batches read earlier folders and write their
    own, so one that is repeated changes nothing."""
    lines_log, sums_log, pops_log, sink = (new_dir(spark, f"x2-{kind}") for kind in ("lines", "sums", "pops", "model"))
    src = stage_input(lines, spark, "x2-model", order="date")
    sums_schema, pops_schema = "item_i long, item_j long, n long, c0 double, batch_id long", "item_id long, pop long, batch_id long"

    def so_far(path: str, schema, batch_id: int) -> DataFrame:
        return spark.read.schema(schema).parquet(path).filter(F.col("batch_id") <= batch_id)

    def step(batch: DataFrame, batch_id: int) -> None:
        batch_writer(lines_log)(batch, batch_id)
        every = so_far(lines_log, T.StructType([*lines.schema.fields, T.StructField("batch_id", T.LongType())]), batch_id)
        touched = every.filter(F.col("batch_id") == batch_id).select("session_id").distinct()
        mine = materialize(every.join(touched, "session_id", "left_semi"))
        before = materialize(profile(mine.filter(F.col("batch_id") < batch_id).drop("batch_id")).select("session_id", "item_id", "score"))
        after = materialize(profile(mine.drop("batch_id")).select("session_id", "item_id", "score"))
        batch_writer(sums_log)(PS.sums_delta(before, after, (alpha,)), batch_id)
        changes = after.select("item_id", F.lit(1).alias("d")).unionByName(before.select("item_id", F.lit(-1).alias("d")))
        batch_writer(pops_log)(changes.groupBy("item_id").agg(F.sum("d").alias("pop")).filter("pop != 0"), batch_id)
        sums = PS.merged_sums(so_far(sums_log, sums_schema, batch_id).drop("batch_id"))
        pops = so_far(pops_log, pops_schema, batch_id).groupBy("item_id").agg(F.sum("pop").alias("pop")).filter("pop > 0")
        batch_writer(sink)(PS.fit_from_sums(sums, pops, alpha, beta, topK), batch_id)
    s = read_stream(spark, src, lines.schema)
    run_available(s.writeStream.foreachBatch(step).option("checkpointLocation", new_dir(spark, "x2-model-ckpt")), "x2-model")
    return spark.read.schema("item_i long, item_j long, sim double, batch_id long").parquet(sink)


# -- X3 -----------------------------------------------------------------------

def stream_window_4h(spark: SparkSession, events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Approximate distinct sessions per 4-hour window (exact distinct
    counts are not supported on streams).  Batches report the windows they
    changed; the last report of a window holds all its sessions."""
    src = stage_input(events.select("session_id", "date"), spark, "x3", order="date")
    s = read_stream(spark, src, "session_id long, date timestamp_ntz").withColumn(
        "ts", F.col("date").cast("timestamp"))
    agg = (s.withWatermark("ts", watermark)
           .groupBy(F.window("ts", "4 hours").alias("w"))
           .agg(F.approx_count_distinct("session_id").alias("n_sessions")))
    sink = new_dir(spark, "x3-out")
    run_available(agg.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                             F.col("w.end").cast("timestamp_ntz").alias("window_end"), "n_sessions")
                  .writeStream.outputMode("update").foreachBatch(batch_writer(sink))
                  .option("checkpointLocation", new_dir(spark, "x3-ckpt")), "x3")
    return (spark.read.parquet(sink).groupBy("window_start", "window_end")
            .agg(F.max_by("n_sessions", "batch_id").alias("n_sessions")))


# -- X4 -----------------------------------------------------------------------

def stream_dedup_last(spark: SparkSession, events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Last interaction per (session, item).  State is kept by day, so the
    watermark can let it go; the maximum over days and reports is the last."""
    src = stage_input(events.select("session_id", "item_id", "date", "event_id"), spark, "x4", order="date")
    s = read_stream(spark, src, "session_id long, item_id long, date timestamp_ntz, event_id long").withColumn(
        "ts", F.col("date").cast("timestamp"))
    agg = (s.withWatermark("ts", watermark).groupBy(F.window("ts", "1 day"), "session_id", "item_id")
           .agg(F.max(F.struct("date", "event_id")).alias("last")))
    sink = new_dir(spark, "x4-out")
    run_available(agg.select("session_id", "item_id", "last").writeStream.outputMode("update").foreachBatch(batch_writer(sink))
                  .option("checkpointLocation", new_dir(spark, "x4-ckpt")), "x4")
    return (spark.read.parquet(sink).groupBy("session_id", "item_id").agg(F.max("last").alias("v"))
            .select("session_id", "item_id", "v.date", "v.event_id"))
