"""Uniform shuffle into shards of exact size by a hypergeometric matrix.

All rows are to be put into a uniformly random order and cut into shards whose
row counts differ by at most one.  Instead of drawing random keys and counting
afterwards, the numbers of rows that go from each input partition to each
destination are drawn first, from the exact (multivariate hypergeometric) law they have under a
uniform permutation.  Then

1. each partition permutes its rows and deals them out by its row of the matrix,
2. rows are exchanged,
3. each destination permutes what it received.

Destinations are cells: consecutive slot ranges of a shard with sizes fixed
beforehand, so slots are gapless without a count after the exchange, and a shard
of any size is spread over many tasks.

The matrix is never built.  Partitions are the leaves of a binary tree; at
each node a draw seeded by the node splits the cells' remaining rows between the two
halves, and a task that needs its row of the matrix walks from the root to its leaf.
All tasks see the same draws, a task that runs again as well.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwalk.llm.common import plain, quoted, ready, shuffle_partitions
from cartwalk.session import scratch_path

CELL_ROWS = 1 << 20
MANY_CELLS = 1 << 16
_SAFE = 10 ** 9  # numpy's own sampler takes populations below this


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Number of good ones among ``draws`` without replacement, for
    populations of any size: by numpy where it can, else by ratio of uniforms
    (Stadlober's bounds) on the log-gamma form of the probabilities."""
    if good < _SAFE and bad < _SAFE:
        return int(rng.hypergeometric(good, bad, draws))
    if good == 0 or draws == 0:
        return 0
    if bad == 0:
        return draws
    total = good + bad
    few, some = min(good, bad), min(draws, total - draws)
    p = few / total
    centre = some * p + 0.5
    width = math.sqrt((total - some) * some * p * (1 - p) / (total - 1) + 0.5)
    height = 2 * math.sqrt(2 / math.e) * width + 3 - 2 * math.sqrt(3 / math.e)
    top = min(min(some, few) + 1, math.floor(centre + 16 * width))

    def log_weight(k):
        return -(math.lgamma(k + 1) + math.lgamma(few - k + 1) + math.lgamma(some - k + 1) + math.lgamma(total - few - some + k + 1))
    best = log_weight((some + 1) * (few + 1) // (total + 2))
    while True:
        u, v = rng.random(2)
        if u == 0:
            continue
        k = centre + height * (v - 0.5) / u
        if not 0 <= k < top:
            continue
        k = math.floor(k)
        if 2 * math.log(u) <= log_weight(k) - best:
            break
    if good > bad:
        k = some - k
    return k if some == draws else good - k


def split(rng: np.random.Generator, sizes: np.ndarray, draws: int) -> np.ndarray:
    """Rows of each cell among ``draws`` taken from all cells."""
    if int(sizes.sum()) < _SAFE:
        return rng.multivariate_hypergeometric(sizes, draws, method="marginals")
    out, left = np.zeros_like(sizes), int(sizes.sum())
    for i, n in enumerate(sizes.tolist()):
        out[i] = hypergeometric(rng, n, left - n, draws)
        left, draws = left - n, draws - int(out[i])
    return out


def matrix_row(part: int, counts: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """How many rows of partition ``part`` go to each cell.  ``counts`` are
    the partitions' rows, ``sizes`` the cells'; both add up to the same."""
    before = np.concatenate([[0], np.cumsum(counts)])
    lo, hi = 0, len(counts)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        first = split(rng, sizes, int(before[mid] - before[lo]))
        if part < mid:
            hi, sizes = mid, first
        else:
            lo, sizes = mid, sizes - first
    return sizes


def cell_sizes(rows: int, shards: int, per_shard: int) -> np.ndarray:
    """Rows of each cell, cells of a shard side by side; shards and the cells
    of a shard differ by at most one row."""
    def even(n, k):
        return n // k + (np.arange(k) < n % k)
    return np.concatenate([even(int(n), per_shard) for n in even(rows, shards)]).astype(np.int64)


def shuffle_into_shards(docs: DataFrame, shards: int = 16, seed: int = 7) -> DataFrame:
    """``docs`` in a uniformly random order with ``shard`` (0 to shards - 1)
    and ``slot`` (0, 1, ... within the shard); whole rows are exchanged.

    Shards' row counts differ by at most one.  Equal rows are rows of their
    own; nulls are carried along.  With fewer rows than shards some shards are
    empty; an empty table gives an empty one.  Input columns called shard or
    slot are replaced.  The order depends on the seed and on how the input is
    divided into partitions, which is written down once, so tasks that run again agree.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark = ready(docs.sparkSession)
    docs = docs.select(*[quoted(c) for c in docs.columns if c.lower() not in ("shard", "slot")])
    docs, old = plain(docs)
    part, place, cell = "part", "place", "cell"
    path = scratch_path(spark, f"shards-{uuid.uuid4().hex}")
    docs.withColumn(part, F.spark_partition_id()).withColumn(
        place, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).write.parquet(path)
    staged = spark.read.parquet(path)
    found = {r[0]: r[1] for r in staged.groupBy(part).count().collect()}  # one number per partition
    numbers = sorted(found)
    counts = np.array([found[p] for p in numbers], np.int64)
    rows = int(counts.sum())
    per_shard = max(1, -(-rows // (shards * CELL_ROWS)), min(-(-shuffle_partitions(spark) // shards), MANY_CELLS // shards))
    sizes = cell_sizes(rows, shards, per_shard)
    starts = np.concatenate([np.cumsum(s) - s for s in sizes.reshape(shards, per_shard)])
    rank = {p: i for i, p in enumerate(numbers)}
    key = F.xxhash64(F.lit(seed), part, place)
    schema = T.StructType([*staged.schema.fields, T.StructField(cell, T.IntegerType())])
    at_part, at_place = staged.columns.index(part), staged.columns.index(place)

    def deal(batches):
        kept: dict[int, np.ndarray] = {}
        for b in batches:
            parts, places = b.column(at_part).to_numpy(), b.column(at_place).to_numpy()
            cells = np.empty(len(parts), np.int32)
            for p in np.unique(parts).tolist():
                if p not in kept:
                    kept = {p: np.random.default_rng([seed, 1, p]).permutation(
                        np.repeat(np.arange(len(sizes), dtype=np.int32), matrix_row(rank[p], counts, sizes, seed)))}
                mine = parts == p
                cells[mine] = kept[p][places[mine]]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells)], names=[*b.schema.names, cell])

    dealt = staged.mapInArrow(deal, schema).repartition(cell).sortWithinPartitions(cell, key, part, place)
    out = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    carried = [staged.columns.index(c) for c in docs.columns]

    def number(batches):
        last, seen = -1, 0
        for b in batches:
            cells = b.column(b.num_columns - 1).to_numpy()
            first = np.concatenate([[True], cells[1:] != cells[:-1]]) if len(cells) else np.zeros(0, bool)
            if len(cells) and cells[0] == last:
                first[0] = False
            index = np.arange(len(cells))
            begun = np.maximum.accumulate(np.where(first, index, -1))
            inside = np.where(begun < 0, seen + index, index - begun)
            if len(cells):
                last, seen = int(cells[-1]), int(inside[-1]) + 1
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in carried], pa.array((cells // per_shard).astype(np.int32)),
                                              pa.array(starts[cells] + inside)], names=out.names)
    return dealt.mapInArrow(number, out).toDF(*old, "shard", "slot")


def shards_digest(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Query form, law ``rows``: size and CRC-32 of the text that arrived in
    each slot."""
    text = F.coalesce("text", F.lit(""))
    return shuffle_into_shards(docs.select("doc_id", "text"), shards).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
