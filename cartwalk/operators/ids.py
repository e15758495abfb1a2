"""Distributed dense numbering (a DataFrame form of ``zipWithIndex``).

``row_number() over (order by ...)`` without a partition moves every row to
one task.  Here the rows are range-partitioned and sorted inside each
partition; each row gets its position from ``monotonically_increasing_id``
(documented layout: partition id in the upper 31 bits, record number in the
lower 33) plus the number of rows in all earlier partitions.  The offset table
has one row per partition, so its broadcast has a proven size bound.

The tagged rows are written once to the checkpoint folder before the
per-partition counts are taken: range bounds come from sampling, so two
evaluations of the same range exchange need not agree; reading one stored
copy makes counts and rows consistent and survives lost executors.  The
ordering columns must be unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dense_index(df: DataFrame, order_cols: list[str], out_col: str, start: int = 0,
                num_partitions: int | None = None) -> DataFrame:
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    from cartwalk.session import materialize
    tagged = materialize(
        df.repartitionByRange(n, *order_cols)
        .sortWithinPartitions(*order_cols)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_off"),
    )
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (
        tagged.join(F.broadcast(offsets), "_pid")
        .withColumn(out_col, (F.col("_off") + local + F.lit(start)).cast("long"))
        .drop("_pid", "_mid", "_off")
    )


def dense_index_within(df: DataFrame, group_cols: list[str], order_cols: list[str], out_col: str) -> DataFrame:
    """``row_number`` from 1 within each group without bringing a group
    into one task: the global position less the group's first one.  Group and
    ordering columns together must be unique and not null."""
    from cartwalk.session import materialize
    n = materialize(dense_index(df, [*group_cols, *order_cols], "_at"))
    first = n.groupBy(*group_cols).agg(F.min("_at").alias("_first_at"))
    return n.join(first, group_cols).withColumn(out_col, F.col("_at") - F.col("_first_at") + 1).drop("_at", "_first_at")


# Rows of a stored table up to which it is broadcast.
BROADCAST_ROWS = 100_000


def join_small(df: DataFrame, small: DataFrame, on, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``df`` to a stored table that is small as a rule: broadcast while
    it has at most ``rows`` rows, a sort-merge join beyond.

    Left to Spark's estimates, which go by compressed file sizes and multiply
    them over a join, the large side may be the one that is sent to the driver."""
    return df.join(F.broadcast(small) if small.count() <= rows else small.hint("merge"), on, how)


def with_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row of ``df``.

    The aggregate has exactly one row (a global ``agg``), so broadcasting it
    is bounded; the join is an equi-join on a constant key, not a cross join.
    """
    return df.withColumn("_one", F.lit(1)).join(
        F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one").drop("_one")
