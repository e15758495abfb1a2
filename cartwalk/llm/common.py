"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwalk.session import scratch_path, ship_package

# Words are maximal runs of anything but these six ASCII characters, which are
# also what ``bytes.split()`` cuts at.
WORD_SEPARATORS = r"[\x20\x09-\x0D]+"

# Bytes of one Arrow batch handed to a Python task; long texts would otherwise
# make a batch of ten thousand rows as large as all of them together.
BATCH_BYTES = 16 << 20
PIECE_BYTES = 4 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on, set only where unset."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, str((1 << 63) - 1), "-1"):
        spark.conf.set(key, str(BATCH_BYTES))
    return spark


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage: ``df`` written under the shared checkpoint folder and
    read back, so that several readers share one evaluation.

    The tables kept this way are narrow.  They are written uncompressed: the
    compression codecs hold buffers outside the heap for every file until the
    next garbage collection, which adds up over many small files."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{uuid.uuid4().hex}")
    df.write.option("compression", "none").parquet(path)
    return spark.read.parquet(path)


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of ``frames`` has (names differ by case too)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def quoted(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def plain(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns called c0, c1, ... and the names they had.
    PySpark's Arrow functions can't take names with dots."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), df.columns


def words(raw: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text; none for null."""
    return raw.split() if raw else []


def word_pieces(raw: bytes | None, size: int = PIECE_BYTES):
    """The words of a text as lists of about ``size`` bytes of text each, so
    that a very long text never becomes one list of word objects."""
    if not raw:
        return
    if len(raw) <= size:
        yield raw.split()
        return
    start, n = 0, len(raw)
    while start < n:
        end = min(n, start + size)
        while end < n and raw[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield raw[start:end].split()
        start = end
