"""Spark session helpers.

On a cluster the session already exists and is configured by the platform;
``get_spark`` only fills in settings that are unset so a test or a local
bench run gets sane defaults without overriding a cluster's choices.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import SparkSession

# Settings every cartwalk job relies on (semantics, not tuning).
_REQUIRED = {
    # Parquet timestamps are wall-clock values; never shift them.
    "spark.sql.session.timeZone": "UTC",
}

# Tuning defaults applied only when the session does not set them.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Paths of stored tables, for ``release``.
_STORED: list[str] = []


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "cartwalk") -> SparkSession:
    """Return the active session, creating a local one when none exists."""
    active = SparkSession.getActiveSession()
    if active is not None:
        _apply(active)
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CARTWALK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m")
    )
    for k, v in {**_DEFAULTS, **_REQUIRED}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    _apply(spark)
    ship_package(spark)
    return spark


def _apply(spark: SparkSession) -> None:
    for k, v in _REQUIRED.items():
        spark.conf.set(k, v)
    for k, v in _DEFAULTS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)


def bounded_batches(spark: SparkSession, size: int = 16 << 20) -> None:
    """Bound the Arrow batches handed to Python by bytes where the session
    leaves them unbounded: ten thousand long texts are no longer one batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, str((1 << 63) - 1), "-1"):
        spark.conf.set(key, str(size))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared (HDFS/object store) folder there.  One is made up
    only in local mode, where driver and executors are one process; anywhere
    else a machine's own folder would be invisible to the other executors.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share (master {master})")
        path = tempfile.mkdtemp(prefix="cartwalk-ckpt-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def release(spark: SparkSession) -> int:
    """Remove the tables :func:`materialize` has stored so far, for callers
    that are done with the results; returns how many there were."""
    jvm, n = spark._jvm, 0
    while _STORED:
        path = jvm.org.apache.hadoop.fs.Path(_STORED.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def drop_stored(df) -> None:
    """Remove one table of :func:`materialize` that nothing reads any more."""
    spark, stored = df.sparkSession, getattr(df, "_cartwalk_path", None)
    if stored in _STORED:
        _STORED.remove(stored)
        path = spark._jvm.org.apache.hadoop.fs.Path(stored)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files that no plan reads any more.  Executors keep them until the driver's
    garbage is collected, which may be long after what was made from them is stored."""
    import gc
    gc.collect()
    spark._jvm.System.gc()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def materialize(df, *partition_by: str):
    """Cut lineage: write ``df`` as a Parquet table under the shared
    checkpoint folder and return a DataFrame reading it back.  Used at
    model/artefact boundaries so later plans stay small, a lost executor
    does not recompute the fit, and the planner sees the table's real size
    (AQE broadcast decisions, column pruning on read).  ``partition_by`` columns
    become folders, so that a filter on them reads the matching files only."""
    import uuid
    spark = df.sparkSession
    path = scratch_path(spark, f"mat-{uuid.uuid4().hex}")
    df.write.mode("error").partitionBy(*partition_by).parquet(path)
    _STORED.append(path)
    # An empty table with folders has no file to take the schema from.
    out = (spark.read.schema(df.schema) if partition_by else spark.read).parquet(path)
    out._cartwalk_stored = True
    out._cartwalk_path = path
    return out


def is_stored(df) -> bool:
    """True for a DataFrame returned by ``materialize`` (a plain scan)."""
    return getattr(df, "_cartwalk_stored", False)


def tasks_for(df, rows: int) -> list[int]:
    """The leading arguments of ``repartition`` that give each task about ``rows`` rows of ``df``, a stored or
    source table whose rows Parquet's footers count: none while the session's shuffle partitions are enough, or for a plan."""
    if not (is_stored(df) or getattr(df, "_cartwalk_source", False)):
        return []
    tasks = -(-df.count() // rows)
    return [tasks] if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []


def spread(df, key: str | None = None):
    """Give CPU-heavy per-row work (tokenising whole texts) enough tasks.

    A small table stored in one file is scanned by one task; only when the
    scan has fewer partitions than the cluster's default parallelism is it
    repartitioned.  A large input already has many splits, so no extra
    shuffle happens at scale.
    """
    sc = df.sparkSession.sparkContext
    target = sc.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, key) if key else df.repartition(target)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``cartwalk`` importable in executor Python workers (pandas UDFs,
    ``applyInPandas``, stream state functions) by zipping the package once
    per Spark context and adding it with ``addPyFile`` - the same thing
    ``--py-files`` does on a cluster.  Harmless when the package is already
    installed on the executors."""
    sc = spark.sparkContext
    key = sc.applicationId  # unique per context, unlike id(), which can be reused
    if key in _SHIPPED:
        return
    import zipfile

    import cartwalk
    pkg = os.path.dirname(os.path.abspath(cartwalk.__file__))
    root = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(suffix=".zip", prefix="cartwalk-")
    with zipfile.ZipFile(os.fdopen(fd, "wb"), "w") as z:
        for dirpath, _, files in os.walk(pkg):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(key)
