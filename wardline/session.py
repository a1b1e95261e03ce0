"""SparkSession construction with the settings every job assumes.

On a cluster the session normally already exists; ``tune`` only fills in
settings that are still unset, so cluster-level choices (shuffle
partitions sized for the data, the shared checkpoint directory) win.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the jobs rely on. AQE re-plans joins from the real shuffle sizes
# (broadcast conversion, partition coalescing, skew-split of hot keys).
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
}

# Cost-based planning from catalog statistics (``store.save_bucketed`` collects them).
STATISTICS = {
    "spark.sql.cbo.enabled": "true",
    "spark.sql.cbo.joinReorder.enabled": "true",
    "spark.sql.cbo.planStats.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply DEFAULTS for every key the session has not set itself."""
    conf = spark.conf
    for key, value in DEFAULTS.items():
        if conf.get(key, None) in (None, ""):
            conf.set(key, value)
    return spark


def use_statistics(spark: SparkSession) -> SparkSession:
    """Let Catalyst order inner joins by the catalog's row and distinct counts."""
    for key, value in STATISTICS.items():
        spark.conf.set(key, value)
    return spark


def statistics_session(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` with its settings and ``use_statistics``, so that the
    planning of other jobs stays as it is."""
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            session.conf.set(key, value)
    return use_statistics(session)


def size_shuffles(spark: SparkSession, input_bytes: int,
                  partition_bytes: int = 256 * 1024 * 1024) -> int:
    """Size shuffles for an input of ``input_bytes`` (e.g. the snapshot size).

    Raises the shuffle partition count until a full shuffle of the input gives
    partitions of at most about ``partition_bytes`` (they must fit in an
    executor task's memory without heavy spill); a larger count the session
    already has stays. Returns the count used.
    """
    conf, key = spark.conf, "spark.sql.shuffle.partitions"
    parts = max(int(conf.get(key)), -(-input_bytes // partition_bytes))
    if parts > int(conf.get(key)):
        conf.set(key, str(parts))
    return parts


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set by the cluster (a shared file system).
    Only a local session without one gets a private scratch folder, as in
    tests.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        path = tempfile.mkdtemp(prefix="wardline-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", path)
        except Exception:  # core settings may be read-only at runtime
            pass
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder of ``checkpoint_dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "wardline") -> SparkSession:
    """A local session for tests and the benchmark (UI off, no ports opened)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("WARDLINE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)
