"""Make the package importable by Python workers, and name shared folders."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

import wardline
from wardline.session import checkpoint_dir

_shipped: set[str] = set()

# A batch of texts is held by the executor and by its Python worker, several times over.
# Shuffle files of a finished action are not read again: operators of several steps would
# otherwise keep those of all steps on disk until the driver happens to collect garbage.
SETTINGS = {
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def ship_package(spark: SparkSession) -> SparkSession:
    """Send the package to every Python worker through Spark's own file service,
    once per application, so jobs do not rely on an executor's import path. ``SETTINGS``
    hold where the session does not say otherwise."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) in (None, ""):
            spark.conf.set(key, value)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.abspath(wardline.__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="wardline-ship-"), "wardline.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for folder, _, names in os.walk(root):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.join("wardline", os.path.relpath(path, root)))
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)
    return spark


def ship_file(spark: SparkSession, path: str) -> str:
    """Send a file to every worker through Spark's own file service, once per
    application; returns the name by which a worker asks ``SparkFiles.get`` for it."""
    key = f"{spark.sparkContext.applicationId} {path}"
    if key not in _shipped:
        spark.sparkContext.addFile(path)
        _shipped.add(key)
    return os.path.basename(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until ``df`` has no such column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that ``spark.checkpoint.dir`` names."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored as Parquet in the shared folder and read back: its lineage ends
    at files that survive the loss of executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
