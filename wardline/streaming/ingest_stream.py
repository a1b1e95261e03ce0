"""Structured Streaming front for the batch inserts.

Candidate rows arrive as files; each micro-batch is classified by the same
job as a batch load (``wardline.plans.ingest``) against the latest committed
snapshot of the tables it writes, and the new snapshots are written as a new
version. A small Parquet log of (seq, entity, batch_id, table, path) is the
commit record: it is appended only after the snapshots are written, so a
retried micro-batch whose entity and id are already logged is skipped, and one
that failed halfway rewrites its own uncommitted version directory. Streams of
several entities may share one state folder, one at a time; ``seq`` orders
their versions. Later batches see the keys accepted by
earlier ones (first wins across batches too).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardline.plans import ingest as I
from wardline.sources.catalog import Tables
from wardline.sources.schemas import SCHEMAS

INGESTERS: dict[str, Callable[[Tables, DataFrame], I.IngestResult]] = {
    "specialty": I.ingest_specialty,
    "ward": I.ingest_ward,
    "bed": I.ingest_bed,
    "patient": I.ingest_patient,
    "doctor": I.ingest_doctor,
    "nurse": I.ingest_nurse,
}

LOG_SCHEMA = "seq long, entity string, batch_id long, table string, path string"


class VersionLog:
    """Committed table versions under ``state_dir`` (a shared folder)."""

    def __init__(self, spark: SparkSession, state_dir: str, initial: dict[str, str]):
        self.spark, self.state_dir, self.initial = spark, state_dir, dict(initial)

    @property
    def path(self) -> str:
        return f"{self.state_dir}/_log"

    def _exists(self) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def entries(self) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], LOG_SCHEMA)
        return self.spark.read.schema(LOG_SCHEMA).parquet(self.path)

    def committed(self, entity: str, batch_id: int) -> bool:
        return not self.entries().where(
            (F.col("entity") == entity) & (F.col("batch_id") == batch_id)).isEmpty()

    def latest_paths(self) -> dict[str, str]:
        """table -> path of its newest committed version (one row per table)."""
        latest = self.entries().groupBy("table").agg(F.max_by("path", "seq").alias("path"))
        paths = dict(self.initial)
        paths.update({r["table"]: r["path"] for r in latest.collect()})
        return paths

    def commit(self, entity: str, batch_id: int, paths: dict[str, str]) -> None:
        seq = self.entries().agg(F.coalesce(F.max("seq") + 1, F.lit(0))).first()[0]
        rows = [(seq, entity, batch_id, table, path) for table, path in paths.items()]
        self.spark.createDataFrame(rows, LOG_SCHEMA).coalesce(1).write.mode("append").parquet(
            self.path)

    def tables(self) -> Tables:
        return Tables({name: self.spark.read.schema(SCHEMAS[name]).parquet(path)
                       for name, path in self.latest_paths().items()})


def batch_writer(entity: str, log: VersionLog) -> Callable[[DataFrame, int], None]:
    ingest = INGESTERS[entity]

    def apply(batch: DataFrame, batch_id: int) -> None:
        if log.committed(entity, batch_id):
            return  # retry of a committed micro-batch
        version = f"{log.state_dir}/{entity}/v{batch_id:010d}"
        # An uncommitted version left by a failed attempt is rewritten.
        written = ingest(log.tables(), batch).write(version, mode="overwrite")
        log.commit(entity, batch_id, written.paths)

    return apply


def start(spark: SparkSession, entity: str, source_dir: str, candidate_schema: str,
          state_dir: str, initial_paths: dict[str, str], checkpoint_location: str,
          available_now: bool = True, files_per_trigger: int = 1000) -> StreamingQuery:
    """Start the stream; ``initial_paths`` maps every table name to its snapshot.

    Each micro-batch rewrites the snapshots it changes, so it should take many
    files at a time (``files_per_trigger``).
    """
    log = VersionLog(spark, state_dir, initial_paths)
    stream = spark.readStream.schema(candidate_schema).option("maxFilesPerTrigger", files_per_trigger).parquet(
        source_dir)
    writer = stream.writeStream.foreachBatch(batch_writer(entity, log)).option(
        "checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="30 seconds")
    return writer.start()
