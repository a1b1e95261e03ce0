"""File stream of candidate batches -> versioned snapshots, idempotent per batch id."""

from __future__ import annotations

import tempfile

from conftest import collect

from wardline.sources.schemas import SCHEMAS
from wardline.streaming.ingest_stream import VersionLog, batch_writer, start

CAND = "arrival_seq long, bed_no string, care_unit_no string"


def test_stream_applies_batches_in_order(spark):
    root = tempfile.mkdtemp(prefix="wardline-stream-")
    initial = {}
    for name, schema in SCHEMAS.items():
        rows = [("B1", "U1", 0)] if name == "bed" else []
        spark.createDataFrame(rows, schema).write.parquet(f"{root}/init/{name}")
        initial[name] = f"{root}/init/{name}"
    spark.createDataFrame([(1, "B1", "U1"), (2, "B2", "U1")], CAND).coalesce(1).write.parquet(
        f"{root}/in/b1")
    q = start(spark, "bed", f"{root}/in/b1", CAND, f"{root}/state", initial, f"{root}/ckpt")
    q.awaitTermination(120)
    log = VersionLog(spark, f"{root}/state", initial)
    beds = sorted(collect(log.tables().bed, "bed_no"))
    assert beds == [("B1",), ("B2",)]

    # a second batch sees the first one's accepted key; a replayed id is a no-op
    apply = batch_writer("bed", log)
    second = spark.createDataFrame([(3, "B2", "U1"), (4, "B3", "U2")], CAND)
    apply(second, 7)
    apply(second, 7)
    assert sorted(collect(log.tables().bed, "bed_no")) == [("B1",), ("B2",), ("B3",)]
    out = spark.read.parquet(log.latest_paths()["bed"].rsplit("/", 1)[0] + "/_outcome")
    assert dict(collect(out, "bed_no", "outcome")) == {"B2": "duplicate_key", "B3": "accepted"}
    assert log.entries().where("batch_id = 7").count() == 1


def test_two_entities_share_a_state_folder(spark):
    root = tempfile.mkdtemp(prefix="wardline-stream-")
    initial = {}
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(f"{root}/init/{name}")
        initial[name] = f"{root}/init/{name}"
    log = VersionLog(spark, f"{root}/state", initial)
    batch_writer("specialty", log)(
        spark.createDataFrame([(1, "Cardio")], "arrival_seq long, specialty_name string"), 0)
    batch_writer("bed", log)(spark.createDataFrame([(1, "B1", "U1")], CAND), 0)
    assert collect(log.tables().specialty) == [("Cardio",)]
    assert collect(log.tables().bed, "bed_no") == [("B1",)]
