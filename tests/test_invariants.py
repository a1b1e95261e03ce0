
from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from wardline.plans import ingest as I
from wardline.plans import reports as R
from wardline.sources.batches import scenario
from wardline.sources.schemas import KEYS

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.fixture(scope="module")
def world(spark):
    return scenario(spark, SF)


def test_keys_unique_in_derived_tables(world):
    full, _, _ = world
    for name, key in KEYS.items():
        df = full[name]
        assert df.count() == df.select(key).distinct().count(), name


def test_position_counts_cover_every_doctor(world):
    full, _, _ = world
    doctor_labels = full.doctor.select("position").distinct()
    rows = R.q12_position_counts(full).join(doctor_labels, "position", "left_semi")
    assert rows.agg(F.sum("staff_count")).first()[0] == full.doctor.count()


def test_strict_q4_within_literal(world):
    full, _, _ = world
    strict = R.q4_junior_patients(full, strict=True).where(
        F.col("staff_nurse_of_careunit").isNotNull())
    literal = R.q4_junior_patients(full)
    assert strict.exceptAll(literal).isEmpty()


@pytest.mark.parametrize("entity,key", [("specialty", "specialty_name"), ("ward", "ward_name"),
                                        ("bed", "bed_no"), ("patient", "patient_no"),
                                        ("doctor", "staff_no"), ("nurse", "staff_no")])
def test_ingest_partitions_candidates_and_keeps_keys_unique(world, entity, key):
    full, target, batches = world
    if entity == "patient":
        target = target.replace(bed=full.bed)
    job = getattr(I, f"ingest_{entity}")
    res = job(target, batches[entity])
    assert res.accepted.count() + res.rejected.count() == batches[entity].count()
    snap = res.snapshots[entity]
    assert snap.count() == snap.select(key).distinct().count()
    assert snap.count() == target[entity].count() + res.accepted.count()
    if entity == "patient":
        occupied = res.snapshots["bed"].where("is_occupied = 1").select("bed_no")
        accepted_beds = res.accepted.select("bed_no").join(full.bed.select("bed_no"), "bed_no",
                                                           "left_semi")
        assert accepted_beds.exceptAll(occupied).distinct().isEmpty()
