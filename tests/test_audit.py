"""Integrity audit, collated keys, observed outcome counts, partitioned targets, SQL text."""

from __future__ import annotations

import os

import pytest
from conftest import collect, d
from pyspark.sql import functions as F

from wardline.plans import ingest as I
from wardline.plans import records as C
from wardline.plans.audit import RULES, audit_integrity
from wardline.plans.sql_reports import register_functions, run_sql, team_activity
from wardline.sources.catalog import plain
from wardline.sources.partitioned import PART, PartitionedTable
from wardline.sources.schemas import SCHEMAS

CI = "UTF8_LCASE_RTRIM"


def broken(df):
    return {(r.table_name, r.column_name, r.rule): (r.n_rows, r.n_keys, r.example_key)
            for r in df.collect() if r.n_rows}


@pytest.fixture
def hospital(make_tables):
    return make_tables(
        specialty=[("S",), ("S",), (None,)],
        ward=[("W1", "S", 1), ("W2", "s ", 1)],
        care_unit=[("U1", "W1"), ("U2", "W2")],
        bed=[("B1", "U1", 0), ("B2", "U2", 0)],
        patient=[("P1", "A", None, None, "U1", "B1"), ("P1", "A", None, None, "U1", "B2"),
                 ("p1 ", "A", None, None, "U9", None)],
        doctor=[("D1", "Ann", "", None, "S", None), ("D2", "Bo", "", None, "S", "d1")],
        nurse=[("N1", "N", "W2", "U1"), ("N2", "N", "W1", "U1"), ("N3", "N", "w2", "U1")],
        ptr=[("P1", "C", "T", "D1", None, None)] * 3 + [("P7", "C", "T", None, None, None)])


def test_audit_names_every_rule_and_counts(hospital):
    report = audit_integrity(hospital)
    assert collect(report.select("table_name", "column_name", "rule")) == sorted(RULES)
    found = broken(report)
    assert found[("specialty", "specialty_name", "duplicate_key")] == (1, 1, "S")
    assert found[("specialty", "specialty_name", "null_key")] == (1, 0, None)
    assert found[("patient", "patient_no", "duplicate_key")] == (1, 1, "P1")
    assert found[("ward", "specialty_name", "orphan")] == (1, 1, "s ")
    assert found[("patient", "care_unit_no", "orphan")] == (1, 1, "U9")
    assert found[("patient", "bed_no", "null_reference")] == (1, 0, None)
    assert found[("patient", "bed_no", "bed_of_other_unit")] == (1, 1, "B2")
    assert found[("doctor", "consultant_staff_no", "orphan")] == (1, 1, "d1")
    assert found[("nurse", "care_unit_no", "unit_of_other_ward")] == (2, 1, "U1")
    assert found[("nurse", "ward_name", "orphan")] == (1, 1, "w2")
    assert found[("ptr", "patient_no", "orphan")] == (1, 1, "P7")
    assert found[("ptr", "treatment_code", "orphan")] == (4, 1, "T")
    assert found[("ptr", "doctor_staff_no", "null_reference")] == (1, 0, None)
    assert len(found) == 14  # and complaints without a code


def test_audit_under_a_collation(hospital):
    found = broken(audit_integrity(hospital, CI))
    assert found[("patient", "patient_no", "duplicate_key")] == (2, 1, "p1")
    assert ("ward", "specialty_name", "orphan") not in found
    assert ("doctor", "consultant_staff_no", "orphan") not in found
    assert found[("nurse", "care_unit_no", "unit_of_other_ward")] == (2, 1, "u1")


def test_audit_of_empty_tables(make_tables):
    assert broken(audit_integrity(make_tables())) == {}


DOC_COLS = ("arrival_seq long, staff_no string, name string, position string, date_joined string,"
            " specialty_name string, consultant_staff_no string, is_consultant boolean")


def doctor(seq, key, flag=False):
    return seq, key, "Name", "", "", "S", "", flag


def test_collated_key_check(make_tables, spark):
    t = make_tables(doctor=[("DOC-001 ", "Ann", "", None, "S", None)], consultant=[("doc-002",)])
    batch = spark.createDataFrame([doctor(1, "doc-001"), doctor(2, "Doc-002", True), doctor(3, "DOC-002"),
                                   doctor(4, "DOC-003")], DOC_COLS)
    exact = dict(collect(I.ingest_doctor(t, batch).outcome, "arrival_seq", "outcome"))
    assert exact == {1: "accepted", 2: "accepted", 3: "accepted", 4: "accepted"}
    res = I.ingest_doctor(t.collated(CI), batch)
    assert dict(collect(res.outcome, "arrival_seq", "outcome")) == {
        1: "duplicate_key", 2: "accepted", 3: "duplicate_key", 4: "accepted"}
    assert sorted(r[0] for r in collect(res.snapshots["doctor"], "staff_no")) == ["DOC-001 ", "DOC-003", "Doc-002"]
    assert collect(res.snapshots["consultant"]) == [("doc-002",)]


def test_collated_joins_keep_spelling(make_tables):
    t = make_tables(doctor=[("DOC-001", "Ann", "", None, "S", None)],
                    progress=[(1, "doc-001 ", "E", "p", d("2024-01-01"), "A")])
    assert C.rec_doctor_progress(t).count() == 0
    got = plain(C.rec_doctor_progress(t.collated(CI)))
    assert collect(got, "staff_no", "performance_grade") == [("doc-001 ", "A")]
    assert dict(got.dtypes)["staff_no"] == "string"


PAT_COLS = ("arrival_seq long, patient_no string, patient_name string, dob string, date_admitted string,"
            " care_unit_no string, bed_no string")


@pytest.fixture
def admission(make_tables, spark):
    t = make_tables(bed=[(f"B{i}", "U1", 0) for i in range(60)],
                    patient=[(f"P{i}", "Pat", None, None, "U1", f"B{i}") for i in range(40)])
    rows = [(1, "P3", "Dup", "", "", "U1", "B7"), (2, "P90", " ", "", "", "U1", "B8"),
            (3, "P90", "New", "", "", "U1", "B50"), (None, "P91", "New", "", "", "U1", "B51"),
            (5, "P92", "Bad", "1990-99-01", "", "U1", "B52"), (6, "P93", "New", "", "", "U1", "B7")]
    return t, I.ingest_patient(t, spark.createDataFrame(rows, PAT_COLS))


COUNTS = {"accepted": 2, "missing_required": 1, "missing_sequence": 1, "invalid_value": 1, "duplicate_key": 1}


def test_write_counts_outcomes_without_another_job(admission, spark, tmp_path):
    _, result = admission
    tracker = spark.sparkContext.statusTracker()

    def jobs(name, action):
        spark.sparkContext.setJobGroup(name, name)
        try:
            return action(), len(tracker.getJobIdsForGroup(name))
        finally:
            spark.sparkContext.setJobGroup("", "")

    written, counted = jobs("counted", lambda: result.write(str(tmp_path / "a")))
    assert written.counts == COUNTS

    def without_counts():
        result.outcome.write.parquet(str(tmp_path / "b/_outcome"))
        stored = spark.read.schema(result.outcome.schema).parquet(str(tmp_path / "b/_outcome"))
        for name, df in I.IngestResult(stored, result.changes).snapshots.items():
            df.write.parquet(str(tmp_path / f"b/{name}"))

    assert counted == jobs("uncounted", without_counts)[1]


def files(path):
    return {f"{folder.rsplit('/', 1)[-1]}/{name}": os.stat(f"{folder}/{name}").st_mtime_ns
            for folder, _, names in os.walk(path) for name in names if name.startswith("part-")}


def test_update_rewrites_only_touched_partitions(admission, spark, tmp_path):
    t, result = admission
    stores = {name: PartitionedTable(str(tmp_path / name), SCHEMAS[name], key, 16)
              for name, key in (("patient", "patient_no"), ("bed", "bed_no"))}
    for name, store in stores.items():
        store.save(t[name])
        assert sorted(collect(store.read(spark))) == sorted(collect(t[name]))
    before = files(stores["bed"].path)
    want = {name: sorted(collect(df), key=str) for name, df in result.snapshots.items()}
    written = result.update(stores, str(tmp_path / "batch"))
    assert written.counts == COUNTS
    after = files(stores["bed"].path)
    touched = {f"{PART}={r[0]}" for r in spark.createDataFrame([("B50",), ("B7",)], "bed_no string").select(
        F.pmod(F.xxhash64("bed_no"), F.lit(16))).distinct().collect()}
    same = {f for f in before if after.get(f) == before[f]}
    assert {f.split("/")[0] for f in before if f not in same} == touched
    for name, store in stores.items():
        assert sorted(collect(store.read(spark)), key=str) == want[name]
    # an interrupted update is run again on the stored outcome
    stored = I.IngestResult(spark.read.parquet(str(tmp_path / "batch/_outcome")), result.changes)
    stored.update(stores, str(tmp_path / "again"))
    for name, store in stores.items():
        assert sorted(collect(store.read(spark)), key=str) == want[name]


def test_update_of_nothing_keeps_all_files(admission, spark, tmp_path):
    t, result = admission
    store = PartitionedTable(str(tmp_path / "bed"), SCHEMAS["bed"], "bed_no", 4)
    store.save(t.bed)
    before = files(store.path)
    none = I.IngestResult(result.outcome.where("false"), result.changes)
    assert none.update({"bed": store}, str(tmp_path / "batch")).counts["accepted"] == 0
    assert files(store.path) == before


def test_collated_partition_keys_are_refused(make_tables):
    with pytest.raises(ValueError):
        PartitionedTable("/x", make_tables().collated(CI).bed.schema, "bed_no", 4)


def test_sql_arguments_are_data(make_tables):
    t = make_tables(
        doctor=[("D1", "Cara", "consultant", None, "X", None), ("D'2", "Bob", "", None, "X", "D1")],
        progress=[(1, "D'2", "E", "p", d("2024-01-01"), "A"), (2, "D1", "E", "p", d("2024-01-02"), "B")])
    assert collect(run_sql(t, "doctor_performance", staff_no="D'2"), "performance_grade") == [("A",)]
    assert collect(run_sql(t, "doctor_performance", staff_no="' OR '1'='1")) == []


def test_parameterised_views(make_tables, spark):
    t = make_tables(
        doctor=[("D1", "Cara", "consultant", None, "X", "D1"), ("D2", "Bob", "sh", None, "X", "D1"),
                ("D3", "Al", "sh", None, "X", "D1"), ("D4", "Z", "sh", None, "X", "D9")],
        ptr=[("P1", "C", "T", "D2", d(x), None) for x in ("2024-01-01", "2024-01-31", "2024-02-01")])
    got = collect(team_activity(t, "D1", "2024-01-01", "2024-01-31"))
    assert got == [("D2", "Bob", 2), ("D3", "Al", 0)]
    names = register_functions(t, "own_")
    assert names == ["own_team_of", "own_treatments_between"]
    rows = spark.sql("SELECT count(*) FROM own_team_of(:c) WHERE position = 'sh'", args={"c": "D1"}).collect()
    assert rows[0][0] == 2
    assert collect(team_activity(t, "x' OR 'a'='a", "2024-01-01", "2024-01-31")) == []


def test_spellings_are_counted_before_collated_values_are_sorted(make_tables):
    """Rows of a table meet a hash aggregate of plain strings; a sort sees one row per spelling."""
    t = make_tables(specialty=[("eye",)] * 3 + [("EYE",), ("ear ",), (None,), (None,)])
    df = audit_integrity(t, "UTF8_LCASE_RTRIM")
    found = {tuple(r)[1:] for r in df.where("table_name = 'specialty'").collect()}
    assert found == {("specialty_name", "duplicate_key", 3, 1, "eye"), ("specialty_name", "null_key", 2, 0, None)}
    counts = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines()
              if "partial_count(1)" in line]
    assert counts and all("HashAggregate(" in line for line in counts)
