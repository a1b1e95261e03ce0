"""Snapshots, JSON export and the bucketed layout."""

from __future__ import annotations

import contextlib
import io
import json
import os
import tempfile

import pytest
from conftest import collect, d

from wardline.plans import reports as R
from wardline.sources.store import (
    export_text,
    load_catalog,
    load_tables,
    save_bucketed,
    save_tables,
    write_json,
    write_snapshot,
)

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_snapshot_roundtrip_and_no_overwrite(make_tables, spark):
    t = make_tables(patient=[("P1", "Pat", d("1990-01-02"), None, "U1", "B1")])
    root = tempfile.mkdtemp(prefix="wardline-store-")
    save_tables(t, f"{root}/v1")
    back = load_tables(spark, f"{root}/v1")
    assert collect(back.patient) == collect(t.patient)
    with pytest.raises(Exception):
        write_snapshot(t.patient, f"{root}/v1/patient")


def test_json_lines_with_date_text(make_tables, spark):
    t = make_tables(care_unit=[("U1", "W1"), ("U2", "W1"), ("U3", "W2")],
                    patient=[("P1", "Pat", d("1990-01-02"), None, "U1", "B1")])
    root = tempfile.mkdtemp(prefix="wardline-json-")
    write_json(t.care_unit, f"{root}/units", partition_by="ward_name")
    assert sorted(os.listdir(f"{root}/units"))[-2:] == ["ward_name=W1", "ward_name=W2"]
    write_json(t.patient, f"{root}/patients")
    text = "".join(open(os.path.join(f"{root}/patients", f)).read()
                   for f in os.listdir(f"{root}/patients") if f.endswith(".json"))
    assert json.loads(text.strip())["date_of_birth"] == "1990-01-02"
    assert collect(export_text(t.patient), "date_of_birth") == [("1990-01-02",)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_bucketed_layout_removes_fact_shuffle_on_patient(spark):
    from wardline.sources.fixtures import build_tables
    save_bucketed(build_tables(spark, SF), "wl_bucket_test", 4)
    t = load_catalog(spark, "wl_bucket_test")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    try:
        plan = _plan(R.q7_multi_complaint(t))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Bucketed: true" in plan
    stats = spark.sql("DESCRIBE TABLE EXTENDED wl_bucket_test.patient").where(
        "col_name = 'Statistics'").collect()
    assert stats and "rows" in stats[0]["data_type"]
    assert "hashpartitioning(patient_no" not in plan
    assert R.q7_multi_complaint(t).count() == R.q7_multi_complaint(build_tables(spark, SF)).count()


def test_views_ignore_case_and_bind_parameters(make_tables, spark):
    t = make_tables(
        doctor=[("D1", "Cara", "consultant", None, "X", None), ("D2", "Bob", "", None, "X", "D1")],
        progress=[(1, "D2", "E", "p", d("2024-01-01"), "A"), (2, "D1", "E", "p", d("2024-01-02"), "B")])
    t.register_views()
    rows = spark.sql("""
        SELECT STAFF_NO, max(Performance_Grade) AS best FROM Progress
        WHERE staff_no = :staff GROUP BY Staff_No""", args={"staff": "D2"}).collect()
    assert [tuple(r) for r in rows] == [("D2", "A")]
    from wardline.plans.reports import q9_doctor_performance
    assert q9_doctor_performance(t, "D2").select("performance_grade").collect()[0][0] == "A"
