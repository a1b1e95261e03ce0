"""Plan properties the performance design relies on (guards against regressions)."""

from __future__ import annotations

import contextlib
import io
import os
import re
import tempfile

import pytest

from wardline.plans import listings as L
from wardline.plans import reports as R
from wardline.plans import registry
from wardline.plans.sql_reports import run_sql
from wardline.session import STATISTICS, use_statistics
from wardline.sources.fixtures import build_tables
from wardline.sources.store import load_counted, load_monthly_facts, load_tables, save_monthly_facts, save_tables

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.fixture(scope="module")
def stored(spark):
    root = tempfile.mkdtemp(prefix="wardline-plans-")
    save_tables(build_tables(spark, SF), f"{root}/tables")
    return load_tables(spark, f"{root}/tables")


def plan(df, mode: str = "simple") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def scan_lines(text: str, table: str) -> list[str]:
    """Detail blocks of the Parquet scans of ``table`` in a formatted plan."""
    blocks = re.split(r"\n(?=\(\d+\) )", text)
    return [b for b in blocks if b.split("\n", 1)[0].strip().endswith("Scan parquet")
            and f"/{table}]" in b]


def test_q11_predicates_reach_the_fact_scan(stored):
    text = plan(R.q11_complaint_daterange(stored, "CMP-007", "1996-01-01", "1996-12-31"),
                "formatted")
    (ptr,) = scan_lines(text, "ptr")
    assert "EqualTo(complaint_code,CMP-007)" in ptr
    assert "GreaterThanOrEqual(date_started" in ptr and "LessThanOrEqual(date_started" in ptr


def test_column_pruning(stored):
    (doctor,) = scan_lines(plan(R.q12_position_counts(stored), "formatted"), "doctor")
    assert re.search(r"ReadSchema: struct<position:string>", doctor)
    text = plan(R.q7_multi_complaint(stored), "formatted")
    for line in scan_lines(text, "ptr"):
        assert "doctor_staff_no" not in line  # Q7 never needs the doctor column


def test_q4_fan_out_is_not_shuffled_when_nurses_are_small(stored):
    text = plan(R.q4_junior_patients(stored))
    ranges = [ln for ln in text.splitlines() if "Exchange rangepartitioning" in ln]
    assert len(ranges) == 1 and "REPARTITION_BY_NUM" in ranges[0]


def test_top_k_is_take_ordered(stored):
    assert "TakeOrderedAndProject" in plan(L.dash_recent_admissions(stored))


def test_small_dimension_is_broadcast_after_check(stored):
    text = plan(R.q3_patient_treatments(stored), "formatted")
    assert "BroadcastExchange" in text
    assert scan_lines(text, "complaint")


def test_building_a_job_starts_no_spark_job(spark):
    """Every registered DataFrame is lazy, but for those that store something first."""
    from wardline.plans.registry import STORED_JOBS, queries

    started = []
    for name, job in queries().items():
        if name in ("assign_ids", "bed_occupancy_partitioned", *STORED_JOBS):
            continue
        spark.sparkContext.setJobGroup(f"build-{name}", name)
        try:
            job(spark, SF)
        finally:
            spark.sparkContext.setJobGroup("", "")
        if spark.sparkContext.statusTracker().getJobIdsForGroup(f"build-{name}"):
            started.append(name)
    assert started == []


def test_counts_come_from_file_footers(spark):
    root = tempfile.mkdtemp(prefix="wardline-counted-")
    save_tables(build_tables(spark, SF), f"{root}/tables")
    counted = load_counted(spark, f"{root}/tables")
    totals = L.dash_totals(counted)
    assert plan(totals).count("PushedAggregation: [COUNT(*)]") == 6
    assert sorted(totals.collect()) == sorted(L.dash_totals(load_tables(spark, f"{root}/tables")).collect())
    # other paths are read as before
    assert "BatchScan" not in plan(L.dash_totals(load_tables(spark, f"{root}/tables")))


def test_monthly_facts_prune_at_both_ends(spark, stored):
    root = tempfile.mkdtemp(prefix="wardline-monthly-")
    save_monthly_facts(stored.ptr, f"{root}/ptr")
    monthly = stored.replace(ptr=load_monthly_facts(spark, f"{root}/ptr"))
    first, last = "1996-01-31", "1996-03-01"
    df = R.q11_complaint_daterange(monthly, "CMP-007", first, last)
    filters = re.search(r"PartitionFilters: \[isnotnull\(start_month[^]]*\]", plan(df)).group(0)
    assert ">= 199601" in filters and "<= 199603" in filters
    read = df._jdf.queryExecution().executedPlan()
    df.collect()
    files = re.search(r"number of partitions read: (\d+)", read.toString()) or None
    assert files is None or int(files.group(1)) == 3
    assert df.collect() == R.q11_complaint_daterange(stored, "CMP-007", first, last).collect()
    # the days at both ends count
    for day in (first, last):
        one = R.q11_complaint_daterange(monthly, None, day, day)
        assert one.count() == stored.ptr.where(f"date_started = DATE '{day}'").count()


def test_catalog_statistics_order_the_joins(spark, stored):
    root = tempfile.mkdtemp(prefix="wardline-cbo-")
    tables = registry._catalog(stored, registry.Q10_TABLES, f"{root}/wl_cbo_test")

    def order(df) -> list[str]:
        text = df._jdf.queryExecution().optimizedPlan().toString()
        return re.findall(r"Relation spark_catalog\.\w+\.(\w+)", text)

    written = order(run_sql(tables, "patient_full", ward_name=None))
    use_statistics(spark)
    try:
        df = run_sql(tables, "patient_full", ward_name=None)
        planned = order(df)
        assert "rowCount=" in plan(df, "cost")
        rows = df.collect()
    finally:
        for key in STATISTICS:
            spark.conf.unset(key)
    assert sorted(planned) == sorted(written) and planned != written
    # wards and units meet the patients before the facts do
    assert planned.index("care_unit") < planned.index("patient")
    assert rows == R.q10_patient_full(stored).select(df.columns).collect()


def test_bucketed_q7_counts_without_a_shuffle_of_the_facts(spark, stored):
    root = tempfile.mkdtemp(prefix="wardline-q7-")
    text = plan(registry.q7_bucketed(stored, f"{root}/wl_q7_test"))
    assert "hashpartitioning(patient_no" not in text
    assert re.search(r"ptr\[patient_no#\d+,complaint_code#\d+\][^\n]*Bucketed: true", text)


def test_doctor_joins_are_bounded_by_doctor(stored):
    """Q10, the history form and Q6 broadcast what a small DOCTOR or EXPERIENCE bounds."""
    from wardline.plans import records as C

    for df in (R.q10_patient_full(stored), C.rec_patient_history(stored), R.q6_treatment_experience(stored)):
        text = plan(df)
        assert "__salt" not in text and "SortMergeJoin" not in text


def test_a_table_of_patients_is_measured_and_not_met_by_a_shuffle_of_the_facts(stored):
    keys = stored.patient.join(stored.care_unit.where("ward_name = 'WARD_7'"), "care_unit_no").select("patient_no")
    df = R.q10_patient_full(stored, keys)
    listed = R.q10_patient_full(stored, [r.patient_no for r in keys.collect()])
    rows = df.collect()
    assert rows and rows == listed.collect()
    ran = plan(df)
    assert re.search(r"BroadcastHashJoin \[patient_no#\d+\], \[patient_no#\d+\], LeftSemi", ran)
    assert "Subquery" in ran


def test_q10_catalog_leaves_the_settings_of_the_session(spark, stored):
    before = {key: spark.conf.get(key, None) for key in STATISTICS}
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    df = registry.q10_catalog(stored, tempfile.mkdtemp(prefix="wardline-cbo-") + "/wl_cbo_own")
    assert {key: spark.conf.get(key, None) for key in STATISTICS} == before
    assert df.sparkSession.conf.get("spark.sql.cbo.enabled") == "true"
    assert df.sparkSession.conf.get("spark.sql.shuffle.partitions") == parts
    assert df.collect() == R.q10_patient_full(stored).select(df.columns).collect()
