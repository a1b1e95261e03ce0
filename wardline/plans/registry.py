"""Registered jobs: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.columns import key_number
from wardline.operators.ids import assign_ids
from wardline.operators.joins import stored_bytes
from wardline.oracle import Q11_PARAMS
from wardline.plans import ingest as I
from wardline.plans import listings as L
from wardline.plans import records as C
from wardline.plans import reports as R
from wardline.plans.audit import audit_integrity
from wardline.plans.sql_reports import run_sql, team_activity
from wardline.session import scratch_path, size_shuffles, statistics_session, tune
from wardline.sources.batches import scenario
from wardline.sources.catalog import Tables, plain
from wardline.sources.fixtures import build_tables, read_sources
from wardline.sources.partitioned import PartitionedTable
from wardline.sources.schemas import SCHEMAS
from wardline.sources.store import (
    export_text,
    json_rows,
    load_catalog,
    load_counted,
    load_monthly_facts,
    save_bucketed,
    save_monthly_facts,
    save_tables,
)
from wardline.sources.variants import faulty, mixed_spelling, respelled

Job = Callable[[Tables], DataFrame]

JOBS: dict[str, Job] = {
    "q1_consultant_teams": R.q1_consultant_teams,
    "q2_ward_staffing": R.q2_ward_staffing,
    "q3_patient_treatments": R.q3_patient_treatments,
    "q4_junior_patients": R.q4_junior_patients,
    "q4_junior_patients_strict": lambda t: R.q4_junior_patients(t, strict=True),
    "q5_unique_specialty": R.q5_unique_specialty,
    "q6_treatment_experience": R.q6_treatment_experience,
    "q7_multi_complaint": R.q7_multi_complaint,
    "q7_multi_complaint_10": lambda t: R.q7_multi_complaint(t, min_distinct=10),
    "q8_by_complaint_treatment": R.q8_by_complaint_treatment,
    "q9_doctor_performance": R.q9_doctor_performance,
    "q10_patient_full": R.q10_patient_full,
    "q11_complaint_daterange": lambda t: R.q11_complaint_daterange(
        t, Q11_PARAMS["complaint_code"], Q11_PARAMS["date_from"], Q11_PARAMS["date_to"]),
    "q12_position_counts": R.q12_position_counts,
    "rec_patient_header": C.rec_patient_header,
    "rec_patient_history": C.rec_patient_history,
    "rec_ward_header": C.rec_ward_header,
    "rec_ward_nurses": C.rec_ward_nurses,
    "rec_ward_patients": C.rec_ward_patients,
    "rec_doctor_header": C.rec_doctor_header,
    "rec_doctor_experience": C.rec_doctor_experience,
    "rec_doctor_progress": C.rec_doctor_progress,
    "rec_team_latest_grade": C.rec_team_latest_grade,
    "dash_totals": L.dash_totals,
    "dash_recent_admissions": L.dash_recent_admissions,
    "dash_specialty_overview": L.dash_specialty_overview,
    "list_specialties": L.list_specialties,
    "list_ward_units": L.list_ward_units,
    "list_unit_beds": L.list_unit_beds,
    "list_beds": L.list_beds,
    "list_patients": L.list_patients,
    "list_doctors": L.list_doctors,
    "list_nurses": L.list_nurses,
    "lk_wards": L.lk_wards,
    "lk_consultants": L.lk_consultants,
    "lk_patients": L.lk_patients,
    "lk_complaints": L.lk_complaints,
    "lk_care_units": L.lk_care_units,
    "lk_doctors": L.lk_doctors,
    "units_by_ward": L.units_by_ward,
    "free_beds_by_unit": L.free_beds_by_unit,
    "next_ids": L.next_ids,
}

# Jobs for a set of keys, with the name of that parameter (None: every key).
KEYED_JOBS: dict[str, str] = {
    "q9_doctor_performance": "staff_nos",
    "q10_patient_full": "patient_nos",
    "rec_patient_header": "patient_nos",
    "rec_patient_history": "patient_nos",
    "rec_ward_header": "ward_names",
    "rec_ward_nurses": "ward_names",
    "rec_ward_patients": "ward_names",
    "rec_doctor_header": "staff_nos",
    "rec_doctor_experience": "staff_nos",
    "rec_doctor_progress": "staff_nos",
    "rec_team_latest_grade": "consultant_nos",
}
# One key each, as the reference's pages ask for, and a table of keys.
ONE_KEY = {"staff_nos": "DOC-007", "patient_nos": "PAT-011", "ward_names": "WARD_7",
           "consultant_nos": "DOC-006"}


def _one(name: str) -> Job:
    key = ONE_KEY[KEYED_JOBS[name]]
    return lambda t: JOBS[name](t, **{KEYED_JOBS[name]: key})


JOBS.update({f"{name}_one": _one(name) for name in list(KEYED_JOBS)})
JOBS.update({
    "q9_doctor_performance_of_registrars": lambda t: R.q9_doctor_performance(
        t, t.doctor.where("position = 'registrar(r)'").select("staff_no")),
    "q10_patient_full_of_ward": lambda t: R.q10_patient_full(
        t, t.patient.join(t.care_unit.where("ward_name = 'WARD_7'"), "care_unit_no").select("patient_no")),
    "units_by_ward_json": lambda t: json_rows(L.units_by_ward(t), "ward_name"),
    "free_beds_by_unit_json": lambda t: json_rows(L.free_beds_by_unit(t), "care_unit_no"),
    "list_patients_text": lambda t: export_text(L.list_patients(t)),
})


COLLATION = "UTF8_LCASE_RTRIM"  # letter case and trailing spaces make no difference
_Q11_DATES = {name: date.fromisoformat(Q11_PARAMS[name]) for name in ("date_from", "date_to")}

# Integrity, other spellings of keys, and reports as SQL text.
JOBS.update({
    "audit_integrity": audit_integrity,
    "audit_integrity_faults": lambda t: audit_integrity(faulty(t)),
    "audit_integrity_collated": lambda t: audit_integrity(faulty(t), COLLATION),
    "q3_patient_treatments_collated": lambda t: plain(
        R.q3_patient_treatments(mixed_spelling(t).collated(COLLATION))),
    "q9_doctor_performance_collated": lambda t: plain(
        R.q9_doctor_performance(mixed_spelling(t).collated(COLLATION))),
    "q9_doctor_performance_sql": lambda t: run_sql(t, "doctor_performance", staff_no=ONE_KEY["staff_nos"]),
    "q11_complaint_daterange_sql": lambda t: run_sql(
        t, "complaint_daterange", complaint_code=Q11_PARAMS["complaint_code"], **_Q11_DATES),
    "team_activity_sql": lambda t: team_activity(
        t, ONE_KEY["consultant_nos"], Q11_PARAMS["date_from"], Q11_PARAMS["date_to"]),
})


# Jobs that first store tables in a layout of their own: (tables, fresh path) -> result.
StoredJob = Callable[[Tables, str], DataFrame]
COUNTED = ("patient", "doctor", "nurse", "ward", "bed", "specialty")
Q7_TABLES = ("ptr", "patient", "complaint", "treatment")
Q10_TABLES = (*Q7_TABLES, "doctor", "consultant", "care_unit", "ward")


def _only(t: Tables, names: Iterable[str]) -> Tables:
    return Tables({name: t[name] for name in names})


def _spark(t: Tables) -> SparkSession:
    return t.ptr.sparkSession


def dash_totals_counted(t: Tables, path: str) -> DataFrame:
    """The dashboard's counts, answered from Parquet footers."""
    save_tables(_only(t, COUNTED), path)
    return L.dash_totals(load_counted(_spark(t), path, COUNTED))


def q11_monthly(t: Tables, path: str) -> DataFrame:
    """Q11 over facts stored by month."""
    save_monthly_facts(t.ptr, path)
    return JOBS["q11_complaint_daterange"](t.replace(ptr=load_monthly_facts(_spark(t), path)))


def _catalog(t: Tables, names: Iterable[str], path: str, reader: SparkSession | None = None) -> Tables:
    database = path.rsplit("/", 1)[-1].replace("-", "_")
    buckets = int(_spark(t).conf.get("spark.sql.shuffle.partitions"))
    save_bucketed(_only(t, names), database, buckets, location=path)
    return load_catalog(reader or _spark(t), database, names)


def q7_bucketed(t: Tables, path: str) -> DataFrame:
    """Q7 over catalog tables bucketed by patient: the facts are not shuffled to be counted."""
    return R.q7_multi_complaint(_catalog(t, Q7_TABLES, path))


def q10_catalog(t: Tables, path: str) -> DataFrame:
    """Q10 as SQL text over catalog tables, its joins ordered by their statistics."""
    return run_sql(_catalog(t, Q10_TABLES, path, statistics_session(_spark(t))), "patient_full", ward_name=None)


STORED_JOBS: dict[str, StoredJob] = {
    "dash_totals_counted": dash_totals_counted,
    "q11_complaint_daterange_monthly": q11_monthly,
    "q7_multi_complaint_bucketed": q7_bucketed,
    "q10_patient_full_catalog": q10_catalog,
}


ScenarioJob = Callable[[Tables, Tables, dict], DataFrame]


def _nurse_roles(full: Tables, target: Tables, b: dict) -> DataFrame:
    """New role-table snapshots after the nurse batch, tagged by table."""
    return I.nurse_role_rows(target, I.ingest_nurse(target, b["nurse"]))


def _outcome_counts(full: Tables, target: Tables, b: dict) -> DataFrame:
    """entity, outcome, n: the messages of all six batches, counted."""
    return reduce(DataFrame.unionByName, [
        ingest(target, b[entity]).outcome.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(entity).alias("entity"), "outcome", "n") for entity, ingest in INGESTERS.items()])


def _doctors_collated(full: Tables, target: Tables, b: dict) -> DataFrame:
    """The doctor batch against a target and with candidates whose keys are spelled otherwise."""
    stored = target.replace(doctor=target.doctor.withColumn("staff_no", respelled(
        F.col("staff_no"), key_number(F.col("staff_no"), "DOC"))))
    batch = b["doctor"].withColumn("staff_no", respelled(F.col("staff_no"), F.col("arrival_seq")))
    return I.ingest_doctor(stored.collated(COLLATION), batch).outcome


def _occupancy_partitioned(full: Tables, target: Tables, b: dict) -> DataFrame:
    """BED after the patient batch, kept in partitions of which the batch rewrites some."""
    spark = full.bed.sparkSession
    path = scratch_path(spark, "beds")
    store = PartitionedTable(f"{path}/bed", SCHEMAS["bed"], "bed_no",
                             4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    store.save(full.bed)
    result = I.ingest_patient(target.replace(bed=full.bed), b["patient"])
    result.update({"bed": store}, f"{path}/batch")
    return store.read(spark)


INGESTERS: dict[str, Callable[[Tables, DataFrame], I.IngestResult]] = {
    "specialty": I.ingest_specialty, "ward": I.ingest_ward, "bed": I.ingest_bed,
    "patient": I.ingest_patient, "doctor": I.ingest_doctor, "nurse": I.ingest_nurse,
}


def _assign_patient_ids(full: Tables, target: Tables, b: dict) -> DataFrame:
    arrivals = full.patient.select(
        F.substring("patient_no", 5, 99).try_cast("long").alias("arrival_seq"),
        "patient_name").where(F.col("arrival_seq") % 10 >= 8)
    return assign_ids(arrivals, target.patient, "patient_no", "PAT", ["arrival_seq"])


SCENARIO_JOBS: dict[str, ScenarioJob] = {
    "ingest_specialty": lambda f, t, b: I.ingest_specialty(t, b["specialty"]).outcome,
    "ingest_ward": lambda f, t, b: I.ingest_ward(t, b["ward"]).outcome,
    "ingest_bed": lambda f, t, b: I.ingest_bed(t, b["bed"]).outcome,
    "ingest_patient": lambda f, t, b: I.ingest_patient(t.replace(bed=f.bed), b["patient"]).outcome,
    "ingest_doctor": lambda f, t, b: I.ingest_doctor(t, b["doctor"]).outcome,
    "ingest_nurse": lambda f, t, b: I.ingest_nurse(t, b["nurse"]).outcome,
    "bed_occupancy_update": lambda f, t, b: I.ingest_patient(
        t.replace(bed=f.bed), b["patient"]).snapshots["bed"],
    "ingest_doctor_consultants": lambda f, t, b: I.ingest_doctor(
        t, b["doctor"]).snapshots["consultant"],
    "ingest_nurse_roles": _nurse_roles,
    "assign_ids": _assign_patient_ids,
    "ingest_outcome_counts": _outcome_counts,
    "ingest_doctor_collated": _doctors_collated,
    "bed_occupancy_partitioned": _occupancy_partitioned,
}


def _sized(spark: SparkSession, sf_dir: str) -> SparkSession:
    """The session with its settings, and shuffles sized for the source files."""
    tune(spark)
    size_shuffles(spark, sum(stored_bytes(df) for df in read_sources(spark, sf_dir).values()))
    return spark


def _bind_scenario(job: ScenarioJob) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        full, target, batches = scenario(_sized(spark, sf_dir), sf_dir)
        return job(full, target, batches)

    return run


def _bind(job: Job) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return job(build_tables(_sized(spark, sf_dir), sf_dir))

    run.__doc__ = job.__doc__
    return run


def _bind_stored(name: str, job: StoredJob) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return job(build_tables(_sized(spark, sf_dir), sf_dir), scratch_path(spark, f"wardline-{name}"))

    run.__doc__ = job.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _bind(job) for name, job in JOBS.items()}
    out.update({name: _bind_scenario(job) for name, job in SCENARIO_JOBS.items()})
    out.update({name: _bind_stored(name, job) for name, job in STORED_JOBS.items()})
    return out
