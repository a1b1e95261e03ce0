"""The three record forms (patient, ward, doctor/consultant team) as batch extracts.

The reference fetches one record per request; every job here takes one key,
a list, a DataFrame of keys or ``None`` (all records) and carries the key
column in its output so one run serves a full extract.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.columns import WARD_FORM_ROLE_FALLBACK, yes_no
from wardline.operators.aggregates import latest_by
from wardline.operators.joins import Keys, restrict, semi_join
from wardline.operators.roles import with_role_label
from wardline.operators.skew import salted_join
from wardline.sources.catalog import Tables


def _consultant_flag(t: Tables) -> DataFrame:
    """(staff_no, __cons) for the CONSULTANT table, for a Yes/No left join.

    A plain LEFT JOIN like the reference's (CONSULTANT is keyed by staff_no).
    """
    return t.consultant.select("staff_no", F.col("staff_no").alias("__cons"))


def rec_patient_header(t: Tables, patient_nos: Keys = None) -> DataFrame:
    return (
        restrict(t.patient, "patient_no", patient_nos)
        .join(t.dim("care_unit").select("care_unit_no", "ward_name"), "care_unit_no")
        .join(t.dim("ward").select("ward_name", "specialty_name"), "ward_name")
        .select("patient_no", "patient_name", "date_of_birth", "date_admitted", "care_unit_no",
                "bed_no", "ward_name", "specialty_name")
        .orderBy("patient_no", "care_unit_no", "bed_no"))


def rec_patient_history(t: Tables, patient_nos: Keys = None) -> DataFrame:
    doctors = t.doctor.join(_consultant_flag(t), "staff_no", "left").select(
        F.col("staff_no").alias("doctor_staff_no"), F.col("name").alias("doctor_name"),
        yes_no(F.col("__cons")).alias("is_consultant"))
    facts = restrict(t.ptr, "patient_no", patient_nos)
    # doctors is partitioned on staff_no by its flag join: hot doctors are
    # salted explicitly (AQE cannot split that join).
    return (
        salted_join(facts, doctors, "doctor_staff_no", dim_bound=t.doctor)
        .join(t.dim("complaint").select("complaint_code", F.col("description").alias("complaint")),
              "complaint_code")
        .join(t.treatment.select("treatment_code", F.col("description").alias("treatment")),
              "treatment_code")
        .select("patient_no", "complaint_code", "complaint", "treatment_code", "treatment",
                F.col("doctor_staff_no").alias("doctor_no"), "doctor_name", "is_consultant",
                "date_started", "date_ended")
        .orderBy("patient_no", "date_started", "complaint_code", "treatment_code", "doctor_no",
                 "date_ended"))


def rec_ward_header(t: Tables, ward_names: Keys = None) -> DataFrame:
    return restrict(t.ward, "ward_name", ward_names).select(
        "ward_name", "specialty_name", "number_of_care_units").orderBy("ward_name")


def rec_ward_nurses(t: Tables, ward_names: Keys = None) -> DataFrame:
    """Nurses of a ward with one role label (Day > Night > Staff > Non-Reg, else 'Nurse')."""
    nurses = restrict(t.nurse, "ward_name", ward_names).select(
        "ward_name", "staff_no", "name", "care_unit_no")
    return with_role_label(nurses, t, WARD_FORM_ROLE_FALLBACK,
                           narrow=ward_names is not None).select(
        "ward_name", "staff_no", "name", "care_unit_no", "role"
    ).orderBy("ward_name", "role", "name", "staff_no")


def rec_ward_patients(t: Tables, ward_names: Keys = None) -> DataFrame:
    """Patients of a ward, one row per treatment record (NULL doctor when none).

    The reference labels the treating doctor "Consultant_Name"; it is any
    doctor on the patient's records. One patient may own a large share of
    all records, so the record join runs as inner + anti join.
    """
    units = restrict(t.dim("care_unit"), "ward_name", ward_names).select(
        "care_unit_no", "ward_name")
    in_ward = t.patient.select(
        "patient_no", "patient_name", "care_unit_no", "bed_no", "date_admitted"
    ).join(units, "care_unit_no")
    doctors = t.doctor.select(F.col("staff_no").alias("doctor_staff_no"),
                              F.col("name").alias("consultant_name"))
    # The record's other columns only break ties in the sort, so that the rows of a
    # hot patient and doctor can go to several ranges.
    ties = ["date_started", "treatment_code", "complaint_code", "date_ended"]
    records = t.ptr.select("patient_no", "doctor_staff_no", *ties)
    if ward_names is not None:  # only the ward's patients matter, also for the anti join
        records = semi_join(records, in_ward.select("patient_no"), "patient_no")
    # Patients with records: one plain join of the fact on patient_no (AQE can
    # split a hot patient), then the doctor name by a left join whose hot
    # keys sit on the splittable left side. Patients without records: anti
    # join against the distinct record keys (collapsed map-side).
    treated = in_ward.join(records, "patient_no").join(doctors, "doctor_staff_no", "left")
    untreated = in_ward.join(records.select("patient_no").distinct(), "patient_no", "left_anti")
    untreated = untreated.select(*in_ward.columns, *[
        F.lit(None).cast(f.dataType).alias(f.name)
        for f in treated.schema.fields if f.name in ("consultant_name", *ties)])
    columns = ["ward_name", "patient_no", "patient_name", "care_unit_no", "bed_no",
               "date_admitted", "consultant_name"]
    return (
        treated.select(*columns, *ties).unionByName(untreated)
        .orderBy("ward_name", "patient_no", "consultant_name", *ties)
        .select(*columns))


def rec_doctor_header(t: Tables, staff_nos: Keys = None) -> DataFrame:
    return (
        restrict(t.doctor, "staff_no", staff_nos)
        .join(_consultant_flag(t), "staff_no", "left")
        .select("staff_no", "name", "position", "date_joined_team", "specialty_name",
                yes_no(F.col("__cons")).alias("is_consultant"))
        .orderBy("staff_no"))


def rec_doctor_experience(t: Tables, staff_nos: Keys = None) -> DataFrame:
    """Previous experience of existing doctors (the form shows it for both branches)."""
    doctors = restrict(t.doctor, "staff_no", staff_nos).select("staff_no")
    return (
        restrict(t.previous_experience, "staff_no", staff_nos)
        .join(doctors, "staff_no", "left_semi")
        .select("staff_no", "exp_id", "from_date", "to_date", "establishment", "position")
        .orderBy("staff_no", "from_date", "exp_id"))


def rec_doctor_progress(t: Tables, staff_nos: Keys = None) -> DataFrame:
    doctors = restrict(t.doctor, "staff_no", staff_nos).select("staff_no")
    return (
        restrict(t.progress, "staff_no", staff_nos)
        .join(doctors, "staff_no", "left_semi")
        .select("staff_no", "progress_id", "establishment", "position", "date",
                "performance_grade")
        .orderBy("staff_no", "date", "progress_id"))


def latest_grades(t: Tables) -> DataFrame:
    """(staff_no, latest_grade): grade of the latest progress row; ties -> larger progress_id."""
    return latest_by(t.progress, "staff_no", "performance_grade", ["date", "progress_id"],
                     "latest_grade")


def rec_team_latest_grade(t: Tables, consultant_nos: Keys = None) -> DataFrame:
    """Team members of consultants (CONSULTANT table) with their latest grade.

    The correlated ``TOP 1 ... ORDER BY Date DESC`` becomes one ``max_by``
    aggregate over PROGRESS and a left join (NULL when a member has none).
    """
    consultants = restrict(t.doctor, "staff_no", consultant_nos).select("staff_no").join(
        t.consultant, "staff_no", "left_semi").withColumnRenamed("staff_no", "consultant_no")
    members = (
        t.doctor.where(F.col("consultant_staff_no").isNotNull()
                       & (F.col("staff_no") != F.col("consultant_staff_no")))
        .withColumnRenamed("consultant_staff_no", "consultant_no"))
    # a consultant may lead a large share of the doctors: salted (staff_no is unique)
    members = salted_join(members, consultants.distinct(), "consultant_no", dim_bound=t.doctor)
    return (
        members.join(latest_grades(t), "staff_no", "left")
        .select("consultant_no", "staff_no", "name", "position", "date_joined_team",
                "specialty_name", "latest_grade")
        .orderBy("consultant_no", "position", "name", "staff_no"))
