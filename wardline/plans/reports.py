"""The twelve named reports (Q1-Q12), Spark-first.

Each job takes ``Tables`` plus parameters and returns a lazy, ordered
DataFrame. Parameterised reports take one key, a list of keys, a DataFrame
of keys, or ``None`` for the full batch extract over the whole table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.columns import (
    JUNIOR_POSITIONS,
    NURSE_ROLES,
    POSITION_COUNT_LABELS,
    yes_no,
)
from wardline.operators.joins import (
    Keys,
    expand_in_order,
    left_join_hot_right,
    provably_small,
    restrict,
)
from wardline.operators.roles import role_rows
from wardline.operators.skew import salted_join
from wardline.sources.catalog import Tables
from wardline.sources.store import MONTH, month_of


def _doctor_cols(t: Tables, **renames: str) -> DataFrame:
    return t.doctor.select(*[F.col(src).alias(dst) for dst, src in renames.items()])


def q1_consultant_teams(t: Tables) -> DataFrame:
    """Consultants (CONSULTANT table) and the other doctors in their team.

    The reference's LEFT JOIN is null-rejected by its WHERE, so it is an
    inner join; the self-join pairs each consultant with its team members.
    The consultant side is partitioned on the key by its own join, so a
    consultant with a large team is salted.
    """
    consultants = t.consultant.join(t.doctor, "staff_no").select(
        F.col("staff_no").alias("consultant_no"),
        F.col("name").alias("consultant_name"),
        "specialty_name")
    members = _doctor_cols(t, doctor_no="staff_no", doctor_name="name", position="position",
                           date_joined_team="date_joined_team", consultant_no="consultant_staff_no")
    return (
        salted_join(members, consultants, "consultant_no", dim_bound=t.doctor)
        .where(F.col("doctor_no") != F.col("consultant_no"))
        .select("consultant_no", "consultant_name", "specialty_name", "doctor_no",
                "doctor_name", "position", "date_joined_team")
        .orderBy("consultant_name", "position", "doctor_name", "consultant_no", "doctor_no"))


def q2_ward_staffing(t: Tables) -> DataFrame:
    """Wards with a day sister, a night sister and each unit's staff nurse.

    The reference's three correlated ``TOP 1`` lookups have no ORDER BY; we
    pick the smallest name. Nurses are joined once to the union of role
    keys, then reduced with conditional ``min`` aggregates per ward / unit.
    """
    roles = role_rows(t).where(F.col("role").isin("day_sister", "night_sister", "staff_nurse"))
    staffed = t.nurse.select("staff_no", "name", "ward_name", "care_unit_no").join(
        roles.select("staff_no", "role"), "staff_no")

    def pick(role: str) -> F.Column:
        return F.min(F.when(F.col("role") == role, F.col("name")))

    sisters = staffed.where(F.col("role") != "staff_nurse").groupBy("ward_name").agg(
        pick("day_sister").alias("day_sister"), pick("night_sister").alias("night_sister"))
    unit_nurse = staffed.where(F.col("role") == "staff_nurse").groupBy("care_unit_no").agg(
        F.min("name").alias("staff_nurse_in_charge"))
    # Both lookups are grouped from NURSE rows, so NURSE's size bounds theirs.
    if provably_small(t.nurse):
        sisters, unit_nurse = F.broadcast(sisters), F.broadcast(unit_nurse)
    return (
        t.ward.select("ward_name", "specialty_name")
        .join(t.dim("care_unit").select("care_unit_no", "ward_name"), "ward_name")
        .join(sisters, "ward_name", "left")
        .join(unit_nurse, "care_unit_no", "left")
        .select("ward_name", "specialty_name", "day_sister", "night_sister", "care_unit_no",
                "staff_nurse_in_charge")
        .distinct()
        .orderBy("ward_name", "care_unit_no", "specialty_name"))


def _treatment_facts(t: Tables) -> DataFrame:
    """PTR with complaint and treatment descriptions attached."""
    complaints = t.dim("complaint").select(
        "complaint_code", F.col("description").alias("complaint"))
    treatments = t.treatment.select("treatment_code", F.col("description").alias("treatment"))
    return t.ptr.join(complaints, "complaint_code").join(treatments, "treatment_code")


def q3_patient_treatments(t: Tables) -> DataFrame:
    """Every treatment record with patient, complaint, treatment and doctor."""
    patients = t.patient.select("patient_no", "patient_name")
    doctors = _doctor_cols(t, doctor_staff_no="staff_no", doctor_name="name")
    return (
        _treatment_facts(t).join(patients, "patient_no").join(doctors, "doctor_staff_no")
        .select("patient_no", "patient_name", "complaint_code", "complaint", "treatment_code",
                "treatment", "doctor_name", "date_started", "date_ended")
        .orderBy("patient_name", "patient_no", "date_started", "complaint_code",
                 "treatment_code", "doctor_name", "date_ended"))


def q4_junior_patients(t: Tables, strict: bool = False) -> DataFrame:
    """Junior housemen / students, their patients and the unit's nurses.

    Literal form (``strict=False``) reproduces the reference: every nurse of
    the patient's care unit (its STAFF_NURSE join is unused). ``strict=True``
    keeps only staff nurses, the stated intent. Distinct (doctor, patient)
    pairs are formed *before* the one-to-many nurse join, so the fan-out is
    never followed by a distinct over the wide result, and the nurse join
    runs through ``expand_in_order``, which returns the rows in order (no
    shuffle and no sort of the fanned-out rows when the nurse list is small).
    """
    juniors = t.doctor.where(F.col("position").isin(*JUNIOR_POSITIONS)).select(
        F.col("staff_no").alias("doctor_staff_no"), F.col("name").alias("junior_doctor"),
        "position")
    junior_keys = juniors.select("doctor_staff_no")
    visits = t.ptr.select("doctor_staff_no", "patient_no")
    if provably_small(t.doctor):
        # map-side filter, then distinct pairs (partial aggregation map-side)
        pairs = visits.join(F.broadcast(junior_keys), "doctor_staff_no", "left_semi").distinct()
    else:
        # distinct pairs first (collapsed map-side), so the semi join sees
        # plain shuffle stages and AQE can split a hot junior doctor
        pairs = visits.distinct().join(junior_keys, "doctor_staff_no", "left_semi")
    nurses = t.nurse
    if strict:
        nurses = nurses.join(t.staff_nurse, "staff_no", "left_semi")
    unit_nurses = nurses.select(
        "care_unit_no", F.col("name").alias("staff_nurse_of_careunit")).distinct()
    people = pairs.join(juniors, "doctor_staff_no").join(
        t.patient.select("patient_no", "patient_name", "care_unit_no"), "patient_no")
    return (
        expand_in_order(people, unit_nurses, "care_unit_no",
                        ["junior_doctor", "patient_name", "doctor_staff_no", "patient_no"])
        .select(F.col("doctor_staff_no").alias("jh_no"), "junior_doctor", "position",
                "patient_no", "patient_name", "care_unit_no", "staff_nurse_of_careunit"))


def q5_unique_specialty(t: Tables) -> DataFrame:
    """Consultants whose specialty has exactly one consultant.

    ``IN (... GROUP BY ... HAVING COUNT(*) = 1)`` is one grouped aggregate that
    also carries the group's only row: no self-join, and a specialty with most
    of the consultants collapses map-side. A NULL specialty never matches, as
    with IN.
    """
    consultants = t.consultant.join(t.doctor, "staff_no").select(
        "staff_no", F.col("name").alias("consultant_name"), "specialty_name")
    return (
        consultants.where(F.col("specialty_name").isNotNull()).groupBy("specialty_name")
        .agg(F.count(F.lit(1)).alias("__n"),
             F.min(F.struct("staff_no", "consultant_name")).alias("__only"))
        .where("__n = 1")
        .select("__only.staff_no", "__only.consultant_name", "specialty_name")
        .orderBy("specialty_name", "staff_no"))


def q6_treatment_experience(t: Tables) -> DataFrame:
    """Complaint / treatment / doctor combinations with the doctor's history.

    The fact is reduced to distinct (complaint, treatment, doctor) keys with
    map-side partial aggregation before any dimension join. The fanned-out rows are
    many times the inputs, so they are neither joined, shuffled nor sorted: what the
    ORDER BY moves is one row per complaint, doctor and from_date, with the sorted lists
    of the doctor's treatments for the complaint and of the employments from that date,
    and these are expanded in order last. A list is as long as one doctor's distinct
    treatments for a complaint, or employments from one day.
    A doctor may be hot on either side of the experience join, so it runs as
    inner plus anti join (or against a broadcast, when EXPERIENCE is provably
    small).
    """
    keys = t.ptr.select("complaint_code", "treatment_code", "doctor_staff_no").distinct()
    # a complaint's descriptions (one, where its code is unique)
    complaints = t.complaint.where("complaint_code is not null").groupBy("complaint_code").agg(
        F.sort_array(F.collect_set(F.struct(F.col("description").alias("complaint")))).alias("__complaints"))
    treatments = t.treatment.select("treatment_code", F.col("description").alias("treatment"))
    doctors = _doctor_cols(t, doctor_staff_no="staff_no", doctor_name="name")
    # A doctor may own a large share of the combinations; the doctor join is
    # salted (or broadcast when DOCTOR is provably small) so neither it nor
    # the grouping and experience join after it keep a hot doctor in one task.
    described = keys.join(treatments, "treatment_code")
    pairs = (
        salted_join(described, doctors, "doctor_staff_no", dim_bound=t.doctor)
        .groupBy("complaint_code", F.col("doctor_staff_no").alias("doctor_no"), "doctor_name")
        .agg(F.sort_array(F.collect_set(F.struct("treatment"))).alias("__treatments")))
    experience = t.previous_experience.select(
        F.col("staff_no").alias("doctor_no"), "exp_id", "from_date", "to_date", "establishment",
        F.col("position").alias("experience_position")).distinct()
    employments = experience.groupBy("doctor_no", "from_date").agg(F.sort_array(F.collect_list(
        F.struct("exp_id", "to_date", "establishment", "experience_position"))).alias("__employments"))
    listed = salted_join(
        left_join_hot_right(pairs, employments, "doctor_no", bound=t.previous_experience),
        complaints, "complaint_code", dim_bound=t.complaint)
    return (
        listed.orderBy("complaint_code", "doctor_name", "from_date", "doctor_no")
        .select("*", F.inline("__treatments"))
        .select("*", F.inline_outer("__employments"))
        .select("*", F.inline("__complaints"))
        .select("complaint_code", "complaint", "treatment", "doctor_no", "doctor_name", "exp_id",
                "from_date", "to_date", "establishment", "experience_position"))


def q7_multi_complaint(t: Tables, min_distinct: int = 2) -> DataFrame:
    """Treatments of patients with at least ``min_distinct`` complaints.

    (patient, complaint) groups collapse map-side, so a patient with a third
    of all records still costs one small group; one aggregate chain yields
    both the distinct-complaint count and the row count per patient.
    """
    per_complaint = t.ptr.groupBy("patient_no", "complaint_code").agg(
        F.count(F.lit(1)).alias("__rows"))
    per_patient = per_complaint.groupBy("patient_no").agg(
        F.count("complaint_code").alias("__complaints"),  # NULL codes do not count
        F.sum("__rows").alias("__n"))
    qualifying = per_patient.where(F.col("__complaints") >= min_distinct).select("patient_no")
    # Qualifying patients filter PATIENT; that side is partitioned on
    # patient_no already, so AQE cannot split a hot patient in the join with
    # the fact: hot patients are salted explicitly (the per-patient row
    # counts come from the same aggregate).
    patients = t.patient.select("patient_no", "patient_name").join(
        qualifying, "patient_no", "left_semi")
    complaints = t.dim("complaint").select(
        "complaint_code", F.col("description").alias("complaint"))
    treatments = t.treatment.select("treatment_code", F.col("description").alias("treatment"))
    return (
        salted_join(t.ptr, patients, "patient_no", counts=per_patient.select("patient_no", "__n"),
                    dim_bound=t.patient)
        .join(complaints, "complaint_code").join(treatments, "treatment_code")
        .orderBy("patient_no", "complaint_code", "date_started", "treatment_code", "date_ended")
        .select("patient_no", "patient_name", "complaint", "treatment", "date_started",
                "date_ended"))


def q8_by_complaint_treatment(t: Tables) -> DataFrame:
    """Patients listed by complaint, then treatment (ordering only, no GROUP BY)."""
    return (
        _treatment_facts(t).join(t.patient.select("patient_no", "patient_name"), "patient_no")
        .select("complaint_code", "complaint", "treatment_code", "treatment", "patient_no",
                "patient_name")
        .orderBy("complaint", "treatment", "patient_name", "complaint_code", "treatment_code",
                 "patient_no"))


def q9_doctor_performance(t: Tables, staff_nos: Keys = None) -> DataFrame:
    """Progress history of one doctor, a set of doctors, or all (None)."""
    doctors = restrict(t.doctor, "staff_no", staff_nos).select(
        "staff_no", F.col("name").alias("doctor_name"),
        F.col("position").alias("current_position"), "specialty_name")
    progress = restrict(t.progress, "staff_no", staff_nos).select(
        "staff_no", "establishment", F.col("position").alias("role_at_establishment"), "date",
        "performance_grade")
    return (
        doctors.join(progress, "staff_no")
        .select("staff_no", "doctor_name", "current_position", "specialty_name", "establishment",
                "role_at_establishment", "date", "performance_grade")
        .orderBy("staff_no", "date", "establishment", "role_at_establishment",
                 "performance_grade"))


def q10_patient_full(t: Tables, patient_nos: Keys = None) -> DataFrame:
    """Full medical details per patient (inner on PTR: untreated patients drop out)."""
    patients = restrict(t.patient, "patient_no", patient_nos)
    facts = restrict(t.ptr, "patient_no", patient_nos).select(
        "patient_no", "doctor_staff_no", "complaint_code", "treatment_code", "date_started",
        "date_ended")
    units = t.dim("care_unit").select("care_unit_no", "ward_name")
    wards = t.dim("ward").select("ward_name", "specialty_name")
    # The doctor side carries its consultant flag from a join on staff_no, so
    # it is already partitioned on the join key and AQE could not split a hot
    # doctor: salted_join handles hot doctors explicitly.
    doctors = t.doctor.join(
        t.consultant.select("staff_no", F.col("staff_no").alias("__cons")), "staff_no", "left"
    ).select(F.col("staff_no").alias("doctor_staff_no"), F.col("name").alias("doctor_name"),
             yes_no(F.col("__cons")).alias("is_consultant"))
    complaints = t.dim("complaint").select(
        "complaint_code", F.col("description").alias("complaint"))
    treatments = t.treatment.select("treatment_code", F.col("description").alias("treatment"))
    placed = patients.select("patient_no", "patient_name", "date_of_birth", "date_admitted",
                             "care_unit_no", "bed_no").join(units, "care_unit_no").join(wards, "ward_name")
    # both are joins on unique keys, so no larger than DOCTOR and PATIENT
    if provably_small(t.patient):
        placed = F.broadcast(placed)
    return (
        salted_join(facts, doctors, "doctor_staff_no", dim_bound=t.doctor)
        .join(placed, "patient_no")
        .join(complaints, "complaint_code").join(treatments, "treatment_code")
        .select("patient_no", "patient_name", "date_of_birth", "date_admitted", "ward_name",
                "specialty_name", "care_unit_no", "bed_no",
                F.col("doctor_staff_no").alias("doctor_no"), "doctor_name", "is_consultant",
                "complaint_code", "complaint", "treatment_code", "treatment", "date_started",
                "date_ended")
        .orderBy("patient_no", "date_started", "complaint_code", "treatment_code", "doctor_no",
                 "date_ended"))


def q11_complaint_daterange(t: Tables, complaint_codes: Keys, date_from: str,
                            date_to: str) -> DataFrame:
    """Treatments for a complaint started within [date_from, date_to].

    Both bounds are inclusive and compared as dates, so the whole last day
    counts; the equality and range predicates reach the Parquet scan. Facts stored
    by month (``store.load_monthly_facts``) are read from the months of the range only.
    """
    lo, hi = F.lit(date_from).cast("date"), F.lit(date_to).cast("date")
    facts = restrict(t.ptr, "complaint_code", complaint_codes).where(
        F.col("date_started").between(lo, hi))
    if MONTH in facts.columns:
        facts = facts.where(F.col(MONTH).between(month_of(lo), month_of(hi))).drop(MONTH)
    treatments = t.treatment.select("treatment_code", F.col("description").alias("treatment"))
    complaints = t.dim("complaint").select(
        "complaint_code", F.col("description").alias("complaint"))
    doctors = _doctor_cols(t, doctor_staff_no="staff_no", doctor_name="name")
    return (
        facts.join(treatments, "treatment_code").join(complaints, "complaint_code")
        .join(t.patient.select("patient_no", "patient_name"), "patient_no")
        .join(doctors, "doctor_staff_no")
        .select("treatment_code", "treatment", "complaint", "patient_no", "patient_name",
                "doctor_name", "date_started", "date_ended")
        .orderBy("treatment", "treatment_code", "date_started", "patient_no", "doctor_name",
                 "date_ended"))


def q12_position_counts(t: Tables) -> DataFrame:
    """Doctors per position plus one row per nurse role (present even at 0)."""
    doctors = t.doctor.groupBy("position").agg(F.count(F.lit(1)).alias("staff_count"))
    roles = [
        t[role].agg(F.count(F.lit(1)).alias("staff_count"))
        .select(F.lit(POSITION_COUNT_LABELS[role]).alias("position"), "staff_count")
        for role in NURSE_ROLES
    ]
    return reduce(DataFrame.unionByName, [doctors, *roles]).orderBy("position", "staff_count")
