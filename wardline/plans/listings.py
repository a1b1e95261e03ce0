"""Dashboard, listing pages and lookup lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.columns import (
    CONSULTANT_POSITION,
    NURSE_LIST_ROLE_FALLBACK,
    format_key,
    yes_no,
)
from wardline.operators.aggregates import attach_counts, count_by
from wardline.operators.ids import next_number
from wardline.operators.joins import Keys, restrict
from wardline.operators.roles import with_role_label
from wardline.sources.catalog import Tables

# Dashboard tiles (label, table) in display order.
DASHBOARD_TILES = (
    ("Patients", "patient"),
    ("Doctors", "doctor"),
    ("Nurses", "nurse"),
    ("Wards", "ward"),
    ("Beds", "bed"),
    ("Specialties", "specialty"),
)
# The four tables the reference pre-computes next IDs for
# (label, table, key column, key prefix).
NEXT_ID_TABLES = (
    ("PATIENT", "patient", "patient_no", "PAT"),
    ("DOCTOR", "doctor", "staff_no", "DOC"),
    ("NURSE", "nurse", "staff_no", "NUR"),
    ("BED", "bed", "bed_no", "BED"),
)
RECENT_ADMISSIONS = 5
COMPLAINT_LABEL_CHARS = 40


def dash_totals(t: Tables) -> DataFrame:
    """(label, n): six global counts, each a column-pruned scan, in one union."""
    parts = [t[table].agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("label"), "n")
             for label, table in DASHBOARD_TILES]
    return reduce(DataFrame.unionByName, parts)


def dash_recent_admissions(t: Tables, n: int = RECENT_ADMISSIONS) -> DataFrame:
    """Latest admissions (top-n is the feature); ties broken by patient_no.

    orderBy + limit plans as TakeOrderedAndProject: each task keeps its own
    top n and only n rows per task reach the final merge.
    """
    return t.patient.select("patient_no", "patient_name", "date_admitted").orderBy(
        F.col("date_admitted").desc_nulls_last(), F.col("patient_no")).limit(n)


def dash_specialty_overview(t: Tables) -> DataFrame:
    """Wards and doctors per specialty, aggregated separately then joined (no fan-out)."""
    wards = count_by(t.ward, "specialty_name", "wards")
    doctors = count_by(t.doctor, "specialty_name", "doctors")
    base = t.specialty.select("specialty_name")
    return attach_counts(attach_counts(base, wards, "specialty_name"), doctors,
                         "specialty_name").orderBy("specialty_name")


def list_specialties(t: Tables) -> DataFrame:
    return t.specialty.select("specialty_name").orderBy("specialty_name")


def list_ward_units(t: Tables) -> DataFrame:
    """Declared vs actual care units per ward (0 when none)."""
    units = count_by(t.care_unit, "ward_name", "actual_care_units")
    return attach_counts(
        t.ward.select("ward_name", "specialty_name", "number_of_care_units"), units, "ward_name"
    ).orderBy("ward_name", "specialty_name")


def list_unit_beds(t: Tables) -> DataFrame:
    """Total and free beds per care unit from a single grouped pass over BED."""
    beds = t.bed.groupBy("care_unit_no").agg(
        F.count(F.lit(1)).alias("total_beds"),
        F.count_if(F.col("is_occupied") == 0).alias("available_beds"))
    return attach_counts(t.care_unit.select("care_unit_no", "ward_name"), beds, "care_unit_no"
                         ).orderBy("care_unit_no", "ward_name")


def list_beds(t: Tables) -> DataFrame:
    """Beds with ward and status; anything but is_occupied = 1 (NULL too) is 'Available'."""
    status = F.when(F.col("is_occupied") == 1, F.lit("Occupied")).otherwise(F.lit("Available"))
    return (
        t.bed.join(t.dim("care_unit").select("care_unit_no", "ward_name"), "care_unit_no")
        .select("bed_no", "care_unit_no", "ward_name", status.alias("status"))
        .orderBy("bed_no", "care_unit_no"))


def list_patients(t: Tables) -> DataFrame:
    return (
        t.patient.join(t.dim("care_unit").select("care_unit_no", "ward_name"), "care_unit_no")
        .select("patient_no", "patient_name", "date_of_birth", "date_admitted", "ward_name",
                "care_unit_no", "bed_no")
        .orderBy(F.col("date_admitted").desc_nulls_last(), "patient_no"))


def list_doctors(t: Tables) -> DataFrame:
    """Doctors with consultant flag and their consultant's name (NULL if none).

    The scalar self-lookup becomes a left join on staff_no, which must be
    unique (the reference's subquery would fail on a duplicate).
    """
    flags = t.consultant.select("staff_no", F.col("staff_no").alias("__cons"))
    names = t.doctor.select(F.col("staff_no").alias("consultant_staff_no"),
                            F.col("name").alias("under_consultant"))
    return (
        t.doctor.join(flags, "staff_no", "left")
        .join(names, "consultant_staff_no", "left")
        .select("staff_no", "name", "position", "specialty_name", "date_joined_team",
                yes_no(F.col("__cons")).alias("is_consultant"), "under_consultant")
        .orderBy("name", "staff_no"))


def list_nurses(t: Tables) -> DataFrame:
    nurses = t.nurse.select("staff_no", "name", "ward_name", "care_unit_no")
    return with_role_label(nurses, t, NURSE_LIST_ROLE_FALLBACK).orderBy(
        "ward_name", "role", "name", "staff_no")


def lk_wards(t: Tables) -> DataFrame:
    return t.ward.select("ward_name", "number_of_care_units").orderBy("ward_name")


def lk_consultants(t: Tables) -> DataFrame:
    """Consultants by position (not the CONSULTANT table; the two can differ)."""
    return t.doctor.where(F.col("position") == CONSULTANT_POSITION).select(
        "staff_no", "name").orderBy("name", "staff_no")


def lk_patients(t: Tables) -> DataFrame:
    return t.patient.select("patient_no", "patient_name").orderBy("patient_no")


def lk_complaints(t: Tables) -> DataFrame:
    """Code, description and picker label 'CODE - <first 40 chars>...'."""
    label = F.concat(F.col("complaint_code"), F.lit(" - "),
                     F.substring("description", 1, COMPLAINT_LABEL_CHARS), F.lit("..."))
    return t.complaint.select("complaint_code", "description", label.alias("label")).orderBy(
        "complaint_code")


def lk_care_units(t: Tables) -> DataFrame:
    label = F.concat(F.col("care_unit_no"), F.lit(" ("), F.col("ward_name"), F.lit(")"))
    return t.care_unit.select("care_unit_no", "ward_name", label.alias("label")).orderBy(
        "care_unit_no")


def lk_doctors(t: Tables) -> DataFrame:
    return t.doctor.select("staff_no", "name",
                           F.concat_ws(" - ", "staff_no", "name").alias("label")).orderBy(
        "name", "staff_no")


def units_by_ward(t: Tables, ward_names: Keys = None) -> DataFrame:
    """Care units of a ward (picker feed), one row per unit.

    The reference returns a JSON array per request; here the rows stay
    rows and ``wardline.sources.store.write_json`` writes them as JSON lines
    partitioned by ward, so no ward's list is gathered into a single value.
    """
    return restrict(t.care_unit, "ward_name", ward_names).select(
        "ward_name", "care_unit_no").orderBy("ward_name", "care_unit_no")


def free_beds_by_unit(t: Tables, care_unit_nos: Keys = None) -> DataFrame:
    """Free beds (is_occupied = 0; NULL is not free) per care unit, one row per bed."""
    return restrict(t.bed, "care_unit_no", care_unit_nos).where(F.col("is_occupied") == 0).select(
        "care_unit_no", "bed_no").orderBy("care_unit_no", "bed_no")


def next_ids(t: Tables) -> DataFrame:
    """(table_name, next_id): MAX numeric suffix + 1 per numbered table."""
    parts = [next_number(t[name], key, prefix).select(
        F.lit(label).alias("table_name"), format_key(prefix, F.col("next_no")).alias("next_id"))
        for label, name, key, prefix in NEXT_ID_TABLES]
    return reduce(DataFrame.unionByName, parts)
