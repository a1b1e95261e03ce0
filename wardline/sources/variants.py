"""Stand-in inputs for the audit and the collated jobs: the derived tables with other
spellings of keys and with planted faults. Only rows are made here; see FIXTURES.md."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.columns import key_number
from wardline.sources.catalog import Tables

# Fixed values of the planted faults.
UNKNOWN_DOCTOR, UNKNOWN_UNIT = "DOC-X", "CU-?"


def respelled(key: Column, number: Column) -> Column:
    """A key in lower case, with a trailing space, or as it is, by ``number`` modulo 3."""
    return F.when(number % 3 == 1, F.lower(key)).when(number % 3 == 2, F.concat(key, F.lit(" "))).otherwise(key)


def mixed_spelling(t: Tables) -> Tables:
    """References to patients and doctors respelled, row by row; keys as they are."""
    return t.replace(
        ptr=t.ptr.withColumn("patient_no", respelled(F.col("patient_no"), F.dayofmonth("date_started"))),
        progress=t.progress.withColumn("staff_no", respelled(F.col("staff_no"), F.col("progress_id"))))


def faulty(t: Tables) -> Tables:
    """The tables of ``mixed_spelling`` with repeated and missing keys and references."""
    t = mixed_spelling(t)
    patient_k = key_number(F.col("patient_no"), "PAT")
    nurse_k = key_number(F.col("staff_no"), "NUR")
    bed_k = key_number(F.col("bed_no"), "BED")

    def plus(df: DataFrame, where: Column, **changed: Column) -> DataFrame:
        return df.unionByName(df.where(where).withColumns(changed))

    patients = plus(t.patient, patient_k % 50 == 3)  # the same row again
    patients = plus(patients, patient_k % 50 == 7, patient_no=F.lower("patient_no"))
    patients = plus(patients, patient_k % 50 == 11, patient_no=F.lit(None).cast("string"))
    return t.replace(
        patient=patients.withColumn("bed_no", F.when(patient_k % 20 == 9, F.lit(None).cast("string"))
                                    .when(patient_k % 20 == 13, F.format_string("BED-%03d", patient_k - 1))
                                    .otherwise(F.col("bed_no"))),
        bed=t.bed.withColumn("care_unit_no", F.when(bed_k % 40 == 5, F.lit(UNKNOWN_UNIT))
                             .otherwise(F.col("care_unit_no"))),
        nurse=t.nurse.withColumn("ward_name", F.when(nurse_k % 30 == 4, F.lit("WARD_0"))
                                 .otherwise(F.col("ward_name"))),
        ptr=t.ptr.withColumn("doctor_staff_no", F.when(F.dayofmonth("date_started") == 13, F.concat(
            F.lit(UNKNOWN_DOCTOR), F.substring("treatment_code", -1, 1)))
            .when(F.dayofmonth("date_started") == 28, F.lit(None).cast("string"))
            .otherwise(F.col("doctor_staff_no"))))
