"""Fixed schemas of the 17 hospital tables (never inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D = T.StringType(), T.IntegerType(), T.LongType(), T.DateType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


_NURSE_ROLE = _struct(("staff_no", S))

SCHEMAS: dict[str, T.StructType] = {
    "specialty": _struct(("specialty_name", S)),
    "ward": _struct(("ward_name", S), ("specialty_name", S), ("number_of_care_units", I)),
    "care_unit": _struct(("care_unit_no", S), ("ward_name", S)),
    "bed": _struct(("bed_no", S), ("care_unit_no", S), ("is_occupied", I)),
    "patient": _struct(("patient_no", S), ("patient_name", S), ("date_of_birth", D),
                       ("date_admitted", D), ("care_unit_no", S), ("bed_no", S)),
    "doctor": _struct(("staff_no", S), ("name", S), ("position", S), ("date_joined_team", D),
                      ("specialty_name", S), ("consultant_staff_no", S)),
    "consultant": _struct(("staff_no", S)),
    "nurse": _struct(("staff_no", S), ("name", S), ("ward_name", S), ("care_unit_no", S)),
    "day_sister": _NURSE_ROLE,
    "night_sister": _NURSE_ROLE,
    "staff_nurse": _NURSE_ROLE,
    "non_reg_nurse": _NURSE_ROLE,
    "complaint": _struct(("complaint_code", S), ("description", S)),
    "treatment": _struct(("treatment_code", S), ("description", S)),
    "ptr": _struct(("patient_no", S), ("complaint_code", S), ("treatment_code", S),
                   ("doctor_staff_no", S), ("date_started", D), ("date_ended", D)),
    "previous_experience": _struct(("exp_id", L), ("staff_no", S), ("from_date", D),
                                   ("to_date", D), ("establishment", S), ("position", S)),
    "progress": _struct(("progress_id", L), ("staff_no", S), ("establishment", S),
                        ("position", S), ("date", D), ("performance_grade", S)),
}

TABLES = tuple(SCHEMAS)

# Primary keys (what the ingest duplicate checks test, plus join keys).
KEYS: dict[str, str] = {
    "specialty": "specialty_name", "ward": "ward_name", "care_unit": "care_unit_no",
    "bed": "bed_no", "patient": "patient_no", "doctor": "staff_no", "consultant": "staff_no",
    "nurse": "staff_no", "day_sister": "staff_no", "night_sister": "staff_no",
    "staff_nurse": "staff_no", "non_reg_nurse": "staff_no", "complaint": "complaint_code",
    "treatment": "treatment_code", "previous_experience": "exp_id", "progress": "progress_id",
}

# References: (table, column, table whose key it holds). The consultant of a doctor is
# the only one that may be missing.
REFERENCES: tuple[tuple[str, str, str], ...] = (
    ("ward", "specialty_name", "specialty"), ("care_unit", "ward_name", "ward"),
    ("bed", "care_unit_no", "care_unit"), ("patient", "care_unit_no", "care_unit"),
    ("patient", "bed_no", "bed"), ("doctor", "specialty_name", "specialty"),
    ("doctor", "consultant_staff_no", "doctor"), ("consultant", "staff_no", "doctor"),
    ("nurse", "ward_name", "ward"), ("nurse", "care_unit_no", "care_unit"),
    ("day_sister", "staff_no", "nurse"), ("night_sister", "staff_no", "nurse"),
    ("staff_nurse", "staff_no", "nurse"), ("non_reg_nurse", "staff_no", "nurse"),
    ("ptr", "patient_no", "patient"), ("ptr", "complaint_code", "complaint"),
    ("ptr", "treatment_code", "treatment"), ("ptr", "doctor_staff_no", "doctor"),
    ("previous_experience", "staff_no", "doctor"), ("progress", "staff_no", "doctor"),
)
OPTIONAL_REFERENCES = {("doctor", "consultant_staff_no")}
# Every column that holds a key or a reference.
KEY_COLUMNS = frozenset(KEYS.values()) | {column for _, column, _ in REFERENCES}
