"""Reports as SQL text over the tables' views, with arguments bound by name.

``run_sql`` registers the views and runs a statement of ``STATEMENTS`` through
``spark.sql(text, args=...)``: an argument is a value, never part of the text.
``register_functions`` makes the same reports parameterised views: SQL table functions
that a session's own SQL can select from, join and filter, and Catalyst inlines.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from wardline.sources.catalog import Tables

STATEMENTS: dict[str, str] = {
    "doctor_performance": """
SELECT d.staff_no, d.name AS doctor_name, d.position AS current_position, d.specialty_name,
       p.establishment, p.position AS role_at_establishment, p.date, p.performance_grade
FROM {doctor} d JOIN {progress} p ON p.staff_no = d.staff_no
WHERE d.staff_no = :staff_no
ORDER BY d.staff_no, p.date, p.establishment, role_at_establishment, p.performance_grade
""",
    "complaint_daterange": """
SELECT f.treatment_code, t.description AS treatment, c.description AS complaint, f.patient_no,
       p.patient_name, d.name AS doctor_name, f.date_started, f.date_ended
FROM {ptr} f
  JOIN {treatment} t ON t.treatment_code = f.treatment_code
  JOIN {complaint} c ON c.complaint_code = f.complaint_code
  JOIN {patient} p ON p.patient_no = f.patient_no
  JOIN {doctor} d ON d.staff_no = f.doctor_staff_no
WHERE f.complaint_code = :complaint_code AND f.date_started BETWEEN :date_from AND :date_to
ORDER BY treatment, f.treatment_code, f.date_started, f.patient_no, doctor_name, f.date_ended
""",
    # the order of the joins is left to Catalyst (``session.use_statistics``)
    "patient_full": """
SELECT p.patient_no, p.patient_name, p.date_of_birth, p.date_admitted, u.ward_name, w.specialty_name,
       p.care_unit_no, p.bed_no, f.doctor_staff_no AS doctor_no, d.name AS doctor_name,
       CASE WHEN k.staff_no IS NULL THEN 'No' ELSE 'Yes' END AS is_consultant,
       f.complaint_code, c.description AS complaint, f.treatment_code, t.description AS treatment,
       f.date_started, f.date_ended
FROM {ptr} f
  JOIN {patient} p ON p.patient_no = f.patient_no
  JOIN {treatment} t ON t.treatment_code = f.treatment_code
  JOIN {doctor} d ON d.staff_no = f.doctor_staff_no
  JOIN {complaint} c ON c.complaint_code = f.complaint_code
  JOIN {care_unit} u ON u.care_unit_no = p.care_unit_no
  JOIN {ward} w ON w.ward_name = u.ward_name
  LEFT JOIN {consultant} k ON k.staff_no = f.doctor_staff_no
WHERE :ward_name IS NULL OR u.ward_name = :ward_name
ORDER BY p.patient_no, f.date_started, f.complaint_code, f.treatment_code, doctor_no, f.date_ended
""",
}


def run_sql(t: Tables, name: str, **args: str | date | None) -> DataFrame:
    """A statement of ``STATEMENTS`` with its arguments, over ``t``."""
    spark = next(iter(t.values())).sparkSession
    return spark.sql(STATEMENTS[name], args=args, **t)


# name -> (parameters, columns, statement)
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "team_of": ("consultant STRING", "staff_no STRING, name STRING, position STRING", """
SELECT d.staff_no, d.name, d.position FROM {p}doctor d
WHERE d.consultant_staff_no = team_of.consultant AND d.staff_no <> team_of.consultant"""),
    "treatments_between": ("first DATE, last DATE",
                           "patient_no STRING, complaint_code STRING, treatment_code STRING,"
                           " doctor_staff_no STRING, date_started DATE", """
SELECT f.patient_no, f.complaint_code, f.treatment_code, f.doctor_staff_no, f.date_started
FROM {p}ptr f
WHERE f.date_started BETWEEN treatments_between.first AND treatments_between.last"""),
}


def register_functions(t: Tables, prefix: str = "") -> list[str]:
    """Temporary views of ``t`` and, over them, the table functions of ``FUNCTIONS``
    (names start with ``prefix``), for the session's own SQL."""
    spark: SparkSession = next(iter(t.values())).sparkSession
    t.register_views(prefix)
    for name, (parameters, columns, body) in FUNCTIONS.items():
        text = body.replace("{p}", prefix).replace(f"{name}.", f"{prefix}{name}.")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters})"
                  f" RETURNS TABLE({columns}) RETURN {text}")
    return [prefix + name for name in FUNCTIONS]


def team_activity(t: Tables, consultant: str, first: str, last: str) -> DataFrame:
    """staff_no, name, n_treatments: what a consultant's team did between two dates
    (both inclusive), written over the parameterised views."""
    spark: SparkSession = next(iter(t.values())).sparkSession
    register_functions(t, "wardline_")
    return spark.sql("""
SELECT m.staff_no, m.name, count(f.patient_no) AS n_treatments
FROM wardline_team_of(:consultant) m
  LEFT JOIN wardline_treatments_between(CAST(:first AS DATE), CAST(:last AS DATE)) f
    ON f.doctor_staff_no = m.staff_no
GROUP BY m.staff_no, m.name
ORDER BY m.staff_no, m.name""", args={"consultant": consultant, "first": first, "last": last})
