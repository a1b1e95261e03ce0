"""Edge cases of the twelve reports on hand-made rows (FIXTURES.md §3)."""

from __future__ import annotations

from conftest import collect, d
from pyspark.sql import functions as F

from wardline.plans import reports as R

DOCS = [
    # staff_no, name, position, joined, specialty, consultant
    ("D1", "Cara", "consultant", d("2020-01-01"), "Cardio", "D1"),   # own consultant
    ("D2", "Bob", "junior houseman(jh)", None, "Cardio", "D1"),
    ("D3", "Al", "", d("2021-05-05"), "Cardio", "D1"),               # blank position
    ("D4", "Zed", "student(s)", None, "Neuro", None),                 # no consultant
    ("D5", "Cy", "consultant", None, "Neuro", None),                  # not in CONSULTANT
    ("D6", "Eve", "consultant", None, None, "D6"),                    # NULL specialty
    ("D7", "Ida", "registrar(r)", None, "Derm", "D7"),                # in CONSULTANT, not by position
    ("D8", "Ann", "consultant", None, "Derm", None),
]
CONS = [("D1",), ("D6",), ("D7",), ("D8",)]


def test_q1_excludes_self_and_uses_consultant_table(make_tables):
    t = make_tables(doctor=DOCS, consultant=CONS)
    rows = collect(R.q1_consultant_teams(t), "consultant_no", "doctor_no")
    assert rows == [("D1", "D3"), ("D1", "D2")]  # sorted by consultant, position, name


def test_q5_unique_specialty_drops_null_and_shared(make_tables):
    t = make_tables(doctor=DOCS, consultant=CONS)
    # Cardio: D1 only -> kept; Derm: D7 and D8 -> dropped; NULL specialty (D6) -> dropped
    assert collect(R.q5_unique_specialty(t), "staff_no") == [("D1",)]


def test_q12_counts_every_label_even_at_zero(make_tables):
    t = make_tables(doctor=DOCS, day_sister=[("N1",)])
    got = dict(collect(R.q12_position_counts(t)))
    assert got["Day Sister"] == 1
    assert got["Night Sister"] == 0 and got["Non-Registered Nurse"] == 0
    assert got[""] == 1  # blank position is its own group
    assert got["consultant"] == 4
    assert sum(v for k, v in got.items() if k not in (
        "Day Sister", "Night Sister", "Staff Nurse", "Non-Registered Nurse")) == len(DOCS)


def test_q2_smallest_name_and_missing_sister(make_tables):
    t = make_tables(
        ward=[("W1", "Cardio", 2), ("W2", "Neuro", 1)],
        care_unit=[("U1", "W1"), ("U2", "W1"), ("U3", "W2")],
        nurse=[("N1", "Zoe", "W1", "U1"), ("N2", "Amy", "W1", "U1"), ("N3", "Kim", "W1", "U2"),
               ("N4", "Lea", "W1", "U1")],
        day_sister=[("N1",), ("N2",)], staff_nurse=[("N3",), ("N4",)], night_sister=[("N4",)])
    rows = collect(R.q2_ward_staffing(t))
    assert rows == [
        ("W1", "Cardio", "Amy", "Lea", "U1", "Lea"),
        ("W1", "Cardio", "Amy", "Lea", "U2", "Kim"),
        ("W2", "Neuro", None, None, "U3", None),
    ]


def _care(make_tables, **extra):
    base = dict(
        doctor=DOCS, consultant=CONS,
        patient=[("P1", "Pat", None, d("2024-01-01"), "U1", "B1"),
                 ("P2", "Quinn", None, None, "U9", "B2"),
                 ("P3", "Rae", None, None, "U1", "B3")],
        complaint=[("C1", "Cough"), ("C2", "Fever")],
        treatment=[("T1", "Rest"), ("T2", "Rest")],
        ptr=[("P1", "C1", "T1", "D2", d("2024-01-02"), None),
             ("P1", "C1", "T1", "D2", d("2024-01-05"), None),
             ("P1", "C2", "T2", "D4", d("2024-01-31"), d("2024-02-02")),
             ("P2", "C1", "T1", "D4", d("2024-02-01"), None)],
        nurse=[("N1", "Amy", "W1", "U1"), ("N2", "Bea", "W1", "U1"), ("N3", "Amy", "W1", "U1")],
        staff_nurse=[("N2",)],
        care_unit=[("U1", "W1"), ("U9", "W1")], ward=[("W1", "Cardio", 2)],
        previous_experience=[(1, "D2", d("2010-01-01"), None, "EST-1", "view"),
                             (2, "D2", d("2012-01-01"), None, "EST-2", "click")],
        progress=[(10, "D2", "EST-1", "click", d("2024-01-01"), "B")],
    )
    base.update(extra)
    return make_tables(**base)


def test_q4_literal_lists_every_unit_nurse_and_strict_only_staff(make_tables):
    t = _care(make_tables)
    lit = collect(R.q4_junior_patients(t), "jh_no", "patient_no", "staff_nurse_of_careunit")
    # D2 treats P1 twice -> one pair; two nurses named Amy collapse (DISTINCT)
    assert sorted(lit) == [("D2", "P1", "Amy"), ("D2", "P1", "Bea"), ("D4", "P1", "Amy"),
                           ("D4", "P1", "Bea"), ("D4", "P2", None)]
    strict = collect(R.q4_junior_patients(t, strict=True), "jh_no", "patient_no",
                     "staff_nurse_of_careunit")
    assert sorted(strict) == [("D2", "P1", "Bea"), ("D4", "P1", "Bea"), ("D4", "P2", None)]
    assert set(x for x in strict if x[2]) <= set(lit)


def test_q6_distinct_before_fanout_keeps_doctors_without_experience(make_tables):
    t = _care(make_tables)
    rows = collect(R.q6_treatment_experience(t), "complaint_code", "treatment", "doctor_no",
                   "exp_id")
    # T1 and T2 share the description 'Rest' -> one combination per complaint/doctor
    assert sorted(rows, key=str) == sorted([
        ("C1", "Rest", "D2", 1), ("C1", "Rest", "D2", 2),
        ("C1", "Rest", "D4", None), ("C2", "Rest", "D4", None)], key=str)


def test_q7_thresholds(make_tables):
    t = _care(make_tables)
    assert {r[0] for r in collect(R.q7_multi_complaint(t), "patient_no")} == {"P1"}
    assert collect(R.q7_multi_complaint(t, min_distinct=3)) == []


def test_q10_untreated_patient_has_no_rows_and_flags_consultants(make_tables):
    t = _care(make_tables)
    assert collect(R.q10_patient_full(t, "P3")) == []
    rows = collect(R.q10_patient_full(t, ["P1"]), "doctor_no", "is_consultant")
    assert rows == [("D2", "No"), ("D2", "No"), ("D4", "No")]
    t2 = _care(make_tables, consultant=CONS + [("D4",)])
    assert collect(R.q10_patient_full(t2, "P2"), "is_consultant") == [("Yes",)]


def test_q11_bounds_are_inclusive(make_tables, spark):
    t = _care(make_tables)
    rows = collect(R.q11_complaint_daterange(t, "C1", "2024-01-02", "2024-02-01"),
                   "patient_no", "date_started")
    assert sorted(rows) == [("P1", d("2024-01-02")), ("P1", d("2024-01-05")),
                            ("P2", d("2024-02-01"))]
    keyset = spark.createDataFrame([("C2",)], "k string")
    assert collect(R.q11_complaint_daterange(t, keyset, "2024-01-31", "2024-01-31"),
                   "patient_no") == [("P1",)]


def test_q9_key_forms_agree(make_tables, spark):
    t = _care(make_tables)
    one = collect(R.q9_doctor_performance(t, "D2"))
    assert one == collect(R.q9_doctor_performance(t, ["D2"]))
    assert one == collect(R.q9_doctor_performance(t, spark.createDataFrame([("D2",)], "s string")))
    assert len(one) == 1 and one[0][-1] == "B"


def test_q3_q8_row_per_record(make_tables):
    t = _care(make_tables)
    assert R.q3_patient_treatments(t).count() == 4
    assert R.q8_by_complaint_treatment(t).count() == 4


def test_q7_null_complaint_code_is_not_a_complaint(make_tables):
    t = _care(make_tables, ptr=[
        ("P1", "C1", "T1", "D2", d("2024-01-02"), None),
        ("P1", None, "T1", "D2", d("2024-01-03"), None),   # COUNT(DISTINCT) ignores NULL
        ("P2", "C1", "T1", "D2", d("2024-01-02"), None),
        ("P2", "C2", "T1", "D2", d("2024-01-03"), None)])
    assert {r[0] for r in collect(R.q7_multi_complaint(t), "patient_no")} == {"P2"}


def test_q6_sorts_lists_before_they_are_expanded(make_tables):
    """Rows in the order of all six columns, though the expanded rows are not shuffled."""
    t = _care(make_tables)
    t = t.replace(
        complaint=t.complaint.unionByName(t.complaint.withColumn("description", F.lit("another"))),
        previous_experience=t.previous_experience.unionByName(t.previous_experience.withColumn(
            "exp_id", F.col("exp_id") + 10)).unionByName(t.previous_experience.limit(1).withColumn(
                "from_date", F.lit(None).cast("date"))))
    df = R.q6_treatment_experience(t)
    combos = t.ptr.join(t.complaint.withColumnRenamed("description", "complaint"), "complaint_code").join(
        t.treatment.withColumnRenamed("description", "treatment"), "treatment_code").join(
        t.doctor.selectExpr("staff_no doctor_staff_no", "name doctor_name"), "doctor_staff_no").selectExpr(
        "complaint_code", "complaint", "treatment", "doctor_staff_no doctor_no", "doctor_name").distinct()
    plain = combos.join(t.previous_experience.withColumnsRenamed(
        {"staff_no": "doctor_no", "position": "experience_position"}).distinct(), "doctor_no", "left").select(df.columns)
    by = ["complaint_code", "doctor_name", "from_date", "doctor_no", "treatment", "exp_id"]
    rows = df.collect()
    assert [[r[c] for c in by] for r in rows] == [[r[c] for c in by] for r in plain.orderBy(*by).collect()]
    assert sorted(map(str, rows)) == sorted(map(str, plain.collect())) and len(rows) > 12
    moved = df._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in moved and "exp_id" not in moved.split("rangepartitioning")[1].split("\n")[0]
