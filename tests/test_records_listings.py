"""Record forms, dashboard and listings on hand-made rows."""

from __future__ import annotations

from conftest import collect, d

from wardline.plans import listings as L
from wardline.plans import records as C

NURSES = [("N1", "Amy", "W1", "U1"), ("N2", "Bea", "W1", "U2"), ("N3", "Cat", "W2", "U3"),
          ("N4", "Dee", "W1", "U1")]


def test_role_priority_and_fallback_labels(make_tables):
    t = make_tables(nurse=NURSES, night_sister=[("N1",)], day_sister=[("N1",)],
                    non_reg_nurse=[("N2",)], staff_nurse=[("N4",)])
    ward = dict(collect(C.rec_ward_nurses(t, "W1"), "staff_no", "role"))
    assert ward == {"N1": "Day Sister", "N2": "Non-Reg Nurse", "N4": "Staff Nurse"}
    listed = dict(collect(L.list_nurses(t), "staff_no", "role"))
    assert listed["N3"] == "Unassigned"
    assert dict(collect(C.rec_ward_nurses(t, "W2"), "staff_no", "role")) == {"N3": "Nurse"}


def test_latest_grade_ties_and_nulls(make_tables):
    docs = [("D1", "Cara", "consultant", None, "X", "D1"),
            ("D2", "Bob", "registrar(r)", None, "X", "D1"),
            ("D3", "Al", "student(s)", None, "X", "D1"),
            ("D4", "Cy", "student(s)", None, "X", "D1"),
            ("D5", "Dan", "student(s)", None, "X", "D9")]   # consultant not in CONSULTANT
    prog = [(1, "D2", "E", "p", d("2024-01-01"), "C"),
            (3, "D2", "E", "p", d("2024-02-01"), "B"),
            (2, "D2", "E", "p", d("2024-02-01"), "A"),      # same date, smaller id
            (4, "D3", "E", "p", None, "A"),
            (5, "D3", "E", "p", d("2020-01-01"), "D")]
    t = make_tables(doctor=docs, consultant=[("D1",), ("D9",)], progress=prog)
    got = {r[0]: r[1] for r in collect(C.rec_team_latest_grade(t), "staff_no", "latest_grade")}
    assert got == {"D2": "B", "D3": "D", "D4": None}  # D1 (self) and D5 (D9 not a doctor) absent


def test_ward_patients_one_row_per_treatment(make_tables):
    t = make_tables(
        care_unit=[("U1", "W1")],
        patient=[("P1", "Pat", None, None, "U1", "B1"), ("P2", "Ed", None, None, "U1", "B2")],
        doctor=[("D1", "Cara", "consultant", None, "X", None)],
        ptr=[("P1", "C", "T", "D1", d("2024-01-01"), None),
             ("P1", "C", "T", "D1", d("2024-01-02"), None)])
    rows = collect(C.rec_ward_patients(t, "W1"), "patient_no", "consultant_name")
    assert rows == [("P1", "Cara"), ("P1", "Cara"), ("P2", None)]


def test_zero_counts_and_bed_states(make_tables):
    t = make_tables(
        specialty=[("Cardio",), ("Neuro",)],
        ward=[("W1", "Cardio", 3), ("W2", "Cardio", 1)],
        care_unit=[("U1", "W1"), ("U2", "W1")],
        bed=[("B1", "U1", 0), ("B2", "U1", 1), ("B3", "U1", None)],
        doctor=[("D1", "Cara", "consultant", None, "Cardio", None)])
    assert collect(L.dash_specialty_overview(t)) == [("Cardio", 2, 1), ("Neuro", 0, 0)]
    assert collect(L.list_ward_units(t), "ward_name", "actual_care_units") == [("W1", 2), ("W2", 0)]
    assert collect(L.list_unit_beds(t), "care_unit_no", "total_beds", "available_beds") == [
        ("U1", 3, 1), ("U2", 0, 0)]
    assert collect(L.list_beds(t), "bed_no", "status") == [
        ("B1", "Available"), ("B2", "Occupied"), ("B3", "Available")]
    assert collect(L.free_beds_by_unit(t, "U1"), "bed_no") == [("B1",)]
    assert dict(collect(L.dash_totals(t)))["Beds"] == 3


def test_recent_admissions_ties_nulls_and_short_tables(make_tables):
    pats = [("P3", "c", None, d("2024-01-02"), "U", "B"), ("P1", "a", None, d("2024-01-02"), "U", "B"),
            ("P2", "b", None, None, "U", "B")]
    t = make_tables(patient=pats)
    assert collect(L.dash_recent_admissions(t), "patient_no") == [("P1",), ("P3",), ("P2",)]
    assert collect(L.dash_recent_admissions(t, n=1), "patient_no") == [("P1",)]


def test_list_doctors_consultant_lookup(make_tables):
    t = make_tables(doctor=[("D1", "Cara", "consultant", None, "X", None),
                            ("D2", "Bob", "", None, "X", "D1"),
                            ("D3", "Al", "", None, "X", "D404")],
                    consultant=[("D1",)])
    rows = collect(L.list_doctors(t), "staff_no", "is_consultant", "under_consultant")
    assert rows == [("D3", "No", None), ("D2", "No", "Cara"), ("D1", "Yes", None)]
    assert collect(L.lk_consultants(t), "staff_no") == [("D1",)]


def test_complaint_label_truncates_to_40_chars(make_tables):
    t = make_tables(complaint=[("C1", "x" * 50), ("C2", "short")])
    assert collect(L.lk_complaints(t), "label") == [("C1 - " + "x" * 40 + "...",),
                                                   ("C2 - short...",)]
