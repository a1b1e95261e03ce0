"""Command line: list jobs, run one over a snapshot into Parquet."""

from __future__ import annotations

import contextlib
import io
import tempfile

import pytest
from conftest import d

from wardline.__main__ import main
from wardline.sources.store import save_tables


def test_list_and_run(make_tables, spark):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        main(["list"])
    assert "q3_patient_treatments" in buf.getvalue().split()

    root = tempfile.mkdtemp(prefix="wardline-cli-")
    t = make_tables(doctor=[("D1", "Cara", "consultant", None, "X", None)],
                    progress=[(1, "D1", "E", "p", d("2024-01-01"), "A"),
                              (2, "D2", "E", "p", d("2024-01-01"), "B")])
    save_tables(t, f"{root}/snap")
    main(["run", "q9_doctor_performance", "--tables", f"{root}/snap", "--keys", "D1",
          "--format", "parquet", "--out", f"{root}/q9"])
    rows = spark.read.parquet(f"{root}/q9").select("staff_no", "performance_grade").collect()
    assert [tuple(r) for r in rows] == [("D1", "A")]


@pytest.mark.parametrize("argv", [
    ["q4_junior_patients", "--keys", "DOC-004"],          # its parameter is no key
    ["q7_multi_complaint", "--keys", "PAT-1"],
    ["dash_recent_admissions", "--keys", "3"],
    ["q11_complaint_daterange", "--date-from", "1996-01-01"],   # all three or none
    ["q11_complaint_daterange", "--complaint", "CMP-007"],
    ["q3_patient_treatments", "--complaint", "CMP-007"],
])
def test_refuses_inputs_a_job_does_not_take(make_tables, argv):
    root = tempfile.mkdtemp(prefix="wardline-cli-")
    save_tables(make_tables(), f"{root}/snap")
    with pytest.raises(SystemExit):
        main(["run", *argv, "--tables", f"{root}/snap", "--format", "parquet", "--out", f"{root}/x"])


def test_q11_takes_its_three_inputs(make_tables, spark):
    root = tempfile.mkdtemp(prefix="wardline-cli-")
    t = make_tables(
        patient=[("P1", "Ann", None, None, "U", "B")], doctor=[("D1", "Cara", "x", None, "X", None)],
        complaint=[("C1", "cough")], treatment=[("T1", "tea")],
        ptr=[("P1", "C1", "T1", "D1", d("2024-01-01"), None), ("P1", "C1", "T1", "D1", d("2024-03-01"), None)])
    save_tables(t, f"{root}/snap")
    main(["run", "q11_complaint_daterange", "--tables", f"{root}/snap", "--complaint", "C1", "--date-from",
          "2024-01-01", "--date-to", "2024-01-31", "--format", "json", "--out", f"{root}/q11"])
    assert spark.read.json(f"{root}/q11").count() == 1
