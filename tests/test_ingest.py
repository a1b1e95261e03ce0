"""Batch ingestion: trimming, required fields, first-wins keys, side tables, IDs."""

from __future__ import annotations

from conftest import collect, d
from pyspark.sql import functions as F

from wardline.functions.columns import clean_text, php_intval
from wardline.operators.ids import assign_ids, dense_index, next_number
from wardline.plans import ingest as I

PAT_COLS = "arrival_seq long, patient_no string, patient_name string, dob string, " \
           "date_admitted string, care_unit_no string, bed_no string"


def test_trim_matches_php(spark):
    df = spark.createDataFrame([(" \t a b\n\r\x00\x0b",), ("\t",), (None,)], "s string")
    assert collect(df.select(clean_text("s"))) == [("a b",), ("",), (None,)]


def test_intval(spark):
    vals = [None, " 3", "4 units", "x", "-2", "", "1e3", "3.9", "-2.5x", ".5", "\t7"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in collect(df.select(php_intval(F.col("s"), 2)))]
    assert got == [2, 3, 4, 0, -2, 0, 1000, 3, -2, 0, 7]


def test_patient_batch_first_wins_and_bed_update(make_tables, spark):
    t = make_tables(
        patient=[("P1", "Old", None, None, "U1", "B1")],
        bed=[("B1", "U1", 0), ("B2", "U1", 0), ("B3", "U1", 1)])
    cands = spark.createDataFrame([
        (1, " P1 ", "Dup", "", "", "U1", "B2"),              # key exists
        (2, "P2\t", "  ", "", "", "U1", "B2"),               # blank name -> does not claim P2
        (3, "P2", "Pia", "1990-01-02", "", "U1", "B2"),      # accepted
        (4, "P2", "Pia again", "", "", "U1", "B3"),          # later copy
        (5, "P3", "Bad", "1990-13-45", "", "U1", "B3"),      # invalid date
        (6, "P4", "Nobed", None, None, "U1", "B9"),          # unknown bed: no update
    ], PAT_COLS)
    res = I.ingest_patient(t, cands)
    out = dict(collect(res.outcome, "arrival_seq", "outcome"))
    assert out == {1: "duplicate_key", 2: "missing_required", 3: "accepted",
                   4: "duplicate_key", 5: "invalid_value", 6: "accepted"}
    acc = collect(res.accepted, "patient_no", "date_of_birth", "date_admitted")
    assert sorted(acc) == [("P2", d("1990-01-02"), None), ("P4", None, None)]
    assert res.accepted.count() + res.rejected.count() == cands.count()
    beds = dict(collect(res.snapshots["bed"], "bed_no", "is_occupied"))
    assert beds == {"B1": 0, "B2": 1, "B3": 1}
    keys = [r[0] for r in collect(res.snapshots["patient"], "patient_no")]
    assert sorted(keys) == ["P1", "P2", "P4"]


def test_doctor_consultant_flag_and_blank_fields(make_tables, spark):
    t = make_tables(doctor=[("D1", "Cara", "consultant", None, "X", None)], consultant=[("D1",)])
    cands = spark.createDataFrame([
        (1, "D2", "Bob", "registrar(r)", "", "X", "  ", True),
        (2, "D3", "Al", "  ", "2020-02-02", "X", "D1", False),
        (3, "D4", "Cy", "student(s)", "", "", "D1", False),   # specialty required
    ], "arrival_seq long, staff_no string, name string, position string, date_joined string, "
       "specialty_name string, consultant_staff_no string, is_consultant boolean")
    res = I.ingest_doctor(t, cands)
    rows = collect(res.outcome.orderBy("arrival_seq"), "position", "date_joined_team",
                   "consultant_staff_no", "outcome")
    assert rows == [("consultant", None, None, "accepted"),
                    ("", d("2020-02-02"), "D1", "accepted"),
                    ("student(s)", None, "D1", "missing_required")]
    assert sorted(r[0] for r in collect(res.snapshots["consultant"])) == ["D1", "D2"]


def test_nurse_roles_and_unknown_role(make_tables, spark):
    t = make_tables(nurse=[], staff_nurse=[])
    cands = spark.createDataFrame([
        (1, "N1", "Amy", "W1", "U1", "non_reg"),
        (2, "N2", "Bea", "W1", "U1", "matron"),     # nurse kept, no role row
        (3, "N3", "Cat", "W1", "U1", " "),          # role is required
    ], "arrival_seq long, staff_no string, name string, ward_name string, care_unit_no string, "
       "role string")
    res = I.ingest_nurse(t, cands)
    assert dict(collect(res.outcome, "staff_no", "outcome")) == {
        "N1": "accepted", "N2": "accepted", "N3": "missing_required"}
    assert collect(res.snapshots["non_reg_nurse"]) == [("N1",)]
    assert all(res.snapshots[r].count() == 0 for r in ("day_sister", "night_sister", "staff_nurse"))
    assert res.snapshots["nurse"].count() == 2


def test_ward_units_default_and_specialty(make_tables, spark):
    t = make_tables(ward=[("W1", "Cardio", 2)], specialty=[("Cardio",)])
    cands = spark.createDataFrame([(1, "W2", "Cardio", None), (2, "W3", "Neuro", "7"),
                                   (3, "W1", "Cardio", "1")],
                                  "arrival_seq long, ward_name string, specialty_name string, "
                                  "num_care_units string")
    res = I.ingest_ward(t, cands)
    assert collect(res.outcome.orderBy("arrival_seq"), "number_of_care_units", "outcome") == [
        (2, "accepted"), (7, "accepted"), (1, "duplicate_key")]
    spec = I.ingest_specialty(t, spark.createDataFrame([(1, " Cardio"), (2, "Neuro"), (3, "Neuro")],
                                                       "arrival_seq long, specialty_name string"))
    assert collect(spec.outcome.orderBy("arrival_seq"), "outcome") == [
        ("duplicate_key",), ("accepted",), ("duplicate_key",)]


def test_next_number_rules(spark):
    def nxt(keys):
        df = spark.createDataFrame([(k,) for k in keys], "k string")
        return next_number(df, "k", "PAT").collect()[0][0]

    assert nxt([]) == 1
    assert nxt(["PAT-999", "PAT-007"]) == 1000
    assert nxt(["PAT-x", "PAT-002"]) == 3
    assert nxt(["PAT-3000000000", "PAT-007"]) == 3000000001  # beyond a 32-bit integer


def test_one_winner_among_ties_and_no_turn_without_sequence(make_tables, spark):
    t = make_tables(ward=[("W0", "S", 1)])
    rows = [(5, "W1", "B", None), (5, "W1", "A", None), (5, " W1", "A", None),  # tied, two of them equal
            (None, "W2", "A", None), (None, "W2", "A", None), (7, "W2", "B", None),
            (1, "W3", "A", "99999999999"), (2, "W3", "A", "2"), (3, "W0", "A", None)]
    res = I.ingest_ward(t, spark.createDataFrame(
        rows, "arrival_seq long, ward_name string, specialty_name string, num_care_units string"))
    got = sorted(collect(res.outcome, "ward_name", "specialty_name", "outcome"))
    assert got == [("W0", "A", "duplicate_key"), ("W1", "A", "accepted"), ("W1", "A", "duplicate_key"),
                   ("W1", "B", "duplicate_key"), ("W2", "A", "missing_sequence"),
                   ("W2", "A", "missing_sequence"), ("W2", "B", "accepted"),
                   ("W3", "A", "accepted"), ("W3", "A", "invalid_value")]
    assert sorted(collect(res.snapshots["ward"], "ward_name")) == [("W0",), ("W1",), ("W2",), ("W3",)]


def test_write_classifies_once(make_tables, spark, monkeypatch, tmp_path):
    t = make_tables()
    batch = spark.createDataFrame([(1, "N1", "Ann", "W", "U", "day_sister"), (2, "N2", "Bob", "W", "U", "x")],
                                  "arrival_seq long, staff_no string, name string, ward_name string,"
                                  " care_unit_no string, role string")
    paths = I.ingest_nurse(t, batch).write(str(tmp_path / "v1")).paths
    assert set(paths) == {"nurse", "day_sister", "night_sister", "staff_nurse", "non_reg_nurse"}
    assert collect(spark.read.parquet(paths["day_sister"])) == [("N1",)]
    seen = []
    change = I.TableChange(t.nurse, "staff_no", lambda rows: rows.select("staff_no"),
                           lambda target, rows: seen.append(rows) or rows.select("staff_no"))
    I.IngestResult(I.ingest_nurse(t, batch).outcome, {"nurse": change}).write(str(tmp_path / "v2"))
    assert "_outcome" in seen[0].inputFiles()[0]  # the snapshot reads what was written


def test_dense_index_and_assign_ids_across_partitions(spark):
    rows = spark.range(0, 1000, 1, numPartitions=7).select(
        ((F.col("id") * 7919) % 1000).alias("arrival_seq"))
    idx = dense_index(rows, ["arrival_seq"]).collect()
    assert sorted((r["arrival_seq"], r["__idx"]) for r in idx) == [(i, i) for i in range(1000)]
    existing = spark.createDataFrame([("PAT-998",)], "patient_no string")
    got = assign_ids(rows, existing, "patient_no", "PAT", ["arrival_seq"])
    keys = dict(collect(got, "arrival_seq", "patient_no"))
    assert keys[0] == "PAT-999" and keys[1] == "PAT-1000" and keys[999] == "PAT-1998"


def test_classify_salted_path_matches_broadcast_path(make_tables, spark, monkeypatch):
    import functools

    from wardline.operators import skew

    t = make_tables(specialty=[("Cardio",)])
    rows = [(i, "Neuro" if i % 3 else f" S{i % 7} ") for i in range(300)] + [(999, "Cardio")]
    cands = spark.createDataFrame(rows, "arrival_seq long, specialty_name string")
    want = sorted(collect(I.ingest_specialty(t, cands).outcome, "arrival_seq", "outcome"))
    monkeypatch.setattr(I, "salted_join",
                        functools.partial(skew.salted_join, max_bytes=0))
    got = sorted(collect(I.ingest_specialty(t, cands).outcome, "arrival_seq", "outcome"))
    assert got == want
    assert dict(want)[1] == "accepted" and dict(want)[2] == "duplicate_key"
    assert dict(want)[999] == "duplicate_key"
