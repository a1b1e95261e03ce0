"""Batch classification equals applying the posts one at a time (random batches)."""

from __future__ import annotations

from conftest import collect
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from wardline.plans import ingest as I

TRIM = " \t\n\r\x00\x0b"
names = st.sampled_from(["Cardio", " Cardio", "Neuro\t", "Derm", "", "  ", "\n", "Onco"])


def sequential(existing: set[str], posts: list[tuple[int | None, str]]) -> list[tuple]:
    """One post at a time: trim, required check, key check, insert."""
    table, out = set(existing), []
    for seq, raw in sorted(posts, key=lambda p: (p[0] is None, p[0] or 0)):
        name = raw.strip(TRIM)
        if name == "":
            outcome = "missing_required"
        elif seq is None:
            outcome = "missing_sequence"
        elif name in table:
            outcome = "duplicate_key"
        else:
            table.add(name)
            outcome = "accepted"
        out.append((seq, name, outcome))
    return sorted(out, key=str)


@settings(max_examples=12, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(existing=st.sets(st.sampled_from(["Cardio", "Derm"]), max_size=2),
       batch=st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 4)), names),
                      min_size=1, max_size=12))
def test_first_wins_equals_sequential_posts(spark, make_tables, existing, batch):
    """Also with tied and missing arrival numbers: one winner per key."""
    t = make_tables(specialty=[(n,) for n in existing])
    cands = spark.createDataFrame(batch, "arrival_seq long, specialty_name string")
    res = I.ingest_specialty(t, cands)
    got = collect(res.outcome, "arrival_seq", "specialty_name", "outcome")
    assert sorted(got, key=str) == sequential(existing, batch)
    keys = collect(res.snapshots["specialty"], "specialty_name")
    assert len(keys) == len(set(keys))


@settings(max_examples=5, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(min_value=0, max_value=300), parts=st.integers(min_value=1, max_value=9),
       seed=st.integers(min_value=0, max_value=10_000))
def test_dense_index_is_the_sorted_position(spark, n, parts, seed):
    import random

    from wardline.operators.ids import dense_index

    seqs = random.Random(seed).sample(range(10 * n + 1), n)
    df = spark.createDataFrame([(s,) for s in seqs], "arrival_seq long").repartition(parts)
    got = sorted((r["arrival_seq"], r["__idx"]) for r in dense_index(df, ["arrival_seq"]).collect())
    assert got == [(s, i) for i, s in enumerate(sorted(seqs))]


@settings(max_examples=6, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.sampled_from(["D1", "D2", "D3"]),
                               st.one_of(st.none(), st.integers(min_value=1, max_value=4)),
                               st.sampled_from(["A", "B", "C", "D", None])),
                     min_size=1, max_size=15))
def test_latest_grade_rule(spark, make_tables, rows):
    import datetime as dt

    from wardline.plans.records import latest_grades

    progress = [(i, staff, "E", "p", None if day is None else dt.date(2024, 1, day), grade)
                for i, (staff, day, grade) in enumerate(rows)]
    got = dict(collect(latest_grades(make_tables(progress=progress))))
    want = {}
    for pid, staff, _, _, date, grade in progress:
        rank = (date is not None, date or dt.date.min, pid)
        if staff not in want or rank > want[staff][0]:
            want[staff] = (rank, grade)
    assert got == {staff: grade for staff, (_, grade) in want.items()}
