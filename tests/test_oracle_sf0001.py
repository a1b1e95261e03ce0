"""Every registered job against its DuckDB twin on the sf0.001 tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as E
from wardline.plans.registry import queries as registered

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _canon(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


def test_every_query_has_an_oracle():
    assert set(registered()) <= set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_matches_oracle(spark, duck, name):
    tbl = E.queries()[name](spark, SF).toArrow()
    res = duck.execute(E.oracle_sql()[name])
    o_names = [c[0] for c in res.description]
    assert sorted(tbl.column_names) == sorted(o_names)
    s_rows = [tuple(r.values()) for r in tbl.to_pylist()]
    assert _canon(tbl.column_names, s_rows) == _canon(o_names, res.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns[:2] == ["patient_no", "patient_name"]
    assert df.count() > 0
