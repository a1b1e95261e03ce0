"""Salted joins give the plain join's rows; hot keys are bounded and spread."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.operators.skew import hot_keys, salted_join


def _fact(spark):
    # key 'H' holds half of all rows; one fact key has no dimension row
    rows = [("H", i) for i in range(500)] + [(f"K{i % 50}", i) for i in range(499)] + [("X", 0)]
    return spark.createDataFrame(rows, "k string, v int")


def _dim(spark):
    return spark.createDataFrame([("H", "hot")] + [(f"K{i}", f"n{i}") for i in range(50)],
                                 "k string, name string")


def _rows(df):
    return sorted(tuple(r) for r in df.select("k", "v", "name").collect())


def test_salted_join_equals_plain_join(spark):
    fact, dim = _fact(spark), _dim(spark)
    for how in ("inner", "left"):
        want = _rows(fact.join(dim, "k", how))
        assert _rows(salted_join(fact, dim, "k", how, max_bytes=0)) == want  # salted
        assert _rows(salted_join(fact, dim, "k", how)) == want                        # broadcast


def test_hot_keys_are_bounded_and_salted(spark):
    fact = _fact(spark)
    counts = fact.groupBy("k").agg(F.count(F.lit(1)).alias("__n"))
    hot = {r["k"]: r["__salts"] for r in hot_keys(counts, "k", 8).collect()}
    assert hot["H"] == 4                      # half of the rows -> half of 8 partitions
    assert set(hot) == {"H"}                  # no other key exceeds an average partition
    many = hot_keys(counts, "k", 400)
    assert many.count() < 400 and many.agg(F.min("__salts")).first()[0] >= 2


def test_hot_rows_spread_over_salts(spark):
    fact, dim = _fact(spark), _dim(spark)
    joined = salted_join(fact, dim, "k", max_bytes=0)
    assert joined.where("k = 'H'").count() == 500
    spread = (fact.where("k = 'H'")
              .select(F.pmod(F.xxhash64("k", "v"), F.lit(4)).alias("s"))
              .groupBy("s").count().collect())
    assert len(spread) == 4 and min(r["count"] for r in spread) > 50
