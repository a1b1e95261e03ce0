"""Join helpers: both paths of the size-checked strategies give the same rows."""

from __future__ import annotations

from conftest import collect

from wardline.operators.joins import (
    bounded_broadcast,
    expand_in_order,
    left_join_hot_right,
    provably_small,
    restrict,
    semi_join,
    stored_bytes,
)


def _sides(spark):
    left = spark.createDataFrame(
        [("a", 1, "x"), ("b", 2, "y"), ("c", 3, None), ("d", 4, "x")], "name string, n int, k string")
    right = spark.createDataFrame(
        [("x", 10), ("x", 11), ("y", 20), ("z", 30)], "k string, v int")
    return left, right


def test_left_join_hot_right_equals_left_join(spark):
    left, right = _sides(spark)
    want = sorted(collect(left.join(right, "k", "left").select("name", "n", "k", "v")), key=str)
    got = sorted(collect(left_join_hot_right(left, right, "k").select("name", "n", "k", "v")),
                 key=str)
    assert got == want


def test_expand_in_order_both_paths(spark):
    left, right = _sides(spark)
    order = ["name", "n", "v"]
    small = expand_in_order(left, right, "k", ["name"]).orderBy(*order)
    large = expand_in_order(left, right, "k", ["name"], max_bytes=0).orderBy(*order)
    assert collect(small.select("name", "v")) == collect(large.select("name", "v"))
    assert collect(small.select("name", "v")) == [
        ("a", 10), ("a", 11), ("b", 20), ("c", None), ("d", 10), ("d", 11)]


def test_bounded_checks(spark):
    df = spark.range(10)
    assert stored_bytes(df) == 80
    assert provably_small(df, 80) and not provably_small(df, 79) and not provably_small(df, 0)
    assert bounded_broadcast(df, 5).count() == 10 and bounded_broadcast(df, 500).count() == 10
    assert stored_bytes(df.where("id > 8").select((df.id + 1).alias("x"))) == 80  # the whole table
    keys = spark.createDataFrame([("x",)], "k string")
    left, _ = _sides(spark)
    assert collect(restrict(left, "k", keys), "name") == collect(restrict(left, "k", ["x"]), "name")
    assert sorted(collect(restrict(left, "k", "x"), "name")) == [("a",), ("d",)]
    assert restrict(left, "k", None).count() == 4


def test_expand_in_order_keeps_the_order_and_shuffles_no_expanded_row(spark):
    """Small by statistics, small as measured, and neither: the same rows in the same order,
    with repeated left rows and keys, missing keys and NULL entries."""
    left = spark.createDataFrame(
        [("b", 1, "x"), ("a", 2, "y"), ("a", 1, "x"), ("a", 2, "y"), ("c", 3, None), ("d", 4, "w"),
         ("a", 2, "z")], "name string, n int, k string")
    right = spark.createDataFrame(
        [("x", "p"), ("x", None), ("y", "q"), ("y", "s"), ("z", "r"), (None, "t")], "k string, v string")
    want = [("a", 1, "x", None), ("a", 1, "x", "p"), ("a", 2, "y", "q"), ("a", 2, "y", "q"), ("a", 2, "z", "r"),
            ("a", 2, "y", "s"), ("a", 2, "y", "s"), ("b", 1, "x", None), ("b", 1, "x", "p"),
            ("c", 3, None, None), ("d", 4, "w", None)]
    for limit in (stored_bytes(right), 1000, 1, 0):
        df = expand_in_order(left, right, "k", ["name", "n"], max_bytes=limit).select("name", "n", "k", "v")
        assert df.collect() == want, limit
        if limit >= 1000:  # the plan as it ran
            plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            moved = [line for line in plan.splitlines() if "Exchange rangepartitioning" in line]
            assert all("v#" not in line for line in moved), plan


def test_few_keys_restrict_without_a_shuffle_of_the_rows(spark):
    """Keys that statistics do not bound are measured as the query runs."""
    left = spark.createDataFrame(
        [("a", 1, "x"), ("b", 2, "y"), ("b", 2, "y"), ("c", 3, None), ("d", 4, "x")], "name string, n int, k string")
    keys = spark.createDataFrame([("x",), ("x",), (None,), ("w",)], "key string")
    df = restrict(left, "k", keys)
    assert sorted(collect(df, "name", "n", "k")) == [("a", 1, "x"), ("d", 4, "x")]
    for limit in (1000, 1, 0):  # broadcast, shuffle as measured, shuffle as planned
        rows = semi_join(left, keys.select(keys.key.alias("k")), "k", max_bytes=limit).select("name", "n")
        assert sorted(map(tuple, rows.collect())) == [("a", 1), ("d", 4)], limit
        ran = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        if limit == 1000:  # a local read would mean that the rows were shuffled first
            assert "LeftSemi, BuildRight" in ran and "AQEShuffleRead local" not in ran, ran
